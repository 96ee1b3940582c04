"""The taint registry on a stream: what a sample has read is kept as state, and what it sends later is held against it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from trawl.functions import rules
from trawl.functions.text import decode_layers
from trawl.operators.taint import content_secrets, may_hold_secrets, read_tokens

JUDGED = "sample_key long, send_seq long, destination string, category string, via string, strength string, path string, confirmed boolean"
TOKEN = "array<struct<category:string,token:string,strength:string>>"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepared(events: DataFrame, harness: list[str] | None = None) -> DataFrame:
    """``events(sample_key, seq, at_ms, path, content, destination, payload)`` with what the registry needs; a row with a path is a read, one with a destination a send.

    Secrets, lines and decoded layers are found here, by column functions, before any state.
    """
    reads = read_tokens(events.where("path IS NOT NULL"), harness, ["at_ms"]).select("sample_key", "seq", "at_ms", "path", F.col("tokens").cast(TOKEN).alias("tokens"), F.lit(None).cast("string").alias("destination"), F.lit(None).cast("array<string>").alias("layers"), F.lit(None).cast("array<array<string>>").alias("patterns"))
    sends = events.where("destination IS NOT NULL").select("sample_key", "seq", "at_ms", F.lit(None).cast("string").alias("path"), F.lit(None).cast(TOKEN).alias("tokens"), "destination", decode_layers(F.col("payload")).alias("layers"))
    likely = sends.withColumn("_likely", may_hold_secrets(F.array_join("layers", "\n")))  # what one layer holds, all of them together hold
    return reads.unionByName(likely.withColumn("patterns", F.transform("layers", lambda x: F.transform(content_secrets(x, F.col("_likely")), lambda s: s["category"]))).drop("_likely"))


class Registry(StatefulProcessor):
    """A map of tokens for each sample, at most ``MAX_TOKENS``; an entry lapses once the sample's time is ``keep_ms`` past the read. A lapsed one makes room."""

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tokens = handle.getMapState("tokens", "token string", "seq long, pos int, path string, category string, strength string, at_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = {k[0]: tuple(v) for k, v in self.tokens.iterator()}
        events = [e for batch in rows for e in batch.itertuples(index=False)]
        out = []
        for e in sorted(events, key=lambda e: (e.seq, e.path is not None)):  # what is sent is held against what was read before it
            for token in [t for t, entry in known.items() if entry[-1] + self.keep_ms < e.at_ms]:
                del known[token]
                self.tokens.removeKey((token,))
            if e.path is not None:
                for pos, t in enumerate(e.tokens):
                    if t["token"] not in known and len(known) < rules.MAX_TOKENS:
                        known[t["token"]] = entry = (int(e.seq), pos, e.path, t["category"], t["strength"], int(e.at_ms))
                        self.tokens.updateValue((t["token"],), entry)
            else:
                out += [(key[0], int(e.seq), e.destination, *found) for found in judged(known, e.layers, e.patterns, int(e.seq))]
        yield pd.DataFrame(out, columns=[c.split()[0] for c in JUDGED.split(", ")])

    def close(self) -> None:
        pass


def judged(known: dict[str, tuple], layers, patterns, seq: int) -> Iterator[tuple]:
    """Of one send the best evidence of each category: seen bytes before patterns, secrets before lines, then the first."""
    best: dict[str, tuple] = {}
    for at, (layer, categories) in enumerate(zip(layers, patterns, strict=True)):
        seen = [(category, (False, strength != "strong", at, read, pos), "taint", strength, path) for token, (read, pos, path, category, strength, _) in known.items() if read < seq and token in layer]
        for category, rank, *evidence in [*seen, *((c, (True, False, at, -1, -1), "pattern", "strong", "") for c in categories)]:
            if category not in best or rank < best[category][0]:
                best[category] = (rank, *evidence)
    for category, (_, via, strength, path) in best.items():
        yield category, via, strength, path, via == "taint" and (strength == "strong" or category not in rules.WEAK_ONLY)


def judge_stream(events: DataFrame, harness: list[str] | None = None, keep_ms: int = 30 * 86_400_000) -> DataFrame:
    """The rows of ``taint.adjudicate`` from a stream of reads and sends that come in order within a sample, over any number of batches and restarts.

    The rows of a sample in one micro-batch are held together; the source's ``maxFilesPerTrigger`` bounds them.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return prepared(events, harness).groupBy("sample_key").transformWithStateInPandas(Registry(keep_ms), JUDGED, "Append", "None")


def append_judged(events: DataFrame, sink: str, checkpoint: str, harness: list[str] | None = None, keep_ms: int = 30 * 86_400_000) -> StreamingQuery:
    """``judge_stream`` into a Parquet sink whose own log tells which files hold."""
    return judge_stream(events, harness, keep_ms).writeStream.format("parquet").outputMode("append").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
