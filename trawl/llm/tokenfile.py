"""Token ids as binary segments: written in document order, read back and checked.

Documents are range-partitioned by id and sorted, so partitions and
segments follow doc_id. A segment closes at the first document end after
``segment_ids`` ids; it holds the range-coded blocks of its ids and the ids and lengths of its
documents, and can be read alone. A dataset is a Parquet folder of segments
``(part, segment, docs, lengths, payload)`` in the shared folder, written and committed by Spark.

Defined results: a null text counts as empty and is just its end id; rows with
equal ids stand in the order of their texts; a null id comes first; an empty table writes no segments;
other input columns are not read. Ids must be below 2^16.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trawl.llm.common import shared_folder
from trawl.llm.rangecoder import BLOCK_IDS, decode, encode
from trawl.llm.tokens import encoder

SEGMENT_IDS = 4_000_000
SCHEMA = "part int, segment int, docs array<long>, lengths array<int>, payload binary"
TEXTS_AT_ONCE = 256


def segments(docs: DataFrame, tokenizer: str, end_id: int, segment_ids: int = SEGMENT_IDS, block_ids: int = BLOCK_IDS) -> DataFrame:
    """``docs(doc_id, text)`` to rows of ``SCHEMA``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer)
        part, number, names, lengths, held = 0, 0, [], [], []

        def close() -> pa.RecordBatch:
            payload = encode(np.concatenate(held).astype(np.int64), block_ids)
            row = [[part], [number], [names], [lengths], [payload]]
            kinds = (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], ["part", "segment", "docs", "lengths", "payload"])

        filled = 0
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                some = batch.slice(at, TEXTS_AT_ONCE)
                ids, ends = words.batch(some.column(2), end_id)
                for p, doc, mine in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), np.split(ids, ends[:-1]), strict=True):
                    part = p
                    names.append(doc)
                    held.append(mine)
                    lengths.append(mine.size)
                    filled += lengths[-1]
                    if filled >= segment_ids:
                        yield close()
                        number, filled, names, lengths, held = number + 1, 0, [], [], []
        if names:
            yield close()

    wanted = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = wanted.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    return dealt.select(F.spark_partition_id().alias("part"), "doc_id", "text").mapInArrow(run, SCHEMA)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, segment_ids: int = SEGMENT_IDS) -> None:
    segments(docs, tokenizer, end_id, segment_ids).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``(part, segment, at, doc_id, ids)``: every document's ids, decoded; ``at`` is their place in the segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, segment, docs, lengths, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, ends = decode(payload), np.cumsum(lengths)
                if ids.size != ends[-1]:
                    raise ValueError(f"segment {part}/{segment} holds {ids.size} ids, its documents {ends[-1]}")
                raw = ids.tobytes()
                for a in range(0, len(docs), TEXTS_AT_ONCE):
                    rows = range(a, min(a + TEXTS_AT_ONCE, len(docs)))
                    starts = [int(ends[k]) - lengths[k] for k in rows]
                    columns = ([part] * len(rows), [segment] * len(rows), starts, [docs[k] for k in rows], [raw[4 * s : 4 * (s + lengths[k])] for s, k in zip(starts, rows, strict=True)])
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "segment", "at", "doc_id", "ids"])

    return spark.read.schema(SCHEMA).parquet(path).mapInArrow(run, "part int, segment int, at long, doc_id long, ids binary")


def token_digest(docs: DataFrame, tokenizer: str, end_id: int = 1, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Write ``docs``, read the files, and return ``(doc_id, start, n_tokens, ids_crc32)`` from them."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer, end_id, segment_ids)
    sizes = spark.read.schema(SCHEMA).parquet(path).select("part", "segment", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n).alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))  # a row for each partition
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    firsts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    starts = sizes.withColumn("inner", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(firsts, "part").select("part", "segment", (F.col("first") + F.col("inner")).alias("base"))
    rows = read_tokens(spark, path).select("part", "segment", "at", "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    return rows.join(starts, ["part", "segment"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
