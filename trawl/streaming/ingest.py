"""Incremental evaluation: evidence that arrives is scored once and appended; progress is told to a listener."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import StructType


def read_stream(spark: SparkSession, path: str, schema: str, files_at_once: int = 100, format: str = "parquet", **options: str) -> DataFrame:  # noqa: A002
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).options(**options).format(format).load(path)


def append_results(stream: DataFrame, score: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, format: str = "parquet") -> StreamingQuery:  # noqa: A002
    """Score every micro-batch with a batch function and append its rows; restarts go on after the last batch.

    A batch that is repeated after a failure replaces its own rows, which lie in a folder of their own.
    """

    def write(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").format(format).save(f"{sink}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def committed(spark: SparkSession, sink: str) -> DataFrame | None:
    """The manifest: the names of the batches whose rows hold; None before the first. A batch counts once its row is written, as its last step."""
    try:
        return spark.read.schema("batch string").json(f"{sink}/manifest/*")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def append_new(stream: DataFrame, keys: list[str], order: list[str], sink: str, checkpoint: str) -> StreamingQuery:
    """Resume by key, across batches, restarts and streams of other checkpoints: a key's first row is passed on, and none later, however much later it comes.

    ``sink`` holds each batch's ``rows`` and, apart from them, its ``keys``, which are all that later batches read; a batch without an entry in
    the manifest counts for nothing, and its repetition replaces it. Within a batch the first row by ``order`` is kept. Null keys are keys.
    """
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def write(batch: DataFrame, number: int) -> None:
        spark, name = batch.sparkSession, f"{run}-{number:012d}"
        held = committed(spark, sink)
        if held is not None and not held.where(F.col("batch") == name).isEmpty():
            return  # written before a failure, which came before the stream noted it
        rest = [c for c in batch.columns if c not in keys]
        new = batch.groupBy(*keys).agg(F.min_by(F.struct(*batch.columns), F.struct(*order, *rest)).alias("r")).select("r.*")
        if held is not None:
            names = F.regexp_extract(F.input_file_name(), r"/keys/batch=([^/]+)/", 1)
            earlier = spark.read.schema(batch.select(*keys).schema).parquet(f"{sink}/keys/*").withColumn("_batch", names).join(held.withColumnRenamed("batch", "_batch"), "_batch", "left_semi")
            same = reduce(lambda a, b: a & b, (F.col(f"n.{k}").eqNullSafe(F.col(f"e.{k}")) for k in keys))
            new = new.alias("n").join(earlier.alias("e"), same, "left_anti")
        new.select(*batch.columns).write.mode("overwrite").parquet(f"{sink}/rows/batch={name}")
        spark.read.schema(batch.schema).parquet(f"{sink}/rows/batch={name}").select(*keys).write.mode("overwrite").parquet(f"{sink}/keys/batch={name}")
        spark.range(1).select(F.lit(name).alias("batch")).coalesce(1).write.mode("overwrite").json(f"{sink}/manifest/{name}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_new(spark: SparkSession, sink: str, schema: StructType) -> DataFrame:
    """What ``append_new`` has passed on: the rows of the batches in the manifest."""
    held = committed(spark, sink)
    if held is None:
        return spark.createDataFrame([], schema)
    names = F.regexp_extract(F.input_file_name(), r"/rows/batch=([^/]+)/", 1)
    return spark.read.schema(schema).parquet(f"{sink}/rows/*").withColumn("_batch", names).join(held.withColumnRenamed("batch", "_batch"), "_batch", "left_semi").drop("_batch")


def keep_current(counts: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """The running result: each micro-batch writes the rows that it changed, and only those, into a folder of its own.

    The stream's state holds only what its watermark still admits; rows that come later than that change nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number:012d}")

    return counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_current(spark: SparkSession, sink: str, keys: list[str]) -> DataFrame:
    """The result as it stands: of each key the row that ``keep_current`` wrote last."""
    rows = spark.read.option("basePath", sink).parquet(f"{sink}/batch=*")
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")


def first_seen(stream: DataFrame, key: str, at: str, within: str = "30 days") -> DataFrame:
    """The first row of each key inside one stream, with bounded state: a key that returns after ``within`` is passed on again (``append_new`` never does)."""
    timed = stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", within)
    return timed.dropDuplicatesWithinWatermark([key]).drop("_at")


def running_counts(stream: DataFrame, at: str, window: str, late: str, *keys: str) -> DataFrame:
    """Event counts by window and keys, for ``keep_current``; rows of windows that ended more than ``late`` before the latest row of earlier batches are left out."""
    timed = stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    counts = timed.groupBy(F.window("_at", window), *keys).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), *keys, "n")


class Progress(StreamingQueryListener):
    """Tells how far a stream is: rows so far and the last micro-batch, through ``tell``."""

    def __init__(self, tell: Callable[[str, int, int], None]) -> None:
        self.tell, self.rows = tell, {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.rows[str(event.runId)] = 0

    def onQueryProgress(self, event) -> None:  # noqa: N802
        run = str(event.progress.runId)
        self.rows[run] = self.rows.get(run, 0) + event.progress.numInputRows
        self.tell("progress", event.progress.batchId, self.rows[run])

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.tell("failed" if event.exception else "done", -1, self.rows.pop(str(event.runId), 0))
