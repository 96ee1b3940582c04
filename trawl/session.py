"""The session settings that the operators assume, and the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def session(name: str = "trawl", **more: str) -> SparkSession:
    """The running session, or a new one, with these settings; ``more`` has dots as double underscores."""
    builder = SparkSession.builder.appName(name)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in more.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only a local session without one (tests) gets a temporary folder."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", "") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="trawl-checkpoint-"))
        folder = context.getCheckpointDir()
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """The name of a new folder in the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written_once(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` as a Parquet table in the shared folder, for what several branches of a plan read: made once, and no executor's loss makes it anew."""
    path = new_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
