"""Helpers that several training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.session import shared_folder


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries made and run in here leave no shuffle files: their results are in the shared folder, and lost ones are computed again."""
    was = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, was)


def pin(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def new_folder(spark: SparkSession) -> str:
    """The name of a new folder in the shared one."""
    return f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again: lineage is cut as by ``pin``, in compressed columns."""
    path = path or new_folder(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        df.select("*").write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove what was ``stored`` there, once nothing reads it any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def broadcast_if(df: DataFrame, most_rows: int) -> DataFrame:
    """``df`` (pinned, narrow rows) with a broadcast hint if it has at most ``most_rows`` rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() <= most_rows else df


#: Keys of more than one in so many rows are joined by broadcast; there are fewer of them than this.
HOT_KEYS = 256


def join_spread(rows: DataFrame, classes: DataFrame, keys: list[str], size: str) -> DataFrame:
    """``rows`` joined with ``classes`` (one row a key, pinned); its column ``size`` says how many rows have the key.

    A key that a ``HOT_KEYS`` th of all rows share would fill one task, so these fewer than
    ``HOT_KEYS`` classes are broadcast and their rows stay where they are.
    """
    total = classes.agg(F.sum(size)).first()[0] or 0
    hot = F.col(size) * HOT_KEYS > total
    many = classes.where(hot)
    if many.isEmpty():
        return rows.join(classes, keys).drop(size)
    few = rows.join(F.broadcast(many.select(*keys)), keys, "left_anti").join(classes.where(~hot), keys)
    return rows.join(F.broadcast(many), keys).unionByName(few).drop(size)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def union_pairs(root: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Merge the components of ``left[i]`` and ``right[i]``; roots stay the smallest index."""
    while left.size:
        a, b = root[left], root[right]
        open_ = a != b
        if not open_.any():
            break
        left, right = left[open_], right[open_]
        np.minimum.at(root, np.maximum(a, b)[open_], np.minimum(a, b)[open_])
        while not np.array_equal(jumped := root[root], root):
            root = jumped
    return root


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` to ``(node, root)``: root is the smallest node reachable.

    Every round takes the smallest label among a node's neighbours and then jumps
    once along the labels, so the distance covered doubles. Labels and edges stay
    distributed; each round is pinned. Null and self links are ignored; no edges
    give no rows.
    """
    both = pin(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        .select("e.a", "e.b")
        .distinct()
    )
    labels = pin(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"), F.count("*").alias("links")).select("node", F.least("node", "low").alias("root"), "links"))
    while True:
        heard = join_spread(both, labels.withColumnRenamed("node", "b"), ["b"], "links").select(F.col("a").alias("node"), "root")
        least = pin(labels.select("node", "root").unionByName(heard).groupBy("node").agg(F.min("root").alias("near")))
        nears = least.groupBy("near").agg(F.count("*").alias("held"))
        jump = pin(nears.join(labels.select(F.col("node").alias("near"), F.col("root").alias("far")), "near"))
        low = F.least("near", "far")
        nxt = pin(join_spread(least, jump, ["near"], "held").join(labels.withColumnRenamed("root", "was"), "node").select("node", low.alias("root"), "links", (low != F.col("was")).alias("moved")))
        labels = nxt.drop("moved")
        if nxt.where("moved").isEmpty():
            return labels.select("node", "root")
