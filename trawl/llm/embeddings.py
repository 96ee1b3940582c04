"""Embedding near-duplicates: random-hyperplane sign hashing, exact cosine, components.

Only rows with the same non-null label are compared. Equal vectors collapse to one
class first. Labels may be of any type that Spark can group. A class is hashed by the signs of its products with fixed random
hyperplanes into several tables, both by the number of classes (``plan_of``); classes that share a bucket are compared exactly
in double precision, block by block. Buckets over ``block_rows`` are cut into
blocks whose pairs go to different tasks, so no bucket is collected whole. A pair
that meets in several tables counts in the first only. Tasks report one row per
class (links counted, local root), never pairs.

Defined results: vectors that are null, zero, empty, or hold null or non-finite
components, and rows with a null label, link with nothing; vectors of different
lengths are not compared. Repeated rows are vectors of their own. A row with a null vec_id counts as a
linked vector, but never gives a component its id; ``component_id`` and ``kept`` are null only where no row of the component has an id. Empty tables give empty results;
other input columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import connected_components, join_spread, pin, union_pairs

SEED = 20
BLOCK_ROWS = 4096
PAIRS_AT_ONCE = 1 << 18
LEAST_BITS, A_BUCKET, RECALL = 10, 256, 0.999


def signatures(vectors: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """``(rows, tables)`` codes of the signs against fixed hyperplanes."""
    planes = np.random.default_rng(SEED).normal(size=(vectors.shape[1], tables * bits))
    signs = (vectors @ planes > 0).reshape(len(vectors), tables, bits)
    return signs @ (1 << np.arange(bits))


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows scaled to length one."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def plan_of(classes: int, threshold: float) -> tuple[int, int]:
    """``(tables, bits)``: bits so that ``A_BUCKET`` of a label's classes share a bucket by chance, and tables so that a pair at the threshold meets in one with probability ``RECALL``.

    Work grows with the classes and their logarithm, not with their square.
    """
    bits = max(LEAST_BITS, math.ceil(math.log2(max(1, classes) / A_BUCKET)))
    same = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return (math.ceil(math.log(1 - RECALL) / math.log(1 - same)) if same < 1 else 1), bits


def near_vectors(vectors: DataFrame, threshold: float = 0.98, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``vectors(vec_id, embedding, label)`` to ``(vec_id, n_links, component_id, kept)``."""
    plain = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))  # -0.0 becomes 0.0
    sound = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long"), "label", F.when(sound & F.col("label").isNotNull(), plain).alias("v"))
    kind = rows.schema["label"].dataType.simpleString()
    usable = rows.where("v IS NOT NULL")
    classes = pin(usable.groupBy("label", "v").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies")).withColumn("cid", F.monotonically_increasing_id()))

    tables, bits = plan_of(classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0, threshold)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("v").value_lengths().to_numpy()
            for n in np.unique(lengths):
                part = pa.RecordBatch.from_arrays(batch.columns, batch.schema.names).filter(pa.array(lengths == n))
                codes = signatures(matrix(part.column("v")), tables, bits)
                codes = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, tables), pa.int32()), pa.array(codes.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, codes], [*part.schema.names, "codes"])

    coded = pin(classes.select("cid", "label", "v", "copies").mapInArrow(hashed, f"cid long, label {kind}, v array<double>, copies long, codes array<long>"))
    spots = F.posexplode("codes").alias("tab", "code")
    bucket = ["label", "dims", "tab", "code"]
    large = coded.select("label", F.size("v").alias("dims"), spots).groupBy(bucket).count().where(F.col("count") > block_rows).select(*bucket, F.ceil(F.col("count") / block_rows).cast("long").alias("parts"))
    placed = (
        coded.withColumn("dims", F.size("v"))
        .select("*", spots)
        .join(large, bucket, "left")
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
        .withColumn("part", F.pmod(F.xxhash64("cid"), "parts"))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        .withColumn("low", F.least("part", "other"))
        .withColumn("high", F.greatest("part", "other"))
    )

    def meet(rows: pa.Table) -> pa.Table:
        v, copies, cid = matrix(rows.column("v")), rows.column("copies").to_numpy(), rows.column("cid").to_numpy()
        codes = rows.column("codes").combine_chunks().flatten().to_numpy().reshape(len(cid), -1)
        tab, part = rows.column("tab")[0].as_py(), rows.column("part").to_numpy()
        low, high = rows.column("low")[0].as_py(), rows.column("high")[0].as_py()
        ones, twos = np.flatnonzero(part == low), np.flatnonzero(part == high)
        links, root = np.zeros(len(cid), np.int64), np.arange(len(cid))
        step = max(1, PAIRS_AT_ONCE // max(1, twos.size))
        for at in range(0, ones.size, step):
            some = ones[at : at + step]
            near = v[some] @ v[twos].T >= threshold
            if low == high:
                near &= cid[some, None] < cid[twos]
            for t in range(tab):
                near &= codes[some, t, None] != codes[twos, t]
            links[some] += near @ copies[twos]
            links[twos] += copies[some] @ near
            x, y = np.nonzero(near)
            root = union_pairs(root, some[x], twos[y])
        told = np.flatnonzero(links)
        return pa.table({"cid": cid[told], "root": cid[root[told]], "links": links[told]})

    met = pin(placed.select("cid", "v", "copies", "codes", *bucket, "part", "low", "high").groupBy(*bucket, "low", "high").applyInArrow(meet, "cid long, root long, links long"))
    roots = connected_components(met.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    counted = met.groupBy("cid").agg(F.sum("links").alias("links"))
    member = pin(classes.join(counted, "cid", "left").join(roots.withColumnRenamed("node", "cid"), "cid", "left").select("label", "v", "first", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "cid").alias("root")))
    least = pin(member.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("classes")))
    named = pin(join_spread(member, least, ["root"], "classes").select("label", "v", "copies", "n_links", "component_id"))
    done = join_spread(usable, named, ["label", "v"], "copies").select("vec_id", "n_links", "component_id")
    alone = rows.where("v IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return done.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
