"""Running numbers and caps in samples of any size, without sorting a sample in one task.

Rows are dealt in ranges of (sample, order), so a sample that holds most rows lies in many
ranges. Each range numbers its own rows; a table with a row for each sample and range says how many came before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.session import written_once


def running(rows: DataFrame, order: Sequence[str], sums: dict[str, Column], key: str = "sample_key") -> DataFrame:
    """``rows`` with, for each name, the sum of its values over the sample's rows up to and with this one, in the given order.

    ``order`` ought to tell a sample's rows apart; equal ones stand in any order. A null key is a sample of its own.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie = "_tie"
    valued = rows.withColumns({f"_v_{name}": value for name, value in sums.items()}).withColumn(tie, F.monotonically_increasing_id())
    dealt = valued.repartitionByRange(parts, key, *order, tie).withColumn("_range", F.spark_partition_id())
    held = written_once(dealt, "ranges")  # a range stays what it is, whoever reads it
    inside = Window.partitionBy("_range", key).orderBy(*order, tie).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("_k").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    totals = held.groupBy(F.col("_range").alias("_r"), F.col(key).alias("_k")).agg(*(F.sum(f"_v_{name}").alias(f"_t_{name}") for name in sums))
    before = totals.select("_r", "_k", *(F.coalesce(F.sum(f"_t_{name}").over(earlier), F.lit(0)).alias(f"_b_{name}") for name in sums))
    numbered = held.select("*", *(F.sum(f"_v_{name}").over(inside).alias(f"_i_{name}") for name in sums))
    joined = numbered.join(before, (F.col("_range") == F.col("_r")) & F.col(key).eqNullSafe(F.col("_k")))
    return joined.select(*rows.columns, *((F.col(f"_b_{name}") + F.col(f"_i_{name}")).alias(name) for name in sums))


def first_rows(rows: DataFrame, order: Sequence[str], most: int, key: str = "sample_key") -> DataFrame:
    """The first ``most`` rows of each sample: every task keeps as many of its own, so few are left to be ranked together."""
    local = Window.partitionBy("_range", key).orderBy(*order)
    whole = Window.partitionBy(key).orderBy(*order)
    dealt = rows.withColumn("_range", F.pmod(F.xxhash64(*order), F.lit(256)))  # spreads a sample; its rows are dealt by it and the key
    few = dealt.withColumn("_rank", F.row_number().over(local)).where(F.col("_rank") <= most)
    return few.withColumn("_rank", F.row_number().over(whole)).where(F.col("_rank") <= most).drop("_rank", "_range")
