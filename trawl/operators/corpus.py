"""Discovery: package paths to labelled samples, and the choice among them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.functions.identity import identify, sample_key, tier_of, version_order

META = ["classification", "tier", "publisher", "sha256", "size_mb", "installs", "categories", "repository", "verified_publisher", "source", "removed_date"]


def with_identity(paths: DataFrame) -> DataFrame:
    """``paths(target, is_dir)`` with id, publisher, name, version and key."""
    named = paths.withColumn("ident", identify(F.col("target"), F.col("is_dir"))).select("*", "ident.*").drop("ident")
    return named.withColumn("key", sample_key(F.col("id"), F.col("version")))


def archives_win(archives: DataFrame, folders: DataFrame) -> DataFrame:
    """Archives, and the unpacked folders whose key no archive has."""
    return archives.unionByName(folders.join(archives.select("key").distinct(), "key", "left_anti").select(*archives.columns))


def last_of(rows: DataFrame, key: str, position: Column, ascending: bool = False) -> DataFrame:
    """One row of each key: the last by position, or the first."""
    order = position.asc() if ascending else position.desc()
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_rank = 1").drop("_rank")


def label_index(per_extension: DataFrame, per_version: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Metadata by version key and by id, as ``(key, meta)``; both inputs have a ``position``.

    By version the last row wins. By id the extension rows win, the last of them; an id
    they lack takes its first version row.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    kind = text("msft_classification_type")
    blank = dict.fromkeys(META, F.lit(""))
    ids = lambda df: df.withColumn("id", F.trim(text("extension_identifier"))).where("id <> ''")
    meta = lambda **more: F.struct(*(v.alias(k) for k, v in (blank | {"classification": kind, "tier": tier_of(kind), "source": text("source")} | more).items())).alias("meta")
    ext = ids(per_extension).select(F.lower("id").alias("key"), F.lit(0).alias("rank"), (-F.col("position")).alias("position"), meta(removed_date=text("msft_removed_date")))
    fields = {"publisher": "publisher_name", "sha256": "sha256", "size_mb": "size_mb", "installs": "installation_count", "categories": "categories", "repository": "repository_url", "verified_publisher": "verified_publisher"}
    ver = ids(per_version).select("id", F.trim(text("version")).alias("version"), "position", meta(**{k: text(c) for k, c in fields.items()}))
    by_version = last_of(ver.select(sample_key(F.col("id"), F.col("version")).alias("key"), "position", "meta"), "key", F.col("position"))
    by_id = ext.unionByName(ver.select(F.lower("id").alias("key"), F.lit(1).alias("rank"), F.col("position").cast("long").alias("position"), "meta"))
    by_id = last_of(by_id, "key", F.struct("rank", "position"), ascending=True)
    return by_version.select("key", "meta"), by_id.select("key", "meta")


def with_labels(samples: DataFrame, by_version: DataFrame, by_id: DataFrame, label: int | None = None) -> DataFrame:
    """Samples of a corpus of removed packages: metadata by version, else (as a whole) by id; label 1 unless forced."""
    found = samples.join(by_version.withColumnRenamed("meta", "_v"), "key", "left")
    found = found.join(by_id.select(F.col("key").alias("_id"), F.col("meta").alias("_i")), F.lower("id") == F.col("_id"), "left")
    meta = F.coalesce("_v", "_i")
    return found.withColumn("meta", meta).drop("_v", "_i", "_id").withColumns(
        {"classification": F.coalesce("meta.classification", F.lit("")), "tier": F.coalesce("meta.tier", F.lit("unknown")), "label": F.lit(1 if label is None else label)}
    )


def with_tree_label(samples: DataFrame, kind: str, label: int | None = None) -> DataFrame:
    """Samples whose label is the tree they lie in: ``malicious``, ``benign`` or neither."""
    value = label if label is not None else {"malicious": 1, "benign": 0}.get(kind)
    tier = {1: "code", 0: "benign"}.get(value, "unknown")
    return samples.withColumns({"label": F.lit(value).cast("int"), "tier": F.lit(tier), "classification": F.lit({1: "malicious corpus", 0: "benign corpus"}.get(value, ""))})


def tier_filter(samples: DataFrame, include: str | list[str] | None = None, exclude: str | list[str] | None = None) -> DataFrame:
    names = lambda v: [s.strip().lower() for s in (v.split(",") if isinstance(v, str) else v) if s.strip()]
    if include:
        samples = samples.where(F.col("tier").isin(names(include)))
    if exclude:
        samples = samples.where(~F.col("tier").isin(names(exclude)))
    return samples


def corpus_order() -> Column:
    """Ids and versions as people sort them, case aside."""
    return F.collate(F.concat("id", "version"), "UNICODE")


def latest_only(samples: DataFrame) -> DataFrame:
    """Of each id (case aside) the greatest version; equal versions keep the first in corpus order."""
    order = Window.partitionBy(F.lower("id")).orderBy(version_order(F.col("version")).desc(), corpus_order(), F.concat("id", "version"))
    return samples.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def select(samples: DataFrame, include=None, exclude=None, latest: bool = False, limit: int | None = None) -> DataFrame:
    """Tier filters, then latest-only, then order and limit."""
    chosen = tier_filter(samples, include, exclude)
    if latest:
        chosen = latest_only(chosen)
    if latest or limit:
        chosen = chosen.orderBy(F.collate("id", "UNICODE") if latest else corpus_order(), F.concat("id", "version"))
    return chosen.limit(limit) if limit else chosen


def pending(todo: DataFrame, done: DataFrame) -> DataFrame:
    """Resume: what the sink doesn't hold yet."""
    return todo.join(done.select("key").distinct(), "key", "left_anti")


def discovery_stats(samples: DataFrame, chosen: DataFrame, metadata: dict[str, DataFrame] | None = None) -> DataFrame:
    """``(stat, name, n)``: how many were found, chosen and left out by the filters, counts by tier and classification, and rows of metadata."""
    n = F.count("*").alias("n")
    kind = F.when(F.col("is_dir"), "folders").otherwise("archives")
    classification = F.coalesce(F.nullif("classification", F.lit("")), F.lit("(none)"))
    one = lambda rows, stat, name="all": rows.agg(n).select(F.lit(stat).alias("stat"), F.lit(name).alias("name"), "n")
    left_out = samples.select(F.lit(1).alias("x")).unionAll(chosen.select(F.lit(-1).alias("x"))).agg(F.coalesce(F.sum("x"), F.lit(0)).alias("n"))
    parts = [
        samples.groupBy(F.lit("found").alias("stat"), kind.alias("name")).agg(n),
        one(chosen, "selected"),
        left_out.select(F.lit("excluded_by_tier").alias("stat"), F.lit("all").alias("name"), "n"),
        chosen.groupBy(F.lit("tier").alias("stat"), F.col("tier").alias("name")).agg(n),
        chosen.groupBy(F.lit("classification").alias("stat"), classification.alias("name")).agg(n),
        *(one(rows, "metadata_rows", name) for name, rows in (metadata or {}).items()),
    ]
    return reduce(DataFrame.unionByName, parts)
