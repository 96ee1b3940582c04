"""A training corpus from raw documents, in five stages, each written and read again.

Every stage takes what its predecessor kept and uses the operators' production
parameters. All but the last return the columns of ``documents``. Rows with a null id
are judged, cleaned of lines and benchmark items, and packed as all others; only the near-copy stage
can't name them and leaves them. Null texts stay null; empty tables give empty results.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm.common import shared_folder, table
from trawl.llm.decontaminate import clean
from trawl.llm.linededup import dedup_lines
from trawl.llm.nearcopies import without_near_copies
from trawl.llm.packing import pack
from trawl.llm.quality import judge


def with_text(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of ``documents``, the character count that of the text as it now is."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*columns) if "n_chars" in columns else docs.select(*columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity exceeds their language's cut go."""
    return judge(docs, table(spark, sf_dir, "labels")).where("kept").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line repeats go; documents stay, if need be with an empty text."""
    return with_text(dedup_lines(docs), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies (five words, similarity 0.8) stays; so do rows without an id."""
    return without_near_copies(docs).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document in a training sequence."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("simhash", near_dedup),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

#: The stages train models and compare fingerprints; SQL can't express them (see tests/llm/test_pipeline.py).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
