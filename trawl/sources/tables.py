"""Text tables in and out: CSV with quoted fields, JSON lines, reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.schemas import RESULTS, RESULTS_TEXT


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All text; missing fields are empty, never null; records of one field are dropped; an unreadable path gives no rows.

    The header is matched by name, so columns may come in any order.
    """
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").option("columnPruning", False)
    wanted = spark.createDataFrame([], schema).columns
    try:
        header = reader.csv(path).columns
    except AnalysisException:
        return spark.createDataFrame([], schema)
    names = {c.strip(): f"_{i}" for i, c in enumerate(header)}
    found = reader.schema(", ".join([*(f"_{i} string" for i in range(len(header))), "_raw string"])).option("columnNameOfCorruptRecord", "_raw").csv(path)
    if len(header) > 1:  # a record short of fields keeps its raw text; without a comma outside quotes it has one field
        found = found.where(F.coalesce(*(F.col(f"_{i}") for i in range(1, len(header)))).isNotNull() | F.col("_raw").isNull() | F.regexp_replace("_raw", '"[^"]*"', "").contains(","))
    return found.select(*(F.coalesce(names[c], F.lit("")).alias(c) if c in names else F.lit("").alias(c) for c in wanted))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A results file with its types; an empty label stays null."""
    kinds = dict(x.split(" ") for x in RESULTS.split(", "))
    rows = read_csv(spark, path, RESULTS_TEXT)
    return rows.select(*(F.expr(f"try_cast(nullif({c}, '') AS {kinds[c]})").alias(c) if kinds[c] != "string" else F.col(c) for c in rows.columns))


def write_csv(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def write_json(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "overwrite").json(path)


def read_reports(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file; a broken one gives a row of nulls."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def write_reports(rows: DataFrame, path: str, key: str) -> None:
    """A folder for each sample, named safely."""
    from trawl.functions.text import safe_name

    rows.withColumn("sample_folder", safe_name(F.col(key))).write.mode("overwrite").partitionBy("sample_folder").json(path)


def metrics_markdown(matrix: DataFrame) -> DataFrame:
    """``(rule, line)``: one Markdown line for each row of a confusion matrix."""
    share = lambda c: F.concat(F.format_number(F.col(c) * 100, 1), F.lit("%"))
    line = F.concat_ws(" · ", *(F.concat(F.lit(f"{n} **"), share(c), F.lit("**")) for n, c in (("Precision", "precision"), ("Recall", "recall"), ("F1", "f1"), ("Accuracy", "accuracy"))), F.concat(F.lit("MCC **"), F.format_number("mcc", 3), F.lit("**")), F.concat(F.lit("n = "), F.col("total").cast("string")))
    return matrix.select("rule", line.alias("line"))
