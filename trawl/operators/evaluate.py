"""Confusion matrices, breakdowns and root causes over result rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.functions import rules

RULES = {"strict": "final_is_malicious", "triage": "final_is_flagged"}


def label_of(compat: bool = False) -> Column:
    """The label as 0, 1 or null; ``compat`` reads an empty label as 0."""
    text = F.trim(F.col("label").cast("string"))
    blank = F.lit(0.0) if compat else F.lit(None).cast("double")
    return F.when(F.coalesce(text, F.lit("")) == "", blank).otherwise(F.expr("try_cast(trim(cast(label as string)) as double)"))


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, 0 where b is."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / F.when(b == 0, F.lit(1)).otherwise(b))


def metrics(counts: DataFrame) -> DataFrame:
    """Adds precision, recall, f1, accuracy and Matthews correlation to ``tp, fp, fn, tn``."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    scored = counts.withColumns({"total": F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)})
    both = F.col("precision") + F.col("recall")
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return scored.withColumns({"f1": ratio(2 * F.col("precision") * F.col("recall"), both), "accuracy": ratio(tp + tn, F.col("total")), "mcc": ratio(tp * tn - fp * fn, root)})


def matrix_counts(rows: DataFrame, by: list[str] | None = None, compat: bool = False) -> DataFrame:
    """``(by, rule, tp, fp, fn, tn, errors)``: both rules from one pass over ``rows(label, final_verdict, final_is_*)``. Counts of disjoint rows add up (``merged``)."""
    by = by or []
    pairs = F.array(*(F.struct(F.lit(name).alias("rule"), (F.coalesce(F.col(c).cast("int"), F.lit(0)) != 0).alias("p")) for name, c in RULES.items()))
    known = rows.withColumn("y", label_of(compat)).where("y IN (0, 1)")
    long = known.select(*by, "y", "final_verdict", F.explode(pairs).alias("r")).select(*by, "y", "final_verdict", "r.rule", "r.p")
    y = F.col("y") == 1
    return long.groupBy(*by, "rule").agg(
        F.count_if(y & F.col("p")).alias("tp"), F.count_if(~y & F.col("p")).alias("fp"), F.count_if(y & ~F.col("p")).alias("fn"), F.count_if(~y & ~F.col("p")).alias("tn"), F.count_if(F.col("final_verdict") == "ERROR").alias("errors")
    )


def merged(parts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The matrix of a whole run from the counts of its batches, as ``confusion`` gives it from the rows: a run that is resumed reads no earlier row again."""
    return metrics(parts.groupBy(*(by or []), "rule").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn", "errors"))))


def confusion(rows: DataFrame, by: list[str] | None = None, compat: bool = False) -> DataFrame:
    """A row for each rule (and group): counts and what follows from them."""
    return metrics(matrix_counts(rows, by, compat))


def evaluate(rows: DataFrame, predicted: str = "final_is_malicious", compat: bool = False) -> DataFrame:
    """One row: the matrix and how many rows have no label of 0 or 1."""
    y, p = label_of(compat), F.coalesce(F.col(predicted).cast("int"), F.lit(0)) != 0
    one, zero = F.coalesce(y == 1, F.lit(False)), F.coalesce(y == 0, F.lit(False))
    counts = rows.agg(F.count_if(one & p).alias("tp"), F.count_if(zero & p).alias("fp"), F.count_if(one & ~p).alias("fn"), F.count_if(zero & ~p).alias("tn"), F.count_if(~one & ~zero).alias("skipped"))
    return metrics(counts).drop("mcc")


def verdict_counts() -> list[Column]:
    v = F.col("final_verdict")
    return [F.count("*").alias("n"), F.count_if(v == "MALICIOUS").alias("malicious"), F.count_if(v.isin("MALICIOUS", "SUSPICIOUS")).alias("flagged")]


def tier_breakdown(rows: DataFrame) -> DataFrame:
    v = F.coalesce(F.col("final_verdict"), F.lit(""))
    tier = F.coalesce(F.nullif("tier", F.lit("")), F.lit("unknown")).alias("tier")
    return rows.groupBy(tier).agg(*verdict_counts(), F.count_if(~v.isin("MALICIOUS", "SUSPICIOUS", "ERROR")).alias("benign"), F.count_if(v == "ERROR").alias("error"))


def class_breakdown(rows: DataFrame) -> DataFrame:
    name = F.coalesce(F.nullif("classification", F.lit("")), F.lit("(none)")).alias("classification")
    counts = rows.groupBy(name).agg(*verdict_counts())
    return counts.withColumns({"strict_rate": ratio(F.col("malicious"), F.col("n")), "triage_rate": ratio(F.col("flagged"), F.col("n"))}).orderBy(F.desc("n"), "classification")


def section_report(rows: DataFrame, sections: dict[str, Column]) -> DataFrame:
    """Overlapping populations in one pass: every row goes to each section whose condition holds."""
    names = F.array(*(F.when(c, F.lit(s)) for s, c in sections.items()))
    in_section = rows.withColumn("section", F.explode(F.filter(names, lambda s: s.isNotNull())))
    y = label_of()
    sizes = in_section.groupBy("section").agg(F.count("*").alias("n"), F.count_if(y == 1).alias("positives"), F.count_if(y == 0).alias("negatives"))
    return sizes.join(confusion(in_section, ["section"]), "section")


def chain(cases: list[tuple[Column, str]], otherwise: str) -> Column:
    first, *rest = cases
    return reduce(lambda c, case: c.when(case[0], F.lit(case[1])), rest, F.when(first[0], F.lit(first[1]))).otherwise(otherwise)


def missed_cause() -> Column:
    """Why a positive was not called malicious; the first that holds."""
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))
    flagged = F.coalesce(F.col("static_verdict"), F.lit("BENIGN")).isin("SUSPICIOUS", "MALICIOUS")
    events, verdict = number("total_events"), F.coalesce(F.col("final_verdict"), F.lit(""))
    cases = [
        (verdict == "ERROR", "ANALYSIS_ERROR"),
        (number("timed_out") == 1, "TIMEOUT"),
        (F.coalesce(F.col("tier") == "policy", F.lit(False)), "OUT_OF_SCOPE_POLICY_REMOVAL"),
        (F.coalesce(F.col("tier") == "suspect", F.lit(False)), "OUT_OF_SCOPE_UNTRUSTWORTHY"),
        (verdict == "SUSPICIOUS", "BELOW_MALICIOUS_THRESHOLD"),
        ((events == 0) & ~flagged, "DORMANT_NO_OBSERVABLE_PAYLOAD"),
        ((events == 0) & flagged, "GATED_STATIC_ONLY"),
        ((number("http_requests") > 0) & (number("child_process_calls") == 0) & (number("data_stolen") == 0), "NETWORK_ONLY_INDISTINGUISHABLE"),
        ((number("timers_fired") == 0) & (events > 0), "RAN_BUT_UNRECOGNISED"),
    ]
    return chain(cases, "UNRECOGNISED_BEHAVIOUR")


def false_alarm_cause() -> Column:
    reasons = F.coalesce(F.col("top_reasons"), F.lit(""))
    return chain([(reasons.rlike(p), c) for p, c in rules.FALSE_ALARMS], "RULE_OVERMATCH")


def root_causes(rows: DataFrame, predicted: str = "final_is_malicious") -> DataFrame:
    """``(kind, cause, n)`` for false negatives and false positives."""
    y, p = label_of(), F.coalesce(F.col(predicted).cast("int"), F.lit(0)) != 0
    kind = F.when((y == 1) & ~p, "FN").when((y == 0) & p, "FP")
    told = rows.select(kind.alias("kind"), F.when(y == 1, missed_cause()).otherwise(false_alarm_cause()).alias("cause"))
    return told.where("kind IS NOT NULL").groupBy("kind", "cause").agg(F.count("*").alias("n")).orderBy("kind", F.desc("n"), "cause")


def cause_listing(rows: DataFrame, most: int = 120) -> DataFrame:
    """The report's listing: false negatives by cause with the first ``most`` ids of each."""
    from pyspark.sql import Window

    y, p = label_of(), F.coalesce(F.col("final_is_malicious").cast("int"), F.lit(0)) != 0
    missed = rows.where((y == 1) & ~p).withColumn("cause", missed_cause())
    rank = F.row_number().over(Window.partitionBy("cause").orderBy("id", "version", "target"))
    return missed.withColumn("rank", rank).where(F.col("rank") <= most).select("cause", "rank", "id", "version", "tier", "score")


def alarm_listing(rows: DataFrame) -> DataFrame:
    """The report's false positives, every one by its cause."""
    y, p = label_of(), F.coalesce(F.col("final_is_malicious").cast("int"), F.lit(0)) != 0
    return rows.where((y == 0) & p).select(false_alarm_cause().alias("cause"), "id", "version", "score", "decided_by", F.substring(F.coalesce("top_reasons", F.lit("")), 1, 300).alias("reasons"))


def error_listing(rows: DataFrame, most: int = 100) -> DataFrame:
    """The report's analyses that failed: the first ``most`` ids with their errors."""
    return rows.where("final_verdict = 'ERROR'").orderBy("id", "version", "target").limit(most).select("id", "version", "error")


def misjudged(rows: DataFrame) -> DataFrame:
    """One row ``(false_positives, false_negatives, errors)``; a failed analysis of a positive is a miss too."""
    y, p = label_of(), F.coalesce(F.col("final_is_malicious").cast("int"), F.lit(0)) != 0
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return rows.agg(count((y == 0) & p).alias("false_positives"), count((y == 1) & ~p).alias("false_negatives"), count(F.col("final_verdict") == "ERROR").alias("errors"))


def cause_report(rows: DataFrame, most: int = 120) -> DataFrame:
    """``(part, cause, n, position, line)``: the report on every misjudged sample, part by part, causes by their number; lists of misses are cut, their counts aren't."""
    numbers = root_causes(rows)
    name = F.concat(F.lit("- **"), F.col("id"), F.lit("** v"), F.coalesce("version", F.lit("")))
    alarms = alarm_listing(rows).select(F.lit("FP").alias("kind"), "cause", "id", F.concat(name, F.lit(" — score "), F.col("score").cast("string"), F.lit(", decided by "), F.coalesce("decided_by", F.lit("")), F.when(F.col("reasons") != "", F.concat(F.lit("; "), F.col("reasons"))).otherwise("")).alias("line"))
    misses = cause_listing(rows, most).select(F.lit("FN").alias("kind"), "cause", "id", F.concat(name, F.lit(" (tier "), F.coalesce("tier", F.lit("?")), F.lit(", score "), F.col("score").cast("string"), F.lit(")")).alias("line"))
    errors = error_listing(rows).select(F.lit("ERROR").alias("kind"), F.lit("ANALYSIS_ERROR").alias("cause"), "id", F.concat(name, F.lit(" — "), F.coalesce("error", F.lit(""))).alias("line"))
    failed = rows.where("final_verdict = 'ERROR'").agg(F.count("*").alias("n")).where("n > 0").select(F.lit("ERROR").alias("kind"), F.lit("ANALYSIS_ERROR").alias("cause"), "n")
    counted = numbers.unionByName(failed)
    return alarms.unionByName(misses).unionByName(errors).join(F.broadcast(counted), ["kind", "cause"]).select(F.col("kind").alias("part"), "cause", "n", "id", "line")  # a row for each cause


def metrics_report(rows: DataFrame, sections: dict[str, Column]) -> DataFrame:
    """``(section, report)``: of each section one JSON text with its size, both matrices, and its verdicts by tier and by classification."""
    names = F.array(*(F.when(c, F.lit(s)) for s, c in sections.items()))
    inside = rows.withColumn("section", F.explode(F.filter(names, lambda s: s.isNotNull())))
    y, v = label_of(), F.coalesce(F.col("final_verdict"), F.lit(""))
    sizes = inside.groupBy("section").agg(F.count("*").alias("n"), F.count_if(y == 1).alias("positives"), F.count_if(y == 0).alias("negatives"))
    matrix = confusion(inside, ["section"]).drop("errors")
    kept = [c for c in matrix.columns if c not in ("section", "rule")]
    pick = lambda rule: F.max(F.when(F.col("rule") == rule, F.struct(*kept))).alias(rule)
    matrices = matrix.groupBy("section").agg(*map(pick, RULES))

    def by(column: str, blank: str) -> DataFrame:
        name = F.coalesce(F.nullif(column, F.lit("")), F.lit(blank)).alias("name")
        each = inside.groupBy("section", name).agg(*verdict_counts(), F.count_if(v == "ERROR").alias("error"))
        return each.groupBy("section").agg(F.array_sort(F.collect_list(F.struct("name", "n", "malicious", "flagged", "error"))).alias(column))

    whole = sizes.join(matrices, "section", "left").join(by("tier", "unknown"), "section").join(by("classification", "(none)"), "section")
    return whole.select("section", F.to_json(F.struct("section", "n", "positives", "negatives", *RULES, F.col("tier").alias("tiers"), F.col("classification").alias("classes"))).alias("report"))


def count_by(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))
