"""Static and dynamic evidence together: final verdict, forensics, result rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.functions import rules
from trawl.functions.text import clip, families, hit
from trawl.operators.numbering import first_rows
from trawl.schemas import REASON, RESULT_COLUMNS, RESULTS


def rank_of(verdict: str) -> Column:
    return F.greatest(F.array_position(F.array(*map(F.lit, rules.VERDICTS)), F.col(verdict)).cast("int") - 1, F.lit(0))


def fuse(static: DataFrame, dynamic: DataFrame) -> DataFrame:
    """Both with ``(sample_key, verdict, score, reasons)``; either may lack a sample.

    The stronger verdict holds. Two suspicions of the same indicator family confirm each other.
    """
    side = lambda df, p: df.select("sample_key", F.col("verdict").alias(f"{p}_verdict"), F.col("score").cast("int").alias(f"{p}_score"), F.col("reasons").cast(f"array<{REASON}>").alias(f"{p}_reasons"))
    none = F.array().cast(f"array<{REASON}>")
    both = side(static, "static").join(side(dynamic, "dynamic"), "sample_key", "full")
    both = both.withColumns({f"{p}_{c}": F.coalesce(f"{p}_{c}", v) for p in ("static", "dynamic") for c, v in (("verdict", F.lit("BENIGN")), ("score", F.lit(0)), ("reasons", none))})
    s, d = rank_of("static_verdict"), rank_of("dynamic_verdict")
    of = lambda p: families(F.transform(f"{p}_reasons", lambda r: r["reason"]))
    both = both.withColumn("corroborated", F.array_intersect(of("static"), of("dynamic")))
    escalated = (F.greatest(s, d) == 1) & (F.size("corroborated") > 0)
    final = F.when(escalated, 2).otherwise(F.greatest(s, d))
    tagged = lambda p: F.transform(f"{p}_reasons", lambda r: F.struct(F.lit(p).alias("source"), r["points"].alias("points"), r["reason"].alias("reason")))
    confirm = F.struct(F.lit("corroboration").alias("source"), F.lit(0).alias("points"), F.concat(F.lit("static and dynamic independently confirm the same indicator ("), F.array_join("corroborated", ", "), F.lit(")")).alias("reason"))
    reasons = F.concat(F.when(escalated, F.array(confirm)).otherwise(F.array().cast("array<struct<source:string,points:int,reason:string>>")), tagged("static"), tagged("dynamic"))
    return both.withColumns({
        "final_verdict": F.element_at(F.array(*map(F.lit, rules.VERDICTS)), final + 1), "final_is_malicious": (final == 2).cast("int"), "final_is_flagged": (final >= 1).cast("int"), "score": F.greatest("static_score", "dynamic_score"),
        "decided_by": F.when(escalated, "corroboration").when(s > d, "static").when(d > s, "dynamic").otherwise("both"), "reasons": reasons,
    }).drop("static_reasons", "dynamic_reasons")


def fuse_with(engine: Callable[[DataFrame, DataFrame], DataFrame] | None, static: DataFrame, dynamic: DataFrame) -> DataFrame:
    """The same with another verdict engine in its place."""
    return (engine or fuse)(static, dynamic)


def behaviours(seen: DataFrame, invisible: DataFrame | None = None, static: DataFrame | None = None) -> DataFrame:
    """``(sample_key, title, technique)`` for each behaviour that the observations show.

    With ``static(sample_key, reasons)``, a sample that shows none, or wasn't observed at all, but has reasons, is told apart from a clean one.
    """
    c, cmds = F.col, F.col("commands")
    if static is not None:
        seen = seen.join(static.select("sample_key", (F.size("reasons") > 0).alias("_static")), "sample_key", "full")
        flags = ["any_process", "has_socket", "binary_url", "data_stolen", "sends_off_box", "recon"]
        seen = seen.withColumns({f: F.coalesce(f, F.lit(False)) for f in [*flags, "_static"]} | {f: F.coalesce(f, F.lit(0)) for f in ("crypto_decrypt_calls", "eval_calls")} | {"commands": F.coalesce("commands", F.lit(""))})
    if invisible is not None:
        seen = seen.join(invisible, "sample_key", "left")
    hidden = F.coalesce(c("invisible_total") > 8, F.lit(False)) if invisible is not None else F.lit(False)
    cradle = hit(cmds, r"(?i)(powershell|cmd\.exe|certutil|bitsadmin|curl|wget|invoke-webrequest)") & hit(cmds, r"(?i)(https?://|\.bat|\.ps1|\.exe|catbox|pastebin)")
    cases = [
        (c("any_process") & cradle, *rules.BEHAVIOURS["cradle"]), (c("any_process") & ~cradle, *rules.BEHAVIOURS["process"]),
        (c("has_socket") & c("any_process"), *rules.BEHAVIOURS["shell"]), (c("has_socket") & ~c("any_process"), *rules.BEHAVIOURS["socket"]),
        (c("binary_url"), *rules.BEHAVIOURS["binary"]), (c("data_stolen"), *rules.BEHAVIOURS["stolen"]),
        (c("sends_off_box") & ~c("data_stolen") & c("recon"), *rules.BEHAVIOURS["recon"]), (c("sends_off_box") & ~c("data_stolen") & ~c("recon"), *rules.BEHAVIOURS["sent"]),
        (c("crypto_decrypt_calls") > 0, *rules.BEHAVIOURS["decrypts"]), (c("eval_calls") > 0, *rules.BEHAVIOURS["evaluates"]), (hidden, *rules.BEHAVIOURS["hidden"]),
    ]
    told = F.filter(F.array(*(F.when(k, F.struct(F.lit(t).alias("title"), F.lit(m).alias("technique"))) for k, t, m in cases)), lambda b: b.isNotNull())
    alone = lambda title, technique: F.array(F.struct(F.lit(title).alias("title"), F.lit(technique).alias("technique")))
    none = alone(*rules.BEHAVIOURS["none"])
    if static is not None:
        none = F.when(c("_static"), alone(*rules.BEHAVIOURS["static"])).otherwise(none)
    return seen.select("sample_key", F.explode(F.when(F.size(told) > 0, told).otherwise(none)).alias("b")).select("sample_key", "b.title", "b.technique")


def iocs(seen: DataFrame, flows: DataFrame | None = None, most: int = 50) -> DataFrame:
    """``(sample_key, hosts, shell_commands, exfil_categories, taint_flows, outbound_count)``; each list has its first ``most`` entries, and beside a cut one ``_truncated_from`` tells how many there were."""
    if flows is not None:  # (sample_key, send_seq, category, path, destination, confirmed) of ``taint.adjudicate``
        told = F.struct("send_seq", F.concat(F.col("category"), F.lit(": "), F.col("path"), F.lit(" → "), F.col("destination")).alias("flow"))
        of_flows = flows.where("confirmed").groupBy("sample_key").agg(F.transform(F.array_sort(F.collect_list(told)), lambda x: x["flow"]).alias("taint_flows"))
        seen = seen.join(of_flows, "sample_key", "left")
    else:
        seen = seen.withColumn("taint_flows", F.lit(None).cast("array<string>"))
    lists = {"hosts": F.col("hosts"), "shell_commands": F.col("shell_commands_attempted"), "exfil_categories": F.col("categories"), "taint_flows": F.coalesce("taint_flows", F.array().cast("array<string>"))}
    cuts = [x for name, v in lists.items() for x in (F.slice(v, 1, most).alias(name), F.when(F.size(v) > most, F.size(v)).alias(f"{name}_truncated_from"))]
    return seen.select("sample_key", *cuts, F.col("outbound_messages").alias("outbound_count"))


def prompt_digest(fused: DataFrame, seen: DataFrame, intel: DataFrame, beacons: DataFrame, most: int = 30) -> DataFrame:
    """``(sample_key, digest)``: the evidence as one short JSON text, for a reader with little room; every list is cut."""
    sent = F.struct("seq", F.struct(F.coalesce(F.nullif("host", F.lit("")), "destination").alias("to"), "method", clip(F.coalesce(F.nullif("decoded", F.lit("")), "body", F.lit("")), 200).alias("body")).alias("m"))
    first = first_rows(beacons, ["seq"], most).groupBy("sample_key").agg(F.transform(F.array_sort(F.collect_list(sent)), lambda x: x["m"]).alias("outbound"))
    rows = fused.join(seen.select("sample_key", *(F.col(c) for c in ("total_events", "http_requests", "child_process_calls", "eval_calls", "hosts", "shell_commands_attempted", "categories"))), "sample_key", "left").join(intel.select("sample_key", "purpose"), "sample_key", "left").join(first, "sample_key", "left")
    number, some = lambda c: F.coalesce(c, F.lit(0)), lambda c: F.slice(F.coalesce(c, F.array()), 1, most)
    static = F.filter("reasons", lambda r: r["source"] == "static")
    of_static = F.struct(F.col("static_verdict").alias("verdict"), F.col("static_score").alias("score"), F.transform(F.slice(static, 1, most), lambda r: r["reason"]).alias("iocs"))
    of_dynamic = F.struct(
        F.col("dynamic_verdict").alias("verdict"), F.col("dynamic_score").alias("score"), "purpose", number("total_events").alias("events"), number("http_requests").alias("http"), number("child_process_calls").alias("exec"), number("eval_calls").alias("eval"),
        some("hosts").alias("hosts"), some("shell_commands_attempted").alias("commands"), F.coalesce("outbound", F.array()).alias("outbound"), some("categories").alias("stolen"),
    )
    return rows.select("sample_key", F.to_json(F.struct(F.col("sample_key").alias("sample"), of_static.alias("static"), of_dynamic.alias("dynamic"))).alias("digest"))


def top_reasons(reasons: Column, most: int = 4, cut: int = 400) -> Column:
    """The first reasons as one line."""
    shown = F.transform(F.slice(reasons, 1, most), lambda r: F.concat(r["source"], F.lit(":+"), r["points"].cast("string"), F.lit(" "), r["reason"]))
    return F.substring(F.array_join(shown, " ; "), 1, cut)


def result_rows(samples: DataFrame, fused: DataFrame, seen: DataFrame, intel: DataFrame, timers: DataFrame | None = None) -> DataFrame:
    """The flat rows of a corpus: every sample, with blanks, zeros and BENIGN for what it lacks."""
    summary = ["total_events", "http_requests", "child_process_calls", "outbound_messages", "eval_calls", "fs_reads", "net_socket_calls"]
    of_seen = seen.select("sample_key", *summary, F.col("data_stolen").cast("int").alias("data_stolen"), F.array_join("categories", "|").alias("stolen_categories"), F.array_join(F.slice("hosts", 1, 5), "|").alias("hosts"))
    rows = samples.withColumnRenamed("key", "sample_key").join(fused.withColumn("top_reasons", top_reasons(F.col("reasons"))), "sample_key", "left").join(of_seen, "sample_key", "left").join(intel.select("sample_key", "purpose"), "sample_key", "left")
    if timers is not None:  # (sample_key, timers_fired, virtual_ms)
        rows = rows.join(timers, "sample_key", "left").withColumn("virtual_days", F.round(F.col("virtual_ms") / 86_400_000, 2))
    rows = rows.withColumn("sample", F.col("id"))
    kinds = dict(x.split(" ") for x in RESULTS.split(", "))
    blank = lambda c: F.lit("BENIGN") if c.endswith("verdict") else F.lit("") if kinds[c] == "string" else F.lit(0)
    value = lambda c: F.col(c).cast(kinds[c]) if c == "label" else F.coalesce(F.col(c) if c in rows.columns else F.lit(None), blank(c)).cast(kinds[c])
    return rows.select(*(value(c).alias(c) for c in RESULT_COLUMNS))


def error_rows(failed: DataFrame) -> DataFrame:
    """``failed`` samples with ``error``: all blank but for what they are, the verdict ERROR."""
    kinds = dict(x.split(" ") for x in RESULTS.split(", "))
    known = {"dataset", "id", "version", "label", "tier", "classification", "target"}
    fixed = {"sample": F.col("id"), "final_verdict": F.lit("ERROR"), "final_is_malicious": F.lit(0), "final_is_flagged": F.lit(0), "score": F.lit(0), "error": F.substring("error", 1, 300)}
    value = lambda c: fixed[c] if c in fixed else F.col(c) if c in known else F.lit("") if kinds[c] == "string" else F.lit(None)
    return failed.select(*(value(c).cast(kinds[c]).alias(c) for c in RESULT_COLUMNS))


def evidence_digest(fused: DataFrame, seen: DataFrame, intel: DataFrame, found: DataFrame) -> DataFrame:
    """One nested record for each sample, its lists cut so that a record stays small."""
    iocs = found.groupBy("sample_key").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("points")).alias("p"), "reason"))), 1, 30).alias("static_iocs"))
    rows = fused.join(seen.select("sample_key", "total_events", "outbound_messages", F.slice("hosts", 1, 30).alias("hosts"), "data_stolen", "categories", "suspected"), "sample_key", "left").join(intel, "sample_key", "left").join(iocs, "sample_key", "left")
    return rows.select(
        "sample_key", F.struct(F.col("final_verdict").alias("final"), F.col("final_is_malicious").alias("is_malicious"), "score", "decided_by", "corroborated", F.slice("reasons", 1, 20).alias("reasons")).alias("verdict"),
        F.transform("static_iocs", lambda f: F.struct((-f["p"]).alias("points"), f["reason"].alias("reason"))).alias("static_iocs"), F.struct("purpose", F.slice("actions", 1, 20).alias("actions"), "data_targeted", "c2_indicators").alias("intel"),
        F.struct("data_stolen", "categories", "suspected").alias("stolen"), "hosts", F.struct("total_events", "outbound_messages").alias("summary"),
    )
