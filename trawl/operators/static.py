"""Static indicators over file contents: findings, and a verdict in two tiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.functions import rules
from trawl.functions.rules import Rule
from trawl.functions.text import ENCODED, ESCAPED, INVISIBLE, STRING, any_hit, deobfuscate, expand_script_vars, gated_hit, has_untrusted_binary, hit, invisible_count, is_cradle, may_hit
from trawl.operators.numbering import running
from trawl.session import written_once

SCRIPTS, JS = r"(?i)\.(?:bat|cmd|ps1|sh)$", r"(?i)\.(?:js|cjs|mjs)$"
QUOTED = f"({STRING})"
#: A file in a dependency, at most ``MAX_DEPENDENCY_DEPTH`` folders down.
DEPENDENCY = rf"(^|/)node_modules/(?:[^/]+/){{0,{rules.MAX_DEPENDENCY_DEPTH}}}[^/]+$"


def within_budget(files: DataFrame, names: Sequence[str] = tuple(rules.OWN_REPORTS), max_files: int = rules.MAX_FILES, max_bytes: int = rules.MAX_TOTAL_BYTES) -> DataFrame:
    """The files that a scan reads: text by extension, not too large or deep, until a sample's budget is used up, in path order."""
    name = F.element_at(F.split("path", "/"), -1)
    depth = F.size(F.split("path", "/")) - 1
    fit = files.where(name.rlike(rules.TEXT_EXTENSION) & ~name.isin(*names) & (F.col("size") <= rules.MAX_FILE_BYTES) & (depth <= rules.MAX_DEPTH) & ~F.col("path").rlike(r"(^|/)\.git/"))
    spent = running(fit, ["path"], {"_n": F.lit(1), "_b": F.col("size")})
    return spent.where((F.col("_n") <= max_files) & (F.col("_b") - F.col("size") < max_bytes)).drop("_n", "_b")


def within_dependency_budget(files: DataFrame, most: int = rules.MAX_DEPENDENCY_FILES) -> DataFrame:
    """``files`` less the small scripts of dependencies beyond the first ``most`` of a sample, in path order: a dependency scan reads no more."""
    counted = F.col("path").rlike(DEPENDENCY) & F.col("path").rlike(JS) & (F.col("size") <= rules.MAX_DEPENDENCY_BYTES)
    scripts = files.where(counted)
    kept = running(scripts, ["path"], {"_n": F.lit(1)}).where(F.col("_n") <= most).drop("_n")
    return files.where(~F.coalesce(counted, F.lit(False))).unionByName(kept)


def scanned(files: DataFrame, pack: Sequence[Rule] = tuple(rules.TEXT_RULES), hidden: bool = False) -> DataFrame:
    """``files(sample_key, path, content)`` to ``(sample_key, path, _found)``: of each file that may meet a rule, what it meets; with ``hidden`` also ``_invisible``, the number of its invisible code points.

    The rules are folded into one array of tests per file, so a file is read once and no join is needed.
    One scan for all patterns comes first: files that none can match, nor anything decoded from them, are not tried rule by rule.
    With ``hidden`` it lets through what holds invisible code points, too; a file that is left out has none.
    """
    path, text, raw, full, low = F.col("path"), F.col("text"), F.col("content"), F.col("expanded"), F.col("low")
    app = ~path.rlike(r"(^|/)node_modules/")
    script = path.rlike(SCRIPTS)
    seen = lambda p: gated_hit(text, low, p)
    count = lambda patterns: sum((seen(p).cast("int") for p in patterns), F.lit(0))
    quoted = F.regexp_extract_all(text, F.lit(QUOTED))
    commands = F.when(script, F.concat(quoted, F.split(text, r"\r?\n"))).otherwise(quoted)
    commands = F.when(may_hit(low, rules.LOLBIN) & may_hit(low, rules.PAYLOAD), F.filter(commands, is_cradle))
    shared = {"ids": count(rules.RECON_IDENTITY), "others": count(rules.RECON_SYSTEM + rules.RECON_NETWORK), "runs": seen(rules.EXEC), "cradles": commands, "untrusted": has_untrusted_binary(text, low)}
    ids, every, runs, cradles = F.col("ids"), F.col("ids") + F.col("others"), F.col("runs"), F.col("cradles")
    found = lambda condition, points, reason, tier="primary", detail=None: F.when(condition, F.struct(F.lit(points).alias("points"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"), (F.lit(None) if detail is None else F.substring(detail, 1, 220)).cast("string").alias("detail"), F.lit(tier).alias("tier")))
    battery = F.concat(F.lit("host reconnaissance battery ("), every.cast("string"), F.lit(" enumeration commands incl. "), ids.cast("string"), F.lit(" account/privilege probe(s))"))
    tests = [found(seen(r.pattern) & (app if r.scope == "app" else F.lit(True)), r.points, r.reason, r.tier) for r in pack]
    tests += [
        found(F.col("untrusted"), 45, rules.COMBINED["binary"]),
        found(script & hit(full, rules.LOLBIN) & has_untrusted_binary(full) & hit(full, rules.SCRIPT_EXEC_VERB), 55, rules.CRADLE_REASON, detail=F.regexp_replace(full, r"\s+", " ")),
        found(script & hit(full, rules.ENCODED_COMMAND), 50, rules.ENCODED_REASON),
        found(app & (F.size(cradles) > 0), 55, rules.CRADLE_REASON, detail=F.try_element_at(cradles, F.lit(1))),
        found(app & (ids >= 1) & (every >= 3) & runs, 45, battery),
        found(app & runs & seen(rules.HIDDEN_WINDOW), 15, rules.COMBINED["hidden window"], "supporting"),
        found(app & runs & seen(rules.SOCKET) & seen(rules.SHELL_BINARY), 55, rules.COMBINED["shell"]),
        found(app & runs & seen(rules.DROP_TO_TEMP), 50, rules.COMBINED["dropper"]),
        found(app & raw.contains("_0x") & hit(raw, rules.OBFUSCATOR), 25, rules.COMBINED["decoder"], "supporting"),
        found(path.rlike(DEPENDENCY) & path.rlike(JS) & (F.length(raw) <= rules.MAX_DEPENDENCY_BYTES) & raw.contains("_0x") & hit(raw, r"_0x[a-f0-9]{4,}") & hit(text, r"(?i)child_process|powershell|cmd\.exe|curl|spawn|exec"), 45, rules.COMBINED["dependency"]),
    ]
    first = [*(r.pattern for r in pack), rules.REMOTE_BINARY, rules.LOLBIN, rules.EXEC, "_0x", ESCAPED, ENCODED, *([INVISIBLE] if hidden else [])]  # every test but those of scripts needs one of these
    likely = files.withColumn("_likely", script | any_hit(raw, first)).where("_likely").drop("_likely")
    shown = likely.withColumn("text", deobfuscate(F.col("content"))).withColumn("expanded", expand_script_vars(F.when(script, F.col("text"))))
    shown = shown.withColumn("low", F.lower("text")).select("*", *(v.alias(k) for k, v in shared.items()))  # each shared test once
    counted = [invisible_count(raw).alias("_invisible")] if hidden else []
    return shown.select("sample_key", "path", F.filter(F.array(*tests), lambda f: f.isNotNull()).alias("_found"), *counted)


def findings(files: DataFrame, pack: Sequence[Rule] = tuple(rules.TEXT_RULES)) -> DataFrame:
    """``files(sample_key, path, content)``, or what ``scanned`` has told of them, to ``(sample_key, points, reason, file, detail, tier)``, one for each rule a file meets."""
    rows = files if "_found" in files.columns else scanned(files, pack)
    told = rows.select("sample_key", "path", F.explode_outer("_found").alias("f")).where("f IS NOT NULL")  # outer: no second pass to filter empty arrays
    return told.select("sample_key", "f.points", "f.reason", F.col("path").alias("file"), "f.detail", "f.tier")


def invisible_findings(files: DataFrame) -> DataFrame:
    """One finding for each sample with more than six invisible code points; ``files`` as they are, or as ``scanned`` has told of them."""
    counted = files.where("_invisible > 0") if "_invisible" in files.columns else files.select("sample_key", invisible_count(F.col("content")).alias("_invisible"))
    total = counted.groupBy("sample_key").agg(F.sum("_invisible").alias("n")).where("n > 6")
    reason = F.concat(F.lit("invisible-Unicode encoding present ("), F.col("n").cast("string"), F.lit(" tag/variation-selector codepoints)"))
    return total.select("sample_key", F.lit(40).alias("points"), reason.alias("reason"), F.lit("").alias("file"), F.lit(None).cast("string").alias("detail"), F.lit("primary").alias("tier"))


def file_stats(files: DataFrame) -> DataFrame:
    code = ~F.col("path").rlike(r"(^|/)node_modules/") & F.col("path").rlike(r"(?i)\.(js|cjs|mjs|ts)$")
    return files.groupBy("sample_key").agg(
        F.count("*").alias("scanned_files"), F.sum("size").alias("scanned_bytes"), F.sum(invisible_count(F.col("content"))).alias("invisible_total"),
        F.sum(F.when(code, F.col("size")).otherwise(0)).alias("app_code_bytes"), F.bool_or(code & hit(F.col("content"), rules.REAL_LOGIC)).alias("has_real_logic"),
    )


def manifest_findings(manifests: DataFrame, stats: DataFrame) -> DataFrame:
    """``manifests(sample_key, name, displayName, description, main, activationEvents, scripts)`` with their sample's ``stats``."""
    m = manifests.join(stats, "sample_key", "left").withColumns({"app_code_bytes": F.coalesce("app_code_bytes", F.lit(0)), "has_real_logic": F.coalesce("has_real_logic", F.lit(False))})
    hook = F.try_element_at(F.filter(F.array(*map(F.lit, ("postinstall", "preinstall", "install"))), lambda k: hit(F.try_element_at("scripts", k), rules.INSTALL_SCRIPT)), F.lit(1))
    blurb = F.lower(F.concat_ws(" ", "displayName", "name", "description"))
    stub = ~F.col("has_real_logic") & (F.col("app_code_bytes") < 4000)
    kind = lambda points, reason, tier, detail=None: F.struct(F.lit(points).alias("points"), reason.alias("reason"), (F.lit(None) if detail is None else detail).cast("string").alias("detail"), F.lit(tier).alias("tier"))
    tests = F.array(
        F.when(hook.isNotNull(), kind(40, F.concat(F.lit("malicious "), hook, F.lit(" lifecycle script in package.json")), "primary", F.substring(F.try_element_at("scripts", hook), 1, 160))),
        F.when(F.coalesce(F.col("main") != "", F.lit(False)) & hit(blurb, rules.ADVERTISES) & stub & (F.col("app_code_bytes") > 0), kind(20, F.lit(rules.COMBINED["stub"]), "supporting")),
        F.when(F.coalesce(F.array_contains("activationEvents", "*"), F.lit(False)) & stub, kind(15, F.lit('activates on "*" (every start) despite shipping no real functionality'), "supporting")),
    )
    told = m.select("sample_key", F.explode(F.filter(tests, lambda f: f.isNotNull())).alias("f"))
    return told.select("sample_key", "f.points", "f.reason", F.lit("package.json").alias("file"), "f.detail", "f.tier")


def package_findings(files: DataFrame, manifests: DataFrame, pack: Sequence[Rule] = tuple(rules.TEXT_RULES)) -> DataFrame:
    """All that is found in a package: by its files' text and shapes, its invisible code points and its manifest."""
    from trawl.operators.shapes import shape_findings

    told = written_once(scanned(files, pack, hidden=True), "scanned")  # for rules and invisible code points alike
    parts = [findings(told, pack), shape_findings(files), invisible_findings(told), manifest_findings(manifests, file_stats(files))]
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    return every


def once(found: DataFrame) -> DataFrame:
    """A reason counts once for a sample: with its most points, in its first file."""
    best = F.max("points").alias("points"), F.min_by(F.struct("file", "detail", "tier"), F.struct(-F.col("points"), F.col("file"))).alias("f")
    return found.groupBy("sample_key", "reason").agg(*best).select("sample_key", "points", "reason", "f.file", "f.detail", "f.tier")


def static_verdict(found: DataFrame) -> DataFrame:
    """``(sample_key, primary_score, support_raw, support_score, score, verdict, reasons)`` of samples with findings.

    Capabilities are capped in sum, so they alone never make a sample malicious.
    """
    primary, supporting = F.col("tier") == "primary", F.col("tier") == "supporting"
    order = F.array_sort(F.collect_list(F.struct(supporting.alias("s"), (-F.col("points")).alias("p"), "reason")))  # one entry for each reason
    sums = once(found).groupBy("sample_key").agg(
        F.sum(F.when(primary, F.col("points")).otherwise(0)).alias("primary_score"), F.sum(F.when(supporting, F.col("points")).otherwise(0)).alias("support_raw"),
        F.transform(order, lambda r: F.struct((-r["p"]).cast("int").alias("points"), r["reason"].alias("reason"))).alias("reasons"),
    )
    scored = sums.withColumn("support_score", F.least("support_raw", F.lit(rules.SUPPORT_CAP))).withColumn("score", F.col("primary_score") + F.col("support_score"))
    verdict = F.when(F.col("primary_score") >= rules.MALICIOUS_PRIMARY, "MALICIOUS").when(F.col("score") >= rules.SUSPICIOUS_SCORE, "SUSPICIOUS").otherwise("BENIGN")
    return scored.withColumn("verdict", verdict).select("sample_key", "primary_score", "support_raw", "support_score", "score", "verdict", "reasons")
