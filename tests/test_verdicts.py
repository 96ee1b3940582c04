"""Rules and reports that the catalogue's tables never reach, on small hand-made evidence."""

import json

import pytest
from pyspark.sql import functions as F

from trawl.operators import corpus, dynamic, evaluate, fusion, shapes, static, taint
from trawl.plans import catalog
from trawl.schemas import RESULT_COLUMNS, RESULTS
from trawl.sources.tables import metrics_markdown

EVENT = "sample_key string, id int, severity string, module string, function_hooked string, arguments map<string,string>"
BEACON = "sample_key string, seq int, transport string, destination string, host string, method string, body string, body_bytes int, decoded string"
STOLEN = "sample_key string, data_stolen boolean, categories array<string>, suspected array<string>"


def observed(spark, events=(), beacons=(), stolen=()):
    rows = [("s", i, "INFO", m, f, a) for i, (m, f, a) in enumerate(events)] or [("s", 0, "INFO", "vscode", "activate", {"x": "y"})]
    return dynamic.observations(spark.createDataFrame(rows, EVENT), spark.createDataFrame([("s", i, *b) for i, b in enumerate(beacons)], BEACON), spark.createDataFrame([("s", *x) for x in stolen], STOLEN))


def reasons(spark, **evidence):
    row = dynamic.dynamic_verdict(observed(spark, **evidence)).first()
    assert row.score == sum(r.points for r in row.reasons)
    return {(r.points, r.reason) for r in row.reasons}


RUN = lambda command: {"events": [("child_process", "exec", {"command": command})]}
BODY = lambda text: {"beacons": [("https", "https://x.example/", "x.example", "POST", text, len(text), "")]}
CASES = {
    "stolen": ({"stolen": [(True, ["ssh_private_key", "aws"], [])]}, (55, "exfiltrates sensitive data (proven read → send): ssh_private_key, aws")),
    "suspected": ({"stolen": [(False, [], ["jwt"])]}, (15, "outbound payload resembles credentials but no matching read was observed: jwt")),
    "second stage": ({"events": [("child_process", "second_stage_analyzed", {"file": "b.js"})]}, (25, "detonated a forked second-stage script")),
    "persistence": (RUN("schtasks /create /tn updater /tr a"), (40, "establishes persistence (autostart registry key / scheduled task / startup folder / cron)")),
    "evasion": (RUN("powershell Add-MpPreference -ExclusionPath C:/x"), (50, "attempts security-product evasion (Defender exclusion / AMSI bypass)")),
    "encoded": (RUN("powershell -enc " + "QUJD" * 12), (50, "LOLBIN executing an encoded/decoded payload (powershell -enc / certutil -decode)")),
    "fingerprint": (BODY('{"hostname": "h", "username": "u"}'), (45, "exfiltrates a host fingerprint (machineId / MAC / hostname+username)")),
}


@pytest.mark.parametrize("name", CASES)
def test_each_rule_of_the_log_fires(spark, name):
    evidence, want = CASES[name]
    assert want in reasons(spark, **evidence)


def test_a_log_is_read_and_capped_once(spark):
    events = spark.createDataFrame([("s", i, "INFO", "os", "hostname", {}) for i in range(40)], EVENT)
    beacons, stolen = spark.createDataFrame([], BEACON), spark.createDataFrame([], STOLEN)
    seen = dynamic.observations(dynamic.capped(events, 30), beacons, stolen)
    assert [(r.total_events, r.os_recon_calls, r.recon) for r in seen.collect()] == [(30, 30, True)]
    assert seen._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 2  # the cap's own two ranks


def test_what_a_record_reads_twice_is_made_once(spark, sf):
    files = lambda name: {f.rpartition("/")[2] for f in catalog.QUERIES[name](spark, sf).inputFiles()}
    assert not {"documents.parquet", "events.parquet"} & files("evidence_digest")
    assert "events.parquet" not in files("flat_results")


def test_near_misses_of_the_log(spark):
    quiet = reasons(spark, stolen=[(True, ["a"], ["jwt"])], **RUN("git add file; crontabs of the town; powershell encode"), **BODY("the hostname alone"))
    assert not {p for p in quiet if p[1] in {w for name, (_, (_, w)) in CASES.items() if name != "stolen"}}


def test_actions_and_targets(spark):
    seen = dynamic.dynamic_verdict(observed(spark, events=[("child_process", "exec", {"command": "reg add HKCU/x"}), ("fs", "writeFile", {"path": "/x"}), ("crypto", "createDecipheriv", {}), ("os", "hostname", {})], **BODY('{"machineId": "m", "username": "u"}')))
    intel = dynamic.intelligence(seen).first()
    assert set(intel.data_targeted) == {"machine_id", "username", "host_reconnaissance"}
    assert {"Executed OS process / shell via child_process", "Wrote file(s) to disk", "Runtime AES decryption (payload deobfuscation)", "Modified Windows registry / scheduled-task persistence", "Outbound network transmission"} <= set(intel.actions)
    assert intel.purpose == "Dropper"


FILE = "sample_key string, path string, size long, content string"


def test_invisible_text_and_manifests(spark):
    hidden = "\U000e0041" * 7
    files = spark.createDataFrame([("u", "a.js", 10, f"x{hidden}"), ("few", "a.js", 10, "x" + "\U000e0041" * 6), ("m", "a.js", 900, "module.exports = 1"), ("big", "a.js", 9000, "class A {}")], FILE)
    found = static.invisible_findings(files).collect()
    assert [(r.sample_key, r.points, r.reason) for r in found] == [("u", 40, "invisible-Unicode encoding present (7 tag/variation-selector codepoints)")]
    manifests = spark.createDataFrame([(k, "n", "AI code assistant", "", "main.js", ["*"], {}) for k in ("m", "big", "none")], "sample_key string, name string, displayName string, description string, main string, activationEvents array<string>, scripts map<string,string>")
    got = {(r.sample_key, r.points, r.tier) for r in static.manifest_findings(manifests, static.file_stats(files)).collect()}
    assert ("m", 15, "supporting") in got and ("m", 20, "supporting") in got and ("none", 15, "supporting") in got
    assert not {x for x in got if x[0] == "big"}


def test_a_package_is_scanned_once_for_rules_and_invisible_text(spark, tmp_path):
    """The files were read anew for the count of invisible code points; what is found is what the operators find one by one."""
    tag, flag = "\U000e0041", "\U0001f3f4"
    texts = [("u", "a.js", "x" + tag * 4), ("u", "b.txt", "y" + "\U000e0100" * 4), ("u", "b.txt", "y" + "\U000e0100" * 4), ("few", "a.js", "x" + tag * 3 + " " + tag * 3 + " " + tag * 6), ("flag", "a.js", flag + tag * 9), (None, "a.js", "é" + tag * 7 + " catbox.moe"), ("n", "a.js", None), ("n", None, tag * 9), ("e", "a.js", ""), ("r", "a.js", "eval(atob(p)) // abc.ngrok.io"), ("r", "run.ps1", "plain"), ("r", "x/a.js", "abc.ngrok.io")]
    spark.createDataFrame([(k, p, 10, t) for k, p, t in texts], FILE).write.parquet(f"{tmp_path}/files")
    files = spark.read.parquet(f"{tmp_path}/files")
    manifests = spark.createDataFrame([(k, "n", "AI code assistant", "", "main.js", ["*"], {}) for k in ("u", "u", "none", None)], "sample_key string, name string, displayName string, description string, main string, activationEvents array<string>, scripts map<string,string>")
    found = static.package_findings(files, manifests)
    alone = [static.findings(files), shapes.shape_findings(files), static.invisible_findings(files), static.manifest_findings(manifests, static.file_stats(files))]
    rows = lambda frames: sorted((tuple(r) for f in frames for r in f.select("sample_key", "points", "reason", "file", "detail", "tier").collect()), key=repr)
    got = rows([found])
    assert got == rows(alone) and {(k, r.partition("(")[2][:2]) for k, _, r, *_ in got if r.startswith("invisible")} == {("u", "12"), (None, "7 "), ("n", "9 ")}
    scans = [x for x in found._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in x and "content#" in x]
    assert len(scans) == 1  # for the manifests' file stats


def test_dependencies_within_their_budget(spark):
    deep = lambda n: "node_modules/" + "d/" * n + "a.js"
    bad = "var _0xabcd = 1; spawn(x)"
    files = spark.createDataFrame([("s", deep(4), 25, bad), ("deep", deep(5), 25, bad), ("large", deep(1), 300_000, bad + " " * 300_000), *(("many", f"node_modules/m/{k:03d}.js", 5, "x") for k in range(50)), ("many", "src/a.js", 5, "x"), ("many", "node_modules/m/b.txt", 5, "x")], FILE)
    hits = {r.sample_key for r in static.findings(files).where("reason LIKE 'obfuscated dependency%'").collect()}
    assert hits == {"s"}
    kept = static.within_dependency_budget(files, 10).where("sample_key = 'many'").collect()
    assert sorted(r.path for r in kept) == sorted([*(f"node_modules/m/{k:03d}.js" for k in range(10)), "src/a.js", "node_modules/m/b.txt"])


def verdicts(spark, rows):
    return spark.createDataFrame([(k, v, s, [(s, r) for r in why]) for k, v, s, why in rows], "sample_key string, verdict string, score int, reasons array<struct<points:int,reason:string>>")


def test_another_engine_in_the_place_of_fusion(spark):
    one, two = verdicts(spark, [("s", "SUSPICIOUS", 30, ["x"])]), verdicts(spark, [("s", "BENIGN", 0, [])])
    strict = lambda a, b: a.join(b, "sample_key").select("sample_key", F.lit("MALICIOUS").alias("final_verdict"))
    assert fusion.fuse_with(strict, one, two).first().final_verdict == "MALICIOUS"
    assert fusion.fuse_with(None, one, two).first().final_verdict == fusion.fuse(one, two).first().final_verdict == "SUSPICIOUS"


def test_static_only_and_digests(spark):
    seen = dynamic.dynamic_verdict(observed(spark, events=[("child_process", "exec", {"command": "ls"})], **BODY("payload")))
    found = verdicts(spark, [("dormant", "SUSPICIOUS", 30, ["obfuscated"]), ("clean", "BENIGN", 0, [])])
    told = {(r.sample_key, r.technique) for r in fusion.behaviours(seen, None, found).collect()}
    assert told == {("s", "T1059"), ("s", "T1071"), ("dormant", "T1195 / dormant first-stage"), ("clean", "n/a")}
    fused, intel = fusion.fuse(found, seen), dynamic.intelligence(seen)
    beacons = spark.createDataFrame([("s", k, "https", "https://x.example/", "", "POST", f"body  {k}", 6, "") for k in range(40)], BEACON)
    rows = {r.sample_key: json.loads(r.digest) for r in fusion.prompt_digest(fused, seen, intel, beacons).collect()}
    assert rows.keys() == {"s", "dormant", "clean"} and rows["dormant"]["static"] == {"verdict": "SUSPICIOUS", "score": 30, "iocs": ["obfuscated"]}
    assert len(rows["s"]["dynamic"]["outbound"]) == 30 and rows["s"]["dynamic"]["outbound"][0] == {"to": "https://x.example/", "method": "POST", "body": "body 0"} and rows["s"]["dynamic"]["exec"] == 1


def test_iocs_tell_how_many_there_were(spark):
    seen = dynamic.dynamic_verdict(observed(spark, beacons=[("https", f"https://h{k}.example/", f"h{k}.example", "GET", "", 0, "") for k in range(60)]))
    flows = spark.createDataFrame([("s", k, "aws", f"/p{k}", "https://x", k != 3) for k in range(5)], "sample_key string, send_seq long, category string, path string, destination string, confirmed boolean")
    row = fusion.iocs(seen, flows).first()
    assert len(row.hosts) == 50 and row.hosts_truncated_from == 60 and row.outbound_count == 60
    assert row.taint_flows == [f"aws: /p{k} → https://x" for k in (0, 1, 2, 4)] and row.taint_flows_truncated_from is None and row.shell_commands == []


def results(spark):
    kinds = dict(x.split(" ") for x in RESULTS.split(", "))
    told = [("a", 1, "MALICIOUS", 1, ""), ("b", 1, "BENIGN", 0, ""), ("c", 0, "MALICIOUS", 1, "static:+55 download cradle"), ("d", 1, "ERROR", 0, ""), ("e", None, "BENIGN", 0, ""), ("f", 0, "BENIGN", 0, "")]
    given = spark.createDataFrame(told, "id string, label int, final_verdict string, final_is_malicious int, top_reasons string").withColumns({"version": F.lit("1"), "final_is_flagged": F.col("final_is_malicious"), "tier": F.lit("code"), "error": F.when(F.col("id") == "d", "broken").otherwise(""), "score": F.lit(7), "decided_by": F.lit("static")})
    return given.select(*((F.col(c) if c in given.columns else F.lit("" if kinds[c] == "string" else 0)).cast(kinds[c]).alias(c) for c in RESULT_COLUMNS))


def test_reports(spark):
    rows = results(spark)
    assert tuple(evaluate.misjudged(rows).first()) == (1, 2, 1)
    lines = {(r.part, r.cause, r.n, r.id): r.line for r in evaluate.cause_report(rows).collect()}
    assert lines.keys() == {("FP", "CRADLE_OVERMATCH", 1, "c"), ("FN", "DORMANT_NO_OBSERVABLE_PAYLOAD", 1, "b"), ("FN", "ANALYSIS_ERROR", 1, "d"), ("ERROR", "ANALYSIS_ERROR", 1, "d")}
    assert lines["ERROR", "ANALYSIS_ERROR", 1, "d"] == "- **d** v1 — broken"
    report = {r.section: json.loads(r.report) for r in evaluate.metrics_report(rows, {"all": F.lit(True), "labelled": F.col("label").isNotNull()}).collect()}
    assert (report["all"]["n"], report["labelled"]["n"], report["all"]["positives"], report["all"]["strict"]["tp"], report["all"]["strict"]["fn"], report["all"]["triage"]["fp"]) == (6, 5, 3, 1, 2, 1)
    assert report["all"]["tiers"] == [{"name": "code", "n": 6, "malicious": 2, "flagged": 2, "error": 1}] and report["all"]["classes"][0]["name"] == "(none)"
    whole = {r.rule: r.line for r in metrics_markdown(evaluate.confusion(rows)).collect()}
    assert whole["strict"].startswith("Precision **50.0%** · Recall **33.3%**") and whole["strict"].endswith("n = 5")


def test_matrices_of_batches_add_up(spark):
    rows = results(spark)
    parts = [evaluate.matrix_counts(rows.where(c)) for c in ("id < 'c'", "id = 'c'", "id > 'c'")]
    want = evaluate.confusion(rows)
    got = evaluate.merged(parts[0].unionByName(parts[1]).unionByName(parts[2])).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_discovery_counts(spark):
    rows = spark.createDataFrame([("code", "Malware", True), ("policy", "Spam", False), ("code", "", False)], "tier string, classification string, is_dir boolean")
    got = {(r.stat, r.name, r.n) for r in corpus.discovery_stats(rows, corpus.tier_filter(rows, include="code"), {"per_version": rows.limit(2), "per_extension": rows.limit(0)}).collect()}
    assert got == {("found", "folders", 1), ("found", "archives", 2), ("selected", "all", 2), ("excluded_by_tier", "all", 1), ("tier", "code", 2), ("classification", "Malware", 1), ("classification", "(none)", 1), ("metadata_rows", "per_version", 2), ("metadata_rows", "per_extension", 0)}


def test_the_harness_own_values_leave_no_trace(spark):
    reads = spark.createDataFrame([("s", 1, "/home/u/.env", "TOKEN=planted-by-the-harness-000\nanother long line that is really the user's")], "sample_key string, seq int, path string, content string")
    tokens = {r.token for r in taint.taint_tokens(reads, ["planted-by-the-harness"]).collect()}
    assert tokens and not any("planted" in t for t in tokens)
