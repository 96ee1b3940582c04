"""Run-time evidence: summaries, a weighted verdict, intelligence, endpoints and timers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.functions import rules
from trawl.functions.rules import RUN
from trawl.functions.text import clip, hit, host_port
from trawl.operators.numbering import first_rows

WRITES = ["writeFile", "writeFileSync", "appendFile", "appendFileSync", "createWriteStream", "unlink", "unlinkSync", "rename", "renameSync"]


def capped(events: DataFrame, most: int = rules.MAX_EVENTS) -> DataFrame:
    """The first events of each sample."""
    return first_rows(events, ["id"], most)


def in_order(value: Column, order: str = "id") -> Column:
    """A group's values by their order; bounded by the event cap."""
    return F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(F.col(order).alias("o"), value.alias("v"))))), lambda x: x["v"])


def argument(name: str) -> Column:
    return F.try_element_at("arguments", F.lit(name))


def summary_of() -> list[Column]:
    """Counters and distinct lists of a sample's events, as aggregates."""
    module, function = F.col("module"), F.col("function_hooked")
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    host = F.when(argument("url") != "", F.coalesce(F.lower(F.try_parse_url(argument("url"), F.lit("HOST"))), argument("url")))
    return [
        F.count("*").alias("total_events"), count(F.col("severity") == "CRITICAL").alias("critical_events"), count(module == "child_process").alias("child_process_calls"),
        count(module.isin("http", "https", "fetch")).alias("http_requests"), count((module == "fs") & function.isin(WRITES)).alias("fs_writes_blocked"),
        count((module == "fs") & function.isin("readFile", "readFileSync")).alias("fs_reads"), count(module == "eval").alias("eval_calls"),
        count((module == "crypto") & (function == "createDecipheriv")).alias("crypto_decrypt_calls"), count(module == "net").alias("net_socket_calls"), count(module == "dns").alias("dns_lookups"), count(module == "os").alias("os_recon_calls"),
        F.array_distinct(in_order(host)).alias("unique_hosts_contacted"), F.array_distinct(in_order(F.nullif(argument("command"), F.lit("")))).alias("shell_commands_attempted"),
    ]


def event_summary(events: DataFrame) -> DataFrame:
    """Counters and distinct lists of each sample, in one aggregation."""
    return events.groupBy("sample_key").agg(*summary_of())


def observations(events: DataFrame, beacons: DataFrame, stolen: DataFrame) -> DataFrame:
    """One row for each sample: its summary, flags, and the texts that the rules search; one aggregation, so the log is read and capped once."""
    module, function = F.col("module"), F.col("function_hooked")
    any_of = lambda c: F.coalesce(F.bool_or(F.coalesce(c, F.lit(False))), F.lit(False))
    command = F.concat_ws(" ", argument("command"), argument("args"), argument("file"), argument("modulePath"))
    of_events = events.groupBy("sample_key").agg(
        *summary_of(),
        any_of((module == "child_process") & hit(function, "exec|spawn|fork|execFile")).alias("has_exec"), any_of((module == "net") & hit(function, rules.SOCKET_CALL)).alias("has_socket"),
        any_of((module == "os") & hit(function, rules.OS_RECON)).alias("recon"), any_of(function == "second_stage_analyzed").alias("second_stage"), any_of(module == "child_process").alias("any_process"),
        any_of((module == "fs") & hit(function, "writeFile|createWriteStream|appendFile")).alias("wrote"), any_of(hit(argument("command"), "(?i)installExtension") | hit(function, "(?i)installExtension")).alias("installed"),
        F.array_join(in_order(F.when(module == "child_process", command)), "  ||  ").alias("_commands"), F.array_join(in_order(F.when(module == "fs", argument("path"))), " ").alias("paths"),
    )
    host = F.when(~F.col("host").isin(rules.LOCAL_HOSTS), F.col("host"))
    body = F.concat_ws(" ", F.coalesce("decoded", F.lit("")), F.coalesce("body", F.lit("")))
    of_beacons = beacons.groupBy("sample_key").agg(
        F.count("*").alias("outbound_messages"), F.concat(in_order(host, "seq"), in_order(F.nullif("destination", F.lit("")), "seq")).alias("_dests"), F.array_join(in_order(body, "seq"), "  ").alias("bodies"),
        any_of(hit(F.col("destination"), rules.RUN_BINARY)).alias("binary_url"), any_of(F.upper("method").isin("POST", "PUT", "PATCH") & (F.col("body_bytes") > 2)).alias("sends_body"),
        any_of((F.col("body_bytes") > 0) & ~F.coalesce("host", F.lit("")).isin(rules.LOCAL_HOSTS[:4])).alias("sends_off_box"),
        F.array_distinct(in_order(F.coalesce(F.nullif("host", F.lit("")), F.nullif("destination", F.lit(""))), "seq")).alias("hosts"),
    )
    found = of_events.join(of_beacons, "sample_key", "full").join(stolen, "sample_key", "left")
    numbers = ["total_events", "critical_events", "child_process_calls", "http_requests", "fs_writes_blocked", "fs_reads", "eval_calls", "crypto_decrypt_calls", "net_socket_calls", "dns_lookups", "os_recon_calls", "outbound_messages"]
    flags = ["has_exec", "has_socket", "recon", "second_stage", "any_process", "wrote", "installed", "binary_url", "sends_body", "sends_off_box", "data_stolen"]
    lists = ["unique_hosts_contacted", "shell_commands_attempted", "_dests", "hosts", "categories", "suspected"]
    empty = F.array().cast("array<string>")
    found = found.withColumns({c: F.coalesce(c, F.lit(0)) for c in numbers} | {c: F.coalesce(c, F.lit(False)) for c in flags} | {c: F.coalesce(c, empty) for c in lists} | {c: F.coalesce(c, F.lit("")) for c in ("_commands", "paths", "bodies")})
    outside = F.filter("unique_hosts_contacted", lambda h: ~h.isin(rules.LOCAL_HOSTS))
    parts = F.filter(F.concat(F.array("_commands"), F.col("shell_commands_attempted")), lambda c: c != "")
    return found.withColumns({"destinations_text": F.array_join(F.array_distinct(F.concat("_dests", outside)), " "), "commands": F.array_join(parts, "  ||  ")}).drop("_dests", "_commands")


def fired(tests: list[tuple[Column, int, Column | str]]) -> Column:
    """The reasons whose conditions hold, in order."""
    made = [F.when(c, F.struct(F.lit(points).alias("points"), (why if isinstance(why, Column) else F.lit(why)).alias("reason"))) for c, points, why in tests]
    return F.filter(F.array(*made), lambda r: r.isNotNull())


def dynamic_verdict(seen: DataFrame) -> DataFrame:
    """``observations`` with ``reasons``, ``score`` and ``verdict``. Points add up without a cap."""
    c, cmds, bodies, dests = F.col, F.col("commands"), F.col("bodies"), F.col("destinations_text")
    evals, decrypts = c("eval_calls") > 0, c("crypto_decrypt_calls") > 0
    network = (c("http_requests") > 0) | (c("outbound_messages") > 0) | c("has_socket")
    binary = c("binary_url") | hit(c("paths"), rules.RUN_BINARY_PATH)
    fingerprint = hit(bodies, rules.RUN_FINGERPRINT) | (hit(bodies, r"(?i)\bhostname\b") & hit(bodies, r"(?i)\busername\b"))
    named = lambda text, column: F.concat(F.lit(text), F.array_join(column, ", "))
    behaviour = [
        (hit(cmds, rules.RUN_LOLBIN) & hit(cmds, rules.RUN_PAYLOAD), *RUN["cradle"]),
        (c("has_socket") & c("has_exec"), *RUN["shell"]),
        (~c("has_socket") & c("has_exec"), *RUN["process"]),
        (binary & c("has_exec"), *RUN["dropper"]),
        (binary & ~c("has_exec"), *RUN["binary"]),
        (c("data_stolen"), RUN["stolen"][0], named(RUN["stolen"][1], "categories")),
        (~c("data_stolen") & (F.size("suspected") > 0), RUN["suspected"][0], named(RUN["suspected"][1], "suspected")),
        (decrypts & network, *RUN["decrypts"]),
        (~(decrypts & network) & evals & network, *RUN["evaluates and sends"]),
        (evals & ~network, *RUN["evaluates"]),
        (c("second_stage"), *RUN["second stage"]),
        (c("recon") & network, *RUN["recon"]),
        (hit(cmds, rules.RUN_RECON_ID) & hit(cmds, rules.RUN_RECON_ANY), *RUN["battery"]),
        (hit(F.concat_ws(" ", cmds, c("paths")), rules.RUN_PERSISTENCE), *RUN["persistence"]),
        (hit(cmds, rules.RUN_EVASION), *RUN["evasion"]),
        (hit(cmds, rules.RUN_ENCODED), 50, rules.ENCODED_REASON),
        (fingerprint, *RUN["fingerprint"]),
    ]
    marks = fired([(hit(dests, p) | hit(cmds, p), points, why) for _, points, why, p in rules.INDICATORS])
    first = seen.withColumn("_behaviour", fired(behaviour)).withColumn("_marks", marks)
    sent = fired([((F.size("_marks") > 0) & c("sends_body"), *RUN["sent"])])
    baseline = fired([(network & (F.size("_behaviour") + F.size("_marks") == 0), *RUN["network"])])
    scored = first.withColumn("reasons", F.concat("_behaviour", "_marks", sent, baseline)).drop("_behaviour", "_marks")
    scored = scored.withColumn("score", F.aggregate("reasons", F.lit(0), lambda a, r: a + r["points"]))
    verdict = F.when(c("score") >= rules.MALICIOUS_SCORE, "MALICIOUS").when(c("score") >= rules.SUSPICIOUS_SCORE, "SUSPICIOUS").otherwise("BENIGN")
    return scored.withColumn("verdict", verdict)


def intelligence(seen: DataFrame) -> DataFrame:
    """``(sample_key, purpose, confidence, actions, data_targeted, c2_indicators)`` of scored observations."""
    c, cmds, bodies, dests = F.col, F.col("commands"), F.col("bodies"), F.col("destinations_text")
    listed = lambda cases: F.filter(F.array(*(F.when(k, F.lit(v)) for k, v in cases)), lambda x: x.isNotNull())
    cradle = hit(cmds, r"(?i)(?:powershell|cmd\.exe|certutil|bitsadmin|curl|wget|invoke-webrequest|mshta)") & hit(cmds, r"(?i)(?:https?://|\.bat\b|\.ps1\b|\.exe\b|catbox|pastebin)")
    everything = F.concat_ws("  ", dests, bodies, cmds)
    actions = listed([
        (cradle, "Download-and-execute cradle (LOLBIN fetches & runs a remote payload)"), (c("any_process"), "Executed OS process / shell via child_process"), (c("wrote"), "Wrote file(s) to disk"),
        (c("crypto_decrypt_calls") > 0, "Runtime AES decryption (payload deobfuscation)"), (c("eval_calls") > 0, "Dynamic code evaluation (eval / new Function)"), (c("second_stage"), "Detonated a forked second-stage script"),
        (c("installed"), "Programmatically installed a VSIX (marketplace bypass)"), (hit(cmds, r"(?i)\b(?:reg(?:\.exe)?\s+add|schtasks|New-ItemProperty|HKCU|HKLM)\b"), "Modified Windows registry / scheduled-task persistence"),
        (hit(cmds, r"(?i)crontab|launchctl|systemctl|\.bashrc|LaunchAgents"), "Established *nix persistence (cron / launch agent)"), (c("outbound_messages") > 0, "Outbound network transmission"),
    ])
    targeted = F.array_distinct(F.concat("categories", listed([
        (hit(bodies, r"(?i)\bmachine[_-]?id\b"), "machine_id"), (hit(bodies, r"(?i)\bmac[_-]?address\b|\b([0-9a-f]{2}:){5}[0-9a-f]{2}\b"), "mac_address"), (hit(bodies, r"(?i)\busername\b"), "username"), (hit(bodies, r"(?i)\bhostname\b"), "hostname"),
        (hit(bodies, r"(?i)\bhome[_-]?dir"), "home_directory"), (hit(bodies, r'(?i)"code"\s*:|"source"\s*:'), "editor_source_code"), (c("recon"), "host_reconnaissance"),
    ])))
    c2 = listed([
        (hit(dests, r"(?i)ngrok|trycloudflare|\.tcp\.|localtunnel|serveo"), "tunnel (ngrok / cloudflare / tcp)"), (hit(dests, r"(?i)mainnet-beta\.solana|api\.mainnet-"), "Solana RPC (blockchain C2)"),
        (hit(F.concat(dests, bodies), r"(?i)discord(?:app)?\.com/api/webhooks"), "Discord webhook"), (hit(dests, r"(?i)api\.telegram\.org"), "Telegram bot"), (hit(dests, "(?i)xn--"), "punycode / typosquat domain"),
        (F.exists("hosts", lambda h: hit(h, r"^\d{1,3}(\.\d{1,3}){3}(:\d+)?$")), "hard-coded raw IP"), (hit(dests, r"(?i)herokuapp|elasticbeanstalk|pythonanywhere|onrender|workers\.dev|railway"), "ephemeral cloud backend"),
    ])
    found = seen.withColumns({"actions": actions, "data_targeted": targeted, "c2_indicators": c2})
    purpose = (
        F.when(hit(everything, r"(?i)stratum\+tcp|xmrig|coinhive|minexmr|cryptonight|nanopool|supportxmr|c3pool"), "Crypto-miner")
        .when(c("has_socket") & c("any_process"), "Backdoor / Reverse shell")
        .when(cradle, "Loader / Downloader (stager)")
        .when(hit(dests, r"(?i)\.(exe|dll|msi|scr)\b") | (c("any_process") & c("wrote")), "Dropper")
        .when((F.size("data_targeted") > 0) & (c("outbound_messages") > 0), "Infostealer / Reconnaissance")
        .when((c("outbound_messages") > 0) | c("has_socket"), "C2 beacon / Command-and-control client")
        .when((c("eval_calls") > 0) | (c("crypto_decrypt_calls") > 0), "Obfuscated payload (staged execution)")
        .otherwise("No malicious behaviour observed (dynamic)")
    )
    confidence = F.when(c("score") >= 90, "high").when(c("score") >= 60, "medium").otherwise("low")
    return found.select("sample_key", purpose.alias("purpose"), confidence.alias("confidence"), "actions", "data_targeted", "c2_indicators")


def endpoints(beacons: DataFrame, most: int = rules.MAX_ENDPOINTS) -> DataFrame:
    """Each sample's distinct endpoints with how often they were used; the first ``most`` by first use."""
    preview = clip(F.coalesce(F.nullif("decoded", F.lit("")), "body", F.lit("")), 200)
    parsed = beacons.withColumn("at", host_port(F.coalesce(F.nullif("destination", F.lit("")), "host", F.lit("")))).withColumn("preview", preview)
    key = ["sample_key", "transport", F.coalesce("method", F.lit("")).alias("method"), F.col("at.domain").alias("domain"), F.col("at.ip").alias("ip"), F.col("at.port").alias("port")]
    counts = parsed.groupBy(*key).agg(F.count("*").alias("repeat_count"), F.min("seq").alias("first_seq"), F.min_by("preview", "seq").alias("first_preview"))
    rank = F.row_number().over(Window.partitionBy("sample_key").orderBy("first_seq"))
    return counts.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def timer_fires(timers: DataFrame, horizon_ms: int = 366 * 86_400_000, most_ticks: int = 150, most_fires: int = 20_000, compat: bool = False) -> DataFrame:
    """``timers(sample_key, timer_id, seq, kind, created_ms, delay_ms)`` to the moments they fire, in order.

    A timeout fires once, an interval up to ``most_ticks`` times (once more with
    ``compat``) and at least a millisecond apart; equal moments fire by ``seq``; nothing fires
    beyond the horizon or the cap on a sample's fires.
    """
    ticks = F.when(F.col("kind") == "interval", F.lit(most_ticks + int(compat))).otherwise(1)
    again = F.when(F.col("delay_ms") > 0, F.col("delay_ms")).otherwise(1)
    told = timers.withColumn("tick", F.explode(F.sequence(F.lit(1), ticks)))
    told = told.withColumn("fire_at", F.col("created_ms") + F.greatest(F.col("delay_ms"), F.lit(0)) + (F.col("tick") - 1) * again).where(F.col("fire_at") <= horizon_ms)
    rank = F.row_number().over(Window.partitionBy("sample_key").orderBy("fire_at", "seq", "tick"))
    return told.withColumn("order", rank).where(F.col("order") <= most_fires).select("sample_key", "timer_id", "tick", "fire_at", "order")
