"""The catalogue's queries as DuckDB SQL over the same tables, written from the definitions.

The patterns are those of the rule tables. DuckDB's engine has no lookahead, so
the two rules that use one are written as an extraction less the excluded prefixes.
"""

from __future__ import annotations

from trawl.functions import rules
from trawl.operators.shapes import COMPARED, MODULE, USUAL_WORDS
from trawl.plans.fixtures import CLASSES, COMMANDS, ITEMS, PACK, PROBES, SAMPLES, SCRIPTS, URLS


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def hit(column: str, pattern: str) -> str:
    if "(?!" in pattern:
        scheme = "https?://" if pattern.startswith("http") else ""
        prefixes = pattern.split("(?!")[1].split(")")[0]
        return f"len(list_filter(regexp_extract_all({column}, {text(scheme + r'\d{1,3}(?:\.\d{1,3}){3}')}), lambda x: NOT regexp_matches(x, {text('^' + scheme + '(?:' + prefixes + ')')}))) > 0"
    return f"regexp_matches({column}, {text(pattern)})"


def pick(values: list[str], k: str) -> str:
    return f"([{', '.join(map(text, values))}])[({k}) % {len(values)} + 1]"


def families_of(reason: str) -> list[str]:
    import re

    return [name for name, p in rules.FAMILIES if re.search(p, reason)]


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


FOUND = "found AS (" + " UNION ALL ".join(f"SELECT doc_id, {text(r.reason)} AS rule, {r.points} AS points, {text(r.tier)} AS tier FROM documents WHERE {hit('text', r.pattern)}" for r in PACK) + ")"
SCORED = f"""scored AS (
  SELECT doc_id, primary_score, least(support_raw, {rules.SUPPORT_CAP}) AS support_score, primary_score + least(support_raw, {rules.SUPPORT_CAP}) AS score,
         CASE WHEN primary_score >= {rules.MALICIOUS_PRIMARY} THEN 'MALICIOUS' WHEN primary_score + least(support_raw, {rules.SUPPORT_CAP}) >= {rules.SUSPICIOUS_SCORE} THEN 'SUSPICIOUS' ELSE 'BENIGN' END AS verdict, top_reasons, reasons
  FROM (SELECT doc_id, CAST(sum(CASE WHEN tier = 'primary' THEN points ELSE 0 END) AS BIGINT) AS primary_score, CAST(sum(CASE WHEN tier = 'supporting' THEN points ELSE 0 END) AS BIGINT) AS support_raw,
               list(rule ORDER BY tier, points DESC, rule) AS reasons, list('static:+' || points || ' ' || rule ORDER BY tier, points DESC, rule) AS top_reasons FROM found GROUP BY doc_id))"""
_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
LOG = f"""log AS (
  SELECT event_id % {SAMPLES} AS sample, event_id AS id, value > 100 AS critical, split_part(call, '/', 1) AS module, split_part(call, '/', 2) AS fn,
         CASE WHEN event_type = 'view' THEN CASE WHEN k % 25 = 7 THEN '/home/u/setup.exe' ELSE '/home/u/file' || k || '.txt' END END AS path,
         CASE WHEN event_type = 'signup' THEN {pick(URLS, 'k')} END AS url, CASE WHEN event_type = 'click' THEN {pick(COMMANDS, 'k')} END AS command
  FROM (SELECT *, {_K} AS k, CASE event_type WHEN 'view' THEN 'fs/readFile' WHEN 'signup' THEN 'https/request' WHEN 'error' THEN 'eval/eval' WHEN 'click' THEN 'child_process/exec'
               ELSE CASE {_K} % 10 WHEN 0 THEN 'net/connect' WHEN 1 THEN 'crypto/createDecipheriv' WHEN 2 THEN 'os/hostname' ELSE 'dns/lookup' END END AS call FROM events))"""
SEEN = """seen AS (
  SELECT sample, count(*) AS total_events, count(*) FILTER (critical) AS critical_events, count(*) FILTER (module = 'child_process') AS child_process_calls, count(*) FILTER (module = 'https') AS http_requests,
         0::BIGINT AS fs_writes_blocked, count(*) FILTER (module = 'fs') AS fs_reads, count(*) FILTER (module = 'eval') AS eval_calls, count(*) FILTER (module = 'crypto') AS crypto_decrypt_calls,
         count(*) FILTER (module = 'net') AS net_socket_calls, count(*) FILTER (module = 'dns') AS dns_lookups, count(*) FILTER (module = 'os') AS os_recon_calls,
         coalesce(string_agg(command, '  ||  ' ORDER BY id), '') AS commands, coalesce(string_agg(path, ' '), '') AS paths, coalesce(string_agg(url || ' ' || regexp_extract(url, '//([^/:]+)', 1), ' '), '') AS dests,
         coalesce(list(regexp_extract(url, '//([^/:]+)', 1) ORDER BY id) FILTER (url IS NOT NULL), []) AS hosts, coalesce(list(command ORDER BY id) FILTER (command IS NOT NULL), []) AS cmds
  FROM log GROUP BY sample)"""
_NET = "(http_requests > 0 OR net_socket_calls > 0)"
_BEHAVIOUR = [
    (f"{hit('commands', rules.RUN_LOLBIN)} AND {hit('commands', rules.RUN_PAYLOAD)}", 55, "download-and-execute cradle (LOLBIN fetches & runs a remote payload)"),
    ("net_socket_calls > 0 AND child_process_calls > 0", 60, "reverse shell: raw TCP socket bound to a shell process"),
    ("net_socket_calls = 0 AND child_process_calls > 0", 35, "spawns an OS process / shell via child_process"),
    (f"{hit('paths', rules.RUN_BINARY_PATH)} AND child_process_calls > 0", 45, "downloads an executable and launches it (dropper)"),
    (f"{hit('paths', rules.RUN_BINARY_PATH)} AND child_process_calls = 0", 30, "downloads an executable/DLL payload"),
    (f"crypto_decrypt_calls > 0 AND {_NET}", 35, "runtime-decrypts a payload (AES) then contacts the network"),
    (f"crypto_decrypt_calls = 0 AND eval_calls > 0 AND {_NET}", 35, "evaluates dynamically-built code then contacts the network"),
    (f"eval_calls > 0 AND NOT {_NET}", 18, "evaluates dynamically-built code (eval / new Function)"),
    (f"os_recon_calls > 0 AND {_NET}", 30, "collects host/user reconnaissance and transmits it"),
    (f"{hit('commands', rules.RUN_RECON_ID)} AND {hit('commands', rules.RUN_RECON_ANY)}", 40, "executed a host reconnaissance battery (account/privilege enumeration + system probing)"),
]
_MARKS = [(f"({hit('dests', p)} OR {hit('commands', p)})", points, why) for _, points, why, p in rules.INDICATORS]
_SUM = lambda cases: " + ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for c, p, _ in cases)
_LIST = lambda cases: "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {text(why)} END" for c, _, why in cases) + "], lambda x: x IS NOT NULL)"
JUDGED = f"""judged AS (
  SELECT *, CASE WHEN score >= {rules.MALICIOUS_SCORE} THEN 'MALICIOUS' WHEN score >= {rules.SUSPICIOUS_SCORE} THEN 'SUSPICIOUS' ELSE 'BENIGN' END AS verdict FROM (
    SELECT *, CAST(b + m + CASE WHEN m > 0 AND http_requests > 0 THEN 25 ELSE 0 END + CASE WHEN b + m = 0 AND {_NET} THEN 10 ELSE 0 END AS INTEGER) AS score,
           list_concat(told, CASE WHEN m > 0 AND http_requests > 0 THEN ['transmits a data payload to the suspicious/tunnelled endpoint (exfiltration)'] ELSE [] END, CASE WHEN b + m = 0 AND {_NET} THEN ['makes outbound network connections'] ELSE [] END) AS reasons
    FROM (SELECT *, {_SUM(_BEHAVIOUR)} AS b, {_SUM(_MARKS)} AS m, list_concat({_LIST(_BEHAVIOUR)}, {_LIST(_MARKS)}) AS told FROM seen)))"""
_REASONS = sorted({r.reason for r in PACK} | {w for _, _, w in _BEHAVIOUR + _MARKS} | {"transmits a data payload to the suspicious/tunnelled endpoint (exfiltration)", "makes outbound network connections"})
_ORDER = {name: i for i, (name, _) in enumerate(rules.FAMILIES)}
FAMILY = "family(rule, name) AS (VALUES " + ", ".join(f"({text(r)}, {text(f)})" for r in _REASONS for f in families_of(r)) + ")"
_FAMS = lambda t, key: f"SELECT {key} AS sample, rule, name FROM (SELECT {key}, unnest(reasons) AS rule FROM {t}) JOIN family USING (rule)"
FUSED = f"""sf AS ({_FAMS('scored', 'doc_id')}), df AS ({_FAMS('judged', 'sample')}),
shared AS (SELECT sample, list(DISTINCT name) AS names FROM sf JOIN df USING (sample, name) GROUP BY sample),
fused AS (
  SELECT sample, coalesce(names, []) AS names, greatest(ss, ds) AS score, greatest(rs, rd) = 1 AND names IS NOT NULL AS up, rs, rd, s_reasons, d_reasons
  FROM (SELECT coalesce(doc_id, sample) AS sample, coalesce(s.score, 0) AS ss, coalesce(d.score, 0) AS ds, coalesce(list_position(['BENIGN','SUSPICIOUS','MALICIOUS'], s.verdict), 1) - 1 AS rs,
               coalesce(list_position(['BENIGN','SUSPICIOUS','MALICIOUS'], d.verdict), 1) - 1 AS rd, coalesce(s.reasons, []) AS s_reasons, coalesce(d.reasons, []) AS d_reasons FROM scored s FULL JOIN judged d ON s.doc_id = d.sample)
  LEFT JOIN shared USING (sample))"""
_CLASS = "coalesce(map {" + ", ".join(f"{text(k)}: {text(v)}" for k, v in CLASSES.items()) + "}[lang], '')"
_TIER = "CASE lang WHEN 'en' THEN 'code' WHEN 'de' THEN 'policy' WHEN 'fr' THEN 'suspect' ELSE 'unknown' END"
ROWS = f"""result AS (
  SELECT d.doc_id, d.source, 1 - quality AS label, {_TIER} AS tier, {_CLASS} AS classification, coalesce(verdict, 'BENIGN') AS v, coalesce(verdict, 'BENIGN') = 'MALICIOUS' AS p_strict, coalesce(verdict, 'BENIGN') <> 'BENIGN' AS p_triage, coalesce(score, 0) AS score,
         coalesce(total_events, 0) AS events, coalesce(http_requests, 0) AS net, coalesce(child_process_calls, 0) AS exec, d.doc_id % 50 = 0 AS timed_out, coalesce(substr(array_to_string(top_reasons[1:4], ' ; '), 1, 400), '') AS top_reasons
  FROM documents d LEFT JOIN labels USING (doc_id) LEFT JOIN scored USING (doc_id) LEFT JOIN seen ON seen.sample = d.doc_id)"""
BASE = with_(FOUND, SCORED, LOG, SEEN, ROWS)
_COUNTS = lambda y, p: f"count(*) FILTER ({y} = 1 AND {p}) AS tp, count(*) FILTER ({y} = 0 AND {p}) AS fp, count(*) FILTER ({y} = 1 AND NOT {p}) AS fn, count(*) FILTER ({y} = 0 AND NOT {p}) AS tn"
_P, _R = "CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fp) END", "CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fn) END"
_F1 = "CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1"
_ACC = "CASE WHEN tp + fp + fn + tn = 0 THEN 0.0 ELSE (tp + tn)::DOUBLE / (tp + fp + fn + tn) END AS accuracy"
_ROOT = "sqrt((tp + fp)::DOUBLE * (tp + fn)::DOUBLE * (tn + fp)::DOUBLE * (tn + fn)::DOUBLE)"
_MCC = f"CASE WHEN {_ROOT} = 0 THEN 0.0 ELSE (tp::DOUBLE * tn - fp::DOUBLE * fn) / {_ROOT} END AS mcc"
LONG = "long AS (SELECT *, 'strict' AS rule, p_strict AS p FROM result UNION ALL SELECT *, 'triage' AS rule, p_triage AS p FROM result)"
_V = "count(*) AS n, count(*) FILTER (v = 'MALICIOUS') AS malicious, count(*) FILTER (v <> 'BENIGN') AS flagged"
_MISSED = "CASE WHEN timed_out THEN 'TIMEOUT' WHEN tier = 'policy' THEN 'OUT_OF_SCOPE_POLICY_REMOVAL' WHEN tier = 'suspect' THEN 'OUT_OF_SCOPE_UNTRUSTWORTHY' WHEN v = 'SUSPICIOUS' THEN 'BELOW_MALICIOUS_THRESHOLD' WHEN events = 0 AND v = 'BENIGN' THEN 'DORMANT_NO_OBSERVABLE_PAYLOAD' WHEN events = 0 THEN 'GATED_STATIC_ONLY' WHEN net > 0 AND exec = 0 THEN 'NETWORK_ONLY_INDISTINGUISHABLE' WHEN events > 0 THEN 'RAN_BUT_UNRECOGNISED' ELSE 'UNRECOGNISED_BEHAVIOUR' END"
_ALARM = "CASE " + " ".join(f"WHEN {hit('top_reasons', p)} THEN {text(c)}" for p, c in rules.FALSE_ALARMS) + " ELSE 'RULE_OVERMATCH' END"
_SECRETS = [s for s in rules.SECRETS if s.content]


def secrets(table: str, keys: str, column: str) -> str:
    """The first match of each content rule in ``column``."""
    return " UNION ALL ".join(f"SELECT {keys}, {i} AS pos, {text(s.category)} AS category, {text(s.severity)} AS severity, regexp_extract({column}, {text('(' + s.content + ')')}, 1) AS raw FROM {table} WHERE regexp_matches({column}, {text(s.content)})" for i, s in enumerate(_SECRETS))


_REDACT = r"CASE WHEN length(s) <= 12 THEN left(s, 2) || '***' || right(s, 2) ELSE left(s, 4) || '…[' || length(s) || 'B]…' || right(s, 4) END"
TOKENS = rf"""strong AS ({secrets('benchmark', 'item_id', 'text')}),
lines AS (SELECT item_id, trim(unnest(regexp_split_to_array(text, '\r?\n'))) AS token, generate_subscripts(regexp_split_to_array(text, '\r?\n'), 1) AS n FROM benchmark),
weak AS (SELECT item_id, token, row_number() OVER (PARTITION BY item_id ORDER BY n) AS k FROM lines WHERE length(token) >= {rules.MIN_LINE}),
every AS (SELECT item_id, pos, category, raw AS token, 'strong' AS strength FROM strong WHERE length(raw) >= {rules.MIN_TOKEN} UNION ALL SELECT item_id, 100 + k, 'dotenv_secrets', token, 'weak' FROM weak WHERE k <= {rules.LINES}),
single AS (SELECT *, item_id // {ITEMS} AS sample FROM every QUALIFY row_number() OVER (PARTITION BY item_id // {ITEMS}, token ORDER BY item_id, pos) = 1),
tokens AS (SELECT * FROM single QUALIFY row_number() OVER (PARTITION BY sample ORDER BY item_id, pos) <= {rules.MAX_TOKENS})"""
#: The sample that sent a document.
_SENDER = f"doc_id % (SELECT max(item_id) // {ITEMS} + 1 FROM benchmark)"
EVIDENCE = f"""matched AS ({secrets('documents', 'doc_id', 'text')}),
evidence AS (SELECT doc_id, category, 'taint' AS via, strength FROM documents JOIN tokens ON {_SENDER} = sample AND contains(text, token) UNION ALL SELECT doc_id, category, 'pattern', 'strong' FROM matched),
best AS (SELECT * FROM evidence QUALIFY row_number() OVER (PARTITION BY doc_id, category ORDER BY via <> 'taint', strength <> 'strong') = 1),
decided AS (SELECT *, via = 'taint' AND (strength = 'strong' OR category NOT IN ({', '.join(map(text, rules.WEAK_ONLY))})) AS confirmed FROM best)"""
_COUNT = lambda patterns: " + ".join(f"CASE WHEN {hit('text', p)} THEN 1 ELSE 0 END" for p in patterns)
_HOST = "lower(regexp_extract(url, '//([^/:?#]+)', 1))"

_PURPOSE = "CASE WHEN net_socket_calls > 0 AND child_process_calls > 0 THEN 'Backdoor / Reverse shell' WHEN regexp_matches(commands, '(?i)curl') THEN 'Loader / Downloader (stager)' WHEN os_recon_calls > 0 AND http_requests > 0 THEN 'Infostealer / Reconnaissance' WHEN http_requests > 0 OR net_socket_calls > 0 THEN 'C2 beacon / Command-and-control client' WHEN eval_calls > 0 OR crypto_decrypt_calls > 0 THEN 'Obfuscated payload (staged execution)' ELSE 'No malicious behaviour observed (dynamic)' END"
_UNIQUE = lambda c: f"list_filter({c}, lambda x, i: list_position({c}, x) = i)"
DECIDED = f"decided AS (SELECT *, (['BENIGN','SUSPICIOUS','MALICIOUS'])[CASE WHEN up THEN 3 ELSE greatest(rs, rd) + 1 END] AS final, CASE WHEN up THEN 'corroboration' WHEN rs > rd THEN 'static' WHEN rd > rs THEN 'dynamic' ELSE 'both' END AS by_side FROM fused)"

SQL: dict[str, str] = {
    "confusion_matrix": BASE + f", {LONG} SELECT rule, tp, fp, fn, tn, precision, recall, {_F1}, {_ACC}, {_MCC} FROM (SELECT *, {_P} AS precision, {_R} AS recall FROM (SELECT rule, {_COUNTS('label', 'p')} FROM long WHERE label IN (0, 1) GROUP BY rule))",
    "resumed_metrics": BASE + f", {LONG} SELECT rule, tp, fp, fn, tn, precision, recall, {_F1}, {_ACC}, {_MCC} FROM (SELECT *, {_P} AS precision, {_R} AS recall FROM (SELECT rule, {_COUNTS('label', 'p')} FROM long WHERE label IN (0, 1) GROUP BY rule))",
    "evaluate_skipped": BASE + f"SELECT tp, fp, fn, tn, skipped, precision, recall, {_F1}, {_ACC} FROM (SELECT *, {_P} AS precision, {_R} AS recall FROM (SELECT {_COUNTS('label', 'p_strict')}, count(*) FILTER (label IS NULL) AS skipped FROM result))",
    "tier_breakdown": BASE + f"SELECT tier, {_V}, count(*) FILTER (v = 'BENIGN') AS benign, 0::BIGINT AS error FROM result GROUP BY tier",
    "class_breakdown": BASE + f"SELECT classification, n, malicious, flagged, malicious::DOUBLE / n AS strict_rate, flagged::DOUBLE / n AS triage_rate FROM (SELECT CASE classification WHEN '' THEN '(none)' ELSE classification END AS classification, {_V} FROM result GROUP BY 1)",
    "section_report": BASE + f", {LONG}, placed AS (SELECT *, unnest(list_filter([CASE WHEN label IS NOT NULL THEN 'labelled' END, CASE WHEN tier = 'code' THEN 'code' END, 'all'], lambda x: x IS NOT NULL)) AS section FROM long) SELECT section, rule, n, positives, negatives, tp, fp, fn, tn, {_P} AS precision, {_R} AS recall FROM (SELECT section, rule, count(*) AS n, count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives, {_COUNTS('label', 'p')} FROM placed GROUP BY section, rule)",
    "count_by_tier": f"SELECT {_TIER} AS tier, count(*) AS n FROM documents GROUP BY 1",
    "label_lookup_fallback": """WITH ver AS (SELECT l_partkey AS p, l_suppkey AS s, l_orderkey * 10 + l_linenumber AS pos, CASE WHEN l_linestatus = 'F' THEN 'Malware' ELSE 'Spam' END AS c FROM lineitem WHERE l_returnflag = 'R'),
      by_version AS (SELECT p, s, arg_max(c, pos) AS c FROM ver GROUP BY p, s), by_id AS (SELECT p, arg_min(c, pos) AS c FROM ver GROUP BY p), ext AS (SELECT p_partkey AS p FROM part WHERE p_size <= 10)
      SELECT l_orderkey, l_linenumber, coalesce(v.c, CASE WHEN e.p IS NOT NULL THEN 'Untrustworthy' END, i.c, '') AS classification, CASE coalesce(v.c, CASE WHEN e.p IS NOT NULL THEN 'Untrustworthy' END, i.c, '') WHEN 'Malware' THEN 'code' WHEN 'Spam' THEN 'policy' WHEN 'Untrustworthy' THEN 'suspect' ELSE 'unknown' END AS tier
      FROM lineitem LEFT JOIN by_version v ON v.p = l_partkey AND v.s = l_suppkey LEFT JOIN ext e ON e.p = l_partkey LEFT JOIN by_id i ON i.p = l_partkey""",
    "vsix_wins_antijoin": "WITH a AS (SELECT 'cust.' || o_custkey || '@1' AS key FROM orders WHERE o_orderstatus = 'F'), f AS (SELECT 'cust.' || c_custkey || '@1' AS key FROM customer) SELECT key, false AS is_dir, count(*) AS n FROM a GROUP BY key UNION ALL SELECT key, true, count(*) FROM f WHERE key NOT IN (SELECT key FROM a) GROUP BY key",
    "resume_antijoin": "SELECT o_orderkey AS key, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
    "tier_filter": f"SELECT doc_id, {_TIER} AS tier FROM documents WHERE lang IN ('en', 'fr')",
    "latest_only": "SELECT id, version FROM (SELECT 'Cust.c' || o_custkey AS id, year(o_orderdate) || '.' || month(o_orderdate) || '.' || day(o_orderdate) || CASE WHEN o_orderstatus = 'P' THEN '-beta' ELSE '' END AS version, o_orderdate::DATE AS d FROM orders) QUALIFY row_number() OVER (PARTITION BY id ORDER BY d DESC, version) = 1",
    "sorted_limit": "SELECT c_name AS id, c_mktsegment AS version FROM customer ORDER BY c_name, c_mktsegment LIMIT 50",
    "identify_path": "SELECT page_id, id, split_part(id, '.', 1) AS publisher, split_part(id, '.', 2) AS name, version, lower(id) || '@' || version AS key FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'Pub1.ext' || page_id ELSE 'pub.ext' || page_id END AS id, CASE page_id % 3 WHEN 0 THEN '1.2.3' WHEN 1 THEN '1.2' ELSE '2.4.0' END AS version FROM pages)",
    "rule_scan": with_(FOUND) + "SELECT doc_id, rule, points, tier FROM found",
    "two_tier_score": with_(FOUND, SCORED) + "SELECT doc_id, primary_score, support_score, score, verdict FROM scored",
    "trusted_host_filter": f"SELECT host, count(*) AS n FROM (SELECT CASE WHEN page_id % 4 = 0 THEN 'objects.githubusercontent.com' ELSE {_HOST} END AS host FROM pages) WHERE NOT {hit('host', rules.TRUSTED_HOST)} GROUP BY host",
    "recon_battery": f"SELECT doc_id, id_hits, id_hits + others AS all_hits FROM (SELECT doc_id, {_COUNT(rules.RECON_IDENTITY)} AS id_hits, {_COUNT(rules.RECON_SYSTEM + rules.RECON_NETWORK)} AS others FROM (SELECT doc_id, concat_ws('; ', text, {', '.join(pick(PROBES, f'doc_id // {k}') for k in (1, len(PROBES), 5))}) AS text FROM documents)) WHERE id_hits >= 1 AND id_hits + others >= 3",
    "invisible_unicode": r"SELECT doc_id, CAST(coalesce(list_sum(list_transform(list_filter(runs, lambda r: NOT starts_with(r, chr(127988)) AND NOT (contains(r, chr(917631)) AND length(r) <= 8)), lambda r: length(r))), 0) AS INTEGER) AS n FROM (SELECT doc_id, regexp_extract_all(text || 'x' || CASE WHEN doc_id % 2 = 0 THEN chr(127988) ELSE '' END || repeat(chr(917569), doc_id % 9), '[\x{1F3F4}]?[\x{E0000}-\x{E007F}\x{E0100}-\x{E01EF}]{4,}') AS runs FROM documents)",
    "event_cap": f"SELECT sample, count(*) AS kept, max(event_id) AS last_id FROM (SELECT event_id % {SAMPLES} AS sample, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_id % {SAMPLES} ORDER BY event_id) <= 3) GROUP BY sample",
    "event_summary": with_(LOG, SEEN) + "SELECT sample, total_events, critical_events, child_process_calls, http_requests, fs_writes_blocked, fs_reads, eval_calls, crypto_decrypt_calls, net_socket_calls, dns_lookups, os_recon_calls, coalesce(array_to_string(list_filter(hosts, lambda x, i: list_position(hosts, x) = i), '|'), '') AS unique_hosts_contacted, coalesce(array_to_string(list_filter(cmds, lambda x, i: list_position(cmds, x) = i), '|'), '') AS shell_commands_attempted FROM seen",
    "dynamic_verdict": with_(LOG, SEEN, JUDGED) + "SELECT sample, score, verdict FROM judged",
    "network_dedupe": f"SELECT page_id % 20 AS sample, {_HOST} AS domain, CASE WHEN regexp_extract(url, '//[^/?#]*:([0-9]+)', 1) IN ('80') THEN '' ELSE regexp_extract(url, '//[^/?#]*:([0-9]+)', 1) END AS port, count(*) AS repeat_count, arg_min(url, page_id) AS first_preview FROM pages GROUP BY ALL",
    "host_port_parse": f"SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '10.1.2.' || page_id % 200 ELSE {_HOST} END AS domain, CASE WHEN page_id % 3 = 0 THEN '10.1.2.' || page_id % 200 ELSE '' END AS ip, CASE WHEN page_id % 3 = 0 THEN '8443' ELSE regexp_extract(url, '//[^/?#]*:([0-9]+)', 1) END AS port FROM pages",
    "secret_classify": with_("rows AS (SELECT 'document' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'conversation', conv_id * 1000 + turn, text FROM conversations)", f"m AS ({secrets('rows', 'kind, id', 'text')})") + rf"SELECT kind, id, category, severity, {_REDACT} AS evidence FROM (SELECT *, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS s FROM m)",
    "sensitive_reads": with_(f"m AS ({secrets('documents', 'doc_id', 'text')})", "f AS (SELECT doc_id, list(category ORDER BY pos) AS found FROM m GROUP BY doc_id)") + f"SELECT doc_id, array_to_string(categories, ',') AS categories, CASE WHEN len(list_filter(categories, lambda c: c NOT IN ({', '.join(text(s.category) for s in rules.SECRETS if s.severity == 'WARN')}))) > 0 THEN 'CRITICAL' ELSE 'WARN' END AS severity, categories = ['source_code'] AS quiet FROM (SELECT doc_id, list_filter(all_c, lambda x, i: list_position(all_c, x) = i) AS categories FROM (SELECT doc_id, list_concat(CASE doc_id % 3 WHEN 0 THEN ['source_code'] WHEN 1 THEN ['ssh_private_key'] ELSE [] END, coalesce(found, [])) AS all_c FROM documents LEFT JOIN f USING (doc_id))) WHERE len(categories) > 0",
    "taint_tokens": with_(TOKENS) + "SELECT sample, item_id, category, token, strength FROM tokens",
    "taint_join": with_(TOKENS) + f"SELECT DISTINCT doc_id, item_id, token FROM documents JOIN tokens ON {_SENDER} = sample AND contains(text, token)",
    "taint_adjudicate": with_(TOKENS, EVIDENCE) + "SELECT doc_id, category, via, strength, confirmed FROM decided",
    "streaming_taint": with_(TOKENS, EVIDENCE) + "SELECT doc_id, category, via, strength, confirmed FROM decided",
    "stolen_summary": with_(TOKENS, EVIDENCE) + f"SELECT sample, len(c) > 0 AS data_stolen, array_to_string(c, ',') AS categories, array_to_string(d, ',') AS destinations, exfiltration_count, array_to_string(list_filter(m, lambda x: NOT list_contains(c, x)), ',') AS suspected, sends - exfiltration_count AS suspected_count FROM (SELECT {_SENDER} AS sample, coalesce(list_sort(list(DISTINCT category) FILTER (confirmed)), []) AS c, coalesce(list_sort(list(DISTINCT 'https://host' || doc_id % 7 || '.example/c2') FILTER (confirmed)), []) AS d, coalesce(list_sort(list(DISTINCT category) FILTER (NOT confirmed)), []) AS m, count(DISTINCT doc_id) FILTER (confirmed) AS exfiltration_count, count(DISTINCT doc_id) AS sends FROM decided GROUP BY 1)",
    "fuse_verdict": with_(FOUND, SCORED, LOG, SEEN, JUDGED, FAMILY, FUSED) + "SELECT sample, (['BENIGN','SUSPICIOUS','MALICIOUS'])[CASE WHEN up THEN 3 ELSE greatest(rs, rd) + 1 END] AS final_verdict, CAST(score AS INTEGER) AS score, CASE WHEN up THEN 'corroboration' WHEN rs > rd THEN 'static' WHEN rd > rs THEN 'dynamic' ELSE 'both' END AS decided_by, array_to_string(list_sort(names), ',') AS corroborated FROM fused",
    "families_intersect": with_(FOUND, SCORED, LOG, SEEN, JUDGED, FAMILY) + f"SELECT sample, string_agg(DISTINCT name, ',' ORDER BY name) AS families FROM ({_FAMS('scored', 'doc_id')} UNION ALL {_FAMS('judged', 'sample')} UNION ALL SELECT sample, '', unnest([]::VARCHAR[]) FROM judged) GROUP BY sample",
    "forensic_behaviours": with_(LOG, SEEN, "b AS (SELECT *, regexp_matches(commands, '(?i)(powershell|cmd\\.exe|certutil|bitsadmin|curl|wget|invoke-webrequest)') AND regexp_matches(commands, '(?i)(https?://|\\.bat|\\.ps1|\\.exe|catbox|pastebin)') AS cradle FROM seen)", "t AS (SELECT sample, list_filter([CASE WHEN child_process_calls > 0 AND cradle THEN {'title': 'Download-and-execute cradle', 'technique': 'T1059 + T1105'} END, CASE WHEN child_process_calls > 0 AND NOT cradle THEN {'title': 'OS process / shell execution', 'technique': 'T1059'} END, CASE WHEN net_socket_calls > 0 AND child_process_calls > 0 THEN {'title': 'Reverse shell', 'technique': 'T1059 + T1571'} END, CASE WHEN net_socket_calls > 0 AND child_process_calls = 0 THEN {'title': 'Raw TCP connection', 'technique': 'T1095'} END, CASE WHEN http_requests > 0 AND os_recon_calls > 0 THEN {'title': 'Host reconnaissance + transmission', 'technique': 'T1082 + T1567'} END, CASE WHEN http_requests > 0 AND os_recon_calls = 0 THEN {'title': 'Outbound C2 / data transmission', 'technique': 'T1071'} END, CASE WHEN crypto_decrypt_calls > 0 THEN {'title': 'Runtime-decrypted payload', 'technique': 'T1027 + T1140'} END, CASE WHEN eval_calls > 0 THEN {'title': 'Dynamic code evaluation', 'technique': 'T1059 + T1140'} END], lambda x: x IS NOT NULL) AS l FROM b)") + "SELECT sample, x.title AS title, x.technique AS technique FROM (SELECT sample, unnest(CASE WHEN len(l) > 0 THEN l ELSE [{'title': 'No observable malicious behaviour', 'technique': 'n/a'}] END) AS x FROM t)",
    "purpose_case": with_(LOG, SEEN, JUDGED) + f"SELECT sample, {_PURPOSE} AS purpose, CASE WHEN score >= 90 THEN 'high' WHEN score >= 60 THEN 'medium' ELSE 'low' END AS confidence, concat_ws('|', CASE WHEN contains(dests, 'ngrok') THEN 'tunnel (ngrok / cloudflare / tcp)' END, CASE WHEN contains(dests, 'api.telegram.org') THEN 'Telegram bot' END, CASE WHEN contains(dests, '8.8.4.7') THEN 'hard-coded raw IP' END) AS c2 FROM judged",
    "root_cause_fn": BASE + f"SELECT {_MISSED} AS cause, count(*) AS n FROM result WHERE label = 1 AND NOT p_strict GROUP BY 1",
    "root_cause_fp": BASE + f"SELECT {_ALARM} AS cause, count(*) AS n FROM result WHERE label = 0 AND p_triage GROUP BY 1",
    "topn_reasons": BASE + "SELECT doc_id, top_reasons FROM result WHERE top_reasons <> ''",
    "timer_expand": "WITH t AS (SELECT o_custkey % 100 AS sample, o_orderkey AS timer_id, o_orderkey % 1000 * 8640000 AS delay, unnest(range(1, CASE WHEN o_orderkey % 5 = 0 THEN 21 ELSE 2 END)) AS tick FROM orders), f AS (SELECT sample, timer_id, tick, delay + (tick - 1) * CASE WHEN delay > 0 THEN delay ELSE 1 END AS fire_at FROM t) SELECT sample, timer_id, tick, fire_at, row_number() OVER (PARTITION BY sample ORDER BY fire_at, timer_id, tick) AS \"order\" FROM f WHERE fire_at <= 366 * 86400000::BIGINT QUALIFY row_number() OVER (PARTITION BY sample ORDER BY fire_at, timer_id, tick) <= 200",
    "error_rows": "SELECT CASE WHEN doc_id % 10 = 3 THEN 'ERROR' ELSE 'BENIGN' END AS final_verdict, source AS dataset, count(*) AS n, max(CASE WHEN doc_id % 10 = 3 THEN 300 ELSE 0 END) AS longest_error FROM documents GROUP BY 1, 2",
    "files_budget": "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER w AS n, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM documents WHERE n_chars <= 2097152 WINDOW w AS (PARTITION BY source ORDER BY doc_id)) WHERE n <= 40 AND spent < 60000",
    "streaming_ingest": "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1, 2",
    "streaming_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "tier_names": "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'code' WHEN doc_id % 3 = 0 THEN 'policy' WHEN doc_id % 3 = 1 THEN 'policy' ELSE 'suspect' END AS tier FROM documents",
    "discovery_stats": with_(f"r AS (SELECT doc_id, {_TIER} AS tier, {_CLASS} AS classification FROM documents)", "c AS (SELECT * FROM r WHERE tier IN ('code', 'suspect'))") + "SELECT 'found' AS stat, CASE WHEN doc_id % 2 = 0 THEN 'folders' ELSE 'archives' END AS name, count(*) AS n FROM r GROUP BY 2 UNION ALL SELECT 'selected', 'all', count(*) FROM c UNION ALL SELECT 'excluded_by_tier', 'all', (SELECT count(*) FROM r) - (SELECT count(*) FROM c) UNION ALL SELECT 'metadata_rows', 'labels', count(*) FROM labels UNION ALL SELECT 'tier', tier, count(*) FROM c GROUP BY tier UNION ALL SELECT 'classification', classification, count(*) FROM c GROUP BY classification",
    "cause_listing": BASE + f"SELECT cause, row_number() OVER (PARTITION BY cause ORDER BY id) AS rank, id, tier FROM (SELECT {_MISSED} AS cause, lpad(doc_id::VARCHAR, 12, '0') AS id, tier FROM result WHERE label = 1 AND NOT p_strict) QUALIFY row_number() OVER (PARTITION BY cause ORDER BY id) <= 5",
}

SHAPES = "shapes(k, rule, points, tier) AS (VALUES " + ", ".join(f"({k}, {text(r)}, {p}, {text(t)})" for k, (_, r, p, t) in enumerate(SCRIPTS) if r) + ")"
SHAPED = f"shaped AS (SELECT DISTINCT doc_id, rule, points, tier FROM documents JOIN shapes ON doc_id % {len(SCRIPTS)} = k OR doc_id // {len(SCRIPTS)} % {len(SCRIPTS)} = k)"
MANIFEST = "SELECT doc_id, 'malicious postinstall lifecycle script in package.json', 40, 'primary' FROM documents WHERE doc_id % 10 = 0"
_USUAL = f"[{', '.join(map(text, USUAL_WORDS))}]"
_GATE = "'switch (x) { case ' || chr(39) || upper(left(lang, 1)) || substr(lang, 2) || chr(39) || ': if (s.includes(\"' || source || '\")) y === ' || chr(39) || lang || chr(39) || ' }' || chr(10) || text"
GATES = f"gates AS (SELECT doc_id, list_transform(list_slice(regexp_extract_all({_GATE}, {text(COMPARED)}, 1), 1, 60), lambda w: lower(w)) AS every, CASE WHEN doc_id % 3 = 0 THEN 'import x from ' || chr(39) || 'y' || chr(39) ELSE 'const x = 1' END || chr(10) || text AS source FROM documents)"
SQL |= {
    "shape_scan": with_(SHAPES, SHAPED) + "SELECT doc_id, rule, points, tier FROM shaped",
    "package_verdict": with_(FOUND.replace("found AS", "told AS", 1), SHAPES, SHAPED, f"found AS (SELECT * FROM told UNION ALL SELECT * FROM shaped UNION ALL {MANIFEST})", SCORED) + "SELECT doc_id, primary_score, support_score, score, verdict FROM scored",
    "running_ids": "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS n FROM events",
    "beacon_projection": "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS seq, CASE WHEN turn % 2 = 0 THEN 'https' ELSE 'unknown' END AS transport, 'host' || (conv_id % 5) || '.example:8443' AS host, CAST(length(text) AS INTEGER) AS body_bytes, CAST(CASE WHEN length(text) > 2000 THEN 2012 ELSE length(text) END AS INTEGER) AS shown, role FROM conversations",
    "trigger_words": with_(GATES, "told AS (SELECT *, list_filter(every, lambda w, i: list_position(every, w) = i) AS own FROM gates)") + f"SELECT doc_id, array_to_string(list_slice(list_concat(list_slice(own, 1, 14), list_filter({_USUAL}, lambda w: NOT list_contains(own, w))), 1, 14), ',') AS words, {' OR '.join(f'regexp_matches(source, {text(p)})' for p in MODULE)} AS module FROM told",
    "taint_sinks": with_(LOG) + "SELECT coalesce(url, 'process:' || command) AS destination, coalesce(url, command) AS payload, count(*) AS n FROM log WHERE module IN ('https', 'child_process') GROUP BY 1, 2",
    "streaming_first_seen": "SELECT DISTINCT user_id FROM events",
}
_RUN = (FOUND, SCORED, LOG, SEEN, JUDGED, FAMILY, FUSED, DECIDED, f"purposes AS (SELECT sample, {_PURPOSE} AS purpose FROM judged)")
_NONE = lambda c: f"CAST(coalesce({c}, 0) AS INTEGER)"
SQL |= {
    "flat_results": with_(*_RUN) + f"""SELECT CAST(d.doc_id AS VARCHAR) AS id, source AS dataset, CAST(1 - quality AS INTEGER) AS label, {_TIER} AS tier, coalesce(final, 'BENIGN') AS final_verdict, CAST(coalesce(final, '') = 'MALICIOUS' AS INTEGER) AS final_is_malicious,
      CAST(coalesce(final, 'BENIGN') <> 'BENIGN' AS INTEGER) AS final_is_flagged, coalesce(by_side, '') AS decided_by, {_NONE('f.score')} AS score, coalesce(s.verdict, 'BENIGN') AS static_verdict, {_NONE('s.score')} AS static_score, coalesce(j.verdict, 'BENIGN') AS dynamic_verdict, {_NONE('j.score')} AS dynamic_score,
      {', '.join(f"{_NONE('j.' + c)} AS {c}" for c in ('total_events', 'http_requests', 'child_process_calls', 'eval_calls', 'fs_reads', 'net_socket_calls'))}, {_NONE('j.http_requests')} AS outbound_messages,
      coalesce(array_to_string(list_slice({_UNIQUE('j.hosts')}, 1, 5), '|'), '') AS hosts, coalesce(purpose, '') AS purpose, '' AS stolen_categories, '' AS error
    FROM documents d LEFT JOIN labels USING (doc_id) LEFT JOIN decided f ON f.sample = d.doc_id LEFT JOIN scored s ON s.doc_id = d.doc_id LEFT JOIN judged j ON j.sample = d.doc_id LEFT JOIN purposes p ON p.sample = d.doc_id""",
    "evidence_digest": with_(*_RUN, "told AS (SELECT doc_id, list_slice(list(rule ORDER BY points DESC, rule), 1, 30) AS rules FROM (SELECT DISTINCT doc_id, rule, points FROM found) GROUP BY doc_id)") + f"""SELECT f.sample, final, CAST(f.score AS INTEGER) AS score, coalesce(array_to_string(rules, ' | '), '') AS iocs, purpose,
      array_to_string(list_slice({_UNIQUE('j.hosts')}, 1, 30), '|') AS hosts, j.total_events AS events FROM decided f LEFT JOIN judged j USING (sample) LEFT JOIN purposes p USING (sample) LEFT JOIN told t ON t.doc_id = f.sample""",
    "static_only_forensics": with_(FOUND, SCORED, LOG, SEEN) + """SELECT sample, CASE WHEN doc_id IS NOT NULL THEN 'T1195 / dormant first-stage' ELSE 'n/a' END AS technique FROM (
      SELECT coalesce(s.sample, c.doc_id) AS sample, c.doc_id, coalesce(child_process_calls + net_socket_calls + http_requests + crypto_decrypt_calls + eval_calls, 0) AS shown FROM seen s FULL JOIN scored c ON c.doc_id = s.sample) WHERE shown = 0""",
    "ioc_lists": with_(LOG, SEEN) + f"""SELECT sample, coalesce(array_to_string(list_slice(h, 1, 2), '|'), '') AS hosts, CASE WHEN len(h) > 2 THEN CAST(len(h) AS INTEGER) END AS hosts_truncated_from, coalesce(array_to_string(list_slice(c, 1, 2), '|'), '') AS commands,
      CASE WHEN len(c) > 2 THEN CAST(len(c) AS INTEGER) END AS shell_commands_truncated_from, http_requests AS outbound_count FROM (SELECT sample, {_UNIQUE('hosts')} AS h, {_UNIQUE('cmds')} AS c, http_requests FROM seen)""",
    "misjudged": BASE + "SELECT count(*) FILTER (label = 0 AND p_strict) AS false_positives, count(*) FILTER (label = 1 AND NOT p_strict) AS false_negatives, 0 AS errors FROM result",
}
