"""Fixed schemas of inputs and results; nothing is inferred."""

from __future__ import annotations

#: One row for each package: its key is lower(id)@version, and keys may repeat.
SAMPLES = "key string, id string, publisher string, name string, version string, target string, is_dir boolean, dataset string, dataset_kind string, label int, classification string, tier string"
FILES = "sample_key string, path string, size long, content string"
EVENTS = "sample_key string, id int, severity string, module string, function_hooked string, arguments map<string,string>"
BEACONS = "sample_key string, seq int, transport string, destination string, host string, method string, body string, body_bytes int, decoded string"
FINDINGS = "sample_key string, points int, reason string, file string, detail string, tier string"
REASON = "struct<points:int,reason:string>"

#: The flat result row, in this order.
RESULT_COLUMNS = [
    "dataset", "sample", "id", "version", "label", "tier", "classification", "final_verdict", "final_is_malicious", "final_is_flagged", "decided_by", "score",
    "static_verdict", "static_score", "dynamic_verdict", "dynamic_score", "total_events", "http_requests", "child_process_calls", "outbound_messages", "eval_calls", "fs_reads", "net_socket_calls",
    "data_stolen", "stolen_categories", "hosts", "purpose", "timers_fired", "virtual_days", "timed_out", "error", "top_reasons", "target",
]
_NUMBERS = {
    "label", "final_is_malicious", "final_is_flagged", "score", "static_score", "dynamic_score", "total_events", "http_requests", "child_process_calls", "outbound_messages", "eval_calls", "fs_reads",
    "net_socket_calls", "data_stolen", "timers_fired", "timed_out",
}
RESULTS = ", ".join(f"{c} {'int' if c in _NUMBERS else 'double' if c == 'virtual_days' else 'string'}" for c in RESULT_COLUMNS)
RESULTS_TEXT = ", ".join(f"{c} string" for c in RESULT_COLUMNS)
