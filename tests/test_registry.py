"""The stateful registry against the batch join, over several files and a restart."""

from pyspark.sql import functions as F

from trawl.operators import taint
from trawl.streaming.ingest import read_stream
from trawl.streaming.registry import append_judged

EVENT = "sample_key long, seq long, path string, content string, destination string, payload string"
SCHEMA = EVENT + ", at_ms long"
KEY = "AKIA" + "ABCDEFGHIJKLMNOP"
LINE = "a proprietary line that is long enough to be traced"
ROWS = [
    [(1, 1, "/home/u/.ssh/id_rsa", f"x\n{LINE}\n", None, None), (2, 1, "/home/u/.aws/credentials", f"key {KEY}", None, None), (3, 4, None, None, "https://early", LINE)],
    [(1, 2, None, None, "https://a", f"sent: {LINE}!"), (2, 2, None, None, "https://b", f"q={KEY}"), (3, 5, "/home/u/.ssh/id_rsa", LINE, None, None)],
    [(1, 9, None, None, "https://c", "nothing"), (3, 5, None, None, "https://same", LINE), (3, 6, None, None, "https://late", LINE), (4, 1, None, None, "https://d", f"unread {KEY}")],
]


def timed(spark, rows):
    return spark.createDataFrame(rows, EVENT).selectExpr("*", "seq * 1000 AS at_ms")


def test_entries_lapse(spark, tmp_path):
    source, sink, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "progress"))
    for rows in ROWS[:2]:
        timed(spark, rows).coalesce(1).write.mode("append").parquet(source)
    append_judged(read_stream(spark, source, SCHEMA, 10), sink, checkpoint, keep_ms=500).awaitTermination()
    assert not [r for r in spark.read.parquet(sink).collect() if r.via == "taint"]


def test_a_restarted_stream_equals_the_batch(spark, tmp_path):
    source, sink, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "progress"))
    for rows in ROWS:
        timed(spark, rows).coalesce(1).write.mode("append").parquet(source)
        append_judged(read_stream(spark, source, SCHEMA, 1), sink, checkpoint).awaitTermination()  # a new query for each file
    every = timed(spark, [r for rows in ROWS for r in rows])
    sends = every.where("destination IS NOT NULL").select("sample_key", "seq", "destination", "payload")
    want = taint.adjudicate(taint.taint_tokens(every.where("path IS NOT NULL").select("sample_key", "seq", "path", "content")), sends)
    got = spark.read.parquet(sink)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))
    assert {(r.destination, r.via) for r in got.collect()} == {("https://a", "taint"), ("https://b", "taint"), ("https://late", "taint"), ("https://d", "pattern")}


def test_tokens_are_found_wherever_they_stand(spark):
    """The gram index against a plain search, at every offset and length, in every alphabet."""
    texts = ["".join(chr(97 + (7 * i + k) % 26) if i % 5 else "é" for i in range(90)) for k in range(5)]
    reads = [(1, k, t[a : a + n], "strong") for k, t in enumerate(texts) for a, n in ((0, 12), (3, 13), (5, 23), (7, 24), (8, 25), (11, 60), (30, 60))] + [(1, 9, "-" * 24, "weak"), (1, 9, "absent token here", "weak")]
    tokens = spark.createDataFrame(reads, "sample_key long, seq long, token string, strength string").selectExpr("*", "'/p' AS path", "0 AS pos", "'c' AS category")
    payloads = [(1, 100 + k, "x", "." * k + t) for k in range(30) for t in texts[k % 5 : k % 5 + 1]] + [(1, 200, "x", "-" * 400), (2, 201, "x", texts[0]), (1, 0, "x", texts[1]), (1, 202, "x", ""), (1, 203, "x", None)]
    sends = spark.createDataFrame(payloads, "sample_key long, seq long, destination string, payload string")
    got = {(r.send_seq, r.token) for r in taint.flows(tokens, sends).collect()}
    assert got == {(s, t) for k, s, _, p in payloads for j, q, t, _ in reads if j == k and q < s and p and t in p}
    assert len(got) > 100


def test_the_first_tokens_of_a_sample_count(spark):
    reads = spark.createDataFrame([(1, k, f"/home/u/{k}/.env", f"line number {k:06d} of a long file") for k in range(300)], "sample_key long, seq long, path string, content string").repartition(7)
    kept = taint.taint_tokens(reads).agg(F.min("seq"), F.max("seq"), F.count("*")).first()
    assert tuple(kept) == (0, 119, 120)
