"""The one scan for all patterns that comes before the rules, and texts that are searched once."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tests.test_rules import FIRES, SHARED, scan
from trawl.functions import rules
from trawl.functions.text import any_hit, hit
from trawl.operators import taint
from trawl.operators.taint import content_secrets, may_hold_plain, may_hold_secrets, sensitive_reads


def test_scan_loses_no_match(spark):
    rng = random.Random(5)
    bits = [*FIRES.values(), *SHARED.values(), "\x0b", "\t", "\n", " ", "é", "x", "net", "user", "\u212a", "http://8.8.4.7/", "0x0.st"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(1, 4)))[rng.randrange(0, 9) :] for _ in range(600)] + ["reg\x0badd\x0bCurrentVersion\\Run", "JSON.stringify\x0b(process.env", None, ""]
    patterns = [*(r.pattern for r in rules.TEXT_RULES), rules.REMOTE_BINARY, rules.LOLBIN, rules.EXEC]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", *(hit(F.col("t"), p).alias(f"h{k}") for k, p in enumerate(patterns)), any_hit(F.col("t"), patterns).alias("any")).collect()
    assert all(r["any"] for r in rows if any(r[1:-1])) and sum(any(r[1:-1]) for r in rows) > 300
    assert [r["any"] for r in rows[-2:]] == [None, False]


@pytest.mark.parametrize("text", ["localgroup; child_process; tasklist; systeminfo; net", "/c curl 'x | sh; http://a.example/a.exe' cmd", "Run'; reg add x; CurrentVersion"])
def test_no_match_over_the_ends_of_a_text(spark, text):
    """A text was searched in two copies, and a match could begin in one and end in the other."""
    assert not {r for _, r in scan(spark, [("s", "a.js", text)])} & {"host reconnaissance battery (3 enumeration commands incl. 1 account/privilege probe(s))"}
    seen = {r.reason for r in rules.TEXT_RULES if spark.createDataFrame([(text,)], "t string").select(hit(F.col("t"), r.pattern)).first()[0]}
    assert {r for _, r in scan(spark, [("s", "a.js", text)])} & {r.reason for r in rules.TEXT_RULES} == seen


def test_decoded_texts_are_searched_beside_the_text(spark):
    assert {("e", "chat-app webhook used for exfiltration (Discord / Slack)")} <= scan(spark, [("e", "a.js", "\\x64iscord.com/api/webhooks/1")])


def test_secrets_behind_one_scan_equal_those_without(spark):
    rng = random.Random(6)
    bits = ["AKIA" + "A" * 16, "password = x", "TOKEN\x0b:\x0by", '"private_key":\x0b"-----BEGIN', "npm_" + "a" * 20, "ghp_" + "b" * 20, "xoxb-0123456789", "sk-" + "c" * 20, "rk_live_" + "d" * 20, "Bearer\x0b" + "e" * 15, "f" * 64, "[1" + ", 2" * 31 + "]", '"mnemonic" :', "refresh_token=", "word " * 13, "\n", " ", "é"]
    rows = spark.createDataFrame([("".join(rng.choices(bits, k=rng.randrange(0, 4)))[rng.randrange(0, 3) :],) for _ in range(400)] + [(None,)], "t string")
    both = rows.select("t", may_hold_secrets(F.col("t")).alias("l")).select(content_secrets(F.col("t")).alias("plain"), content_secrets(F.col("t"), F.col("l")).alias("gated")).collect()
    assert all(r.plain == r.gated for r in both) and len({s.category for r in both for s in r.plain or []}) > 10


PHRASE = "twelve words that are all made from small letters only come here"
READ = "sample_key long, seq long, path string, content string"


def test_plain_secrets_behind_their_scan_equal_those_without(spark):
    rng = random.Random(7)
    words = [*PHRASE.split(), "to", "a", "Capital", "longerthaneight", "x9", "é", "straße", "123", "password:"]
    gaps = [" "] * 60 + ["\n", "\x0b", "\t ", ", ", "\u00a0"]
    phrase = lambda some: "".join(rng.choice(some) + rng.choice(gaps) for _ in range(rng.randrange(8, 40)))
    texts = [rng.choice(["", "_", "é", "."]) + phrase(rng.choice([words[:12], words[:16], words])) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in [*texts, PHRASE, "", None]], "t string").select("t", may_hold_secrets(F.col("t")).alias("l"), may_hold_plain(F.col("t")).alias("p"))
    both = rows.select(content_secrets(F.col("t")).alias("plain"), content_secrets(F.col("t"), F.col("l"), F.col("p")).alias("gated")).collect()
    assert all(r.plain == r.gated for r in both) and 100 < sum("seed_phrase" in {s.category for s in r.plain or []} for r in both) < 400


def test_sensitive_reads_try_rules_only_on_what_the_scans_found(spark):
    rows = [(1, 1, "/x/a.txt", PHRASE), (1, 1, "/x/a.txt", PHRASE), (2, 1, "/x/a.py", "TOKEN = abc; " + PHRASE), (3, 1, "/home/u/.ssh/id", None), (4, 1, None, "AKIA" + "A" * 16), (5, 1, None, None), (6, 1, "", ""), (None, None, "b.txt", "f" * 64), (7, 1, "b.txt", "few words")]
    found = sensitive_reads(spark.createDataFrame(rows, READ))
    got = sorted((r.sample_key or 0, r.categories, [s.raw for s in r.secrets], r.severity, r.quiet) for r in found.drop("content").collect())
    seed = (1, ["seed_phrase"], [PHRASE], "CRITICAL", False)
    assert got == sorted([seed, seed, (2, ["source_code", "dotenv_secrets", "seed_phrase"], ["TOKEN = abc;", PHRASE], "CRITICAL", False), (3, ["ssh_private_key"], [], "CRITICAL", False), (4, ["aws_credentials"], ["AKIA" + "A" * 16], "CRITICAL", False), (0, ["crypto_wallet"], ["f" * 64], "CRITICAL", False)])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and len(re.findall(r"scan\(content#\d+\)", plan.split("ArrowEvalPython")[1].split("\n")[0])) == 2
    tried = re.findall(r"raw, CASE WHEN (\w+)#\d+ THEN", plan)
    assert len(tried) == sum(1 for s in rules.SECRETS if s.content) and set(tried) == {"_likely", "_plain"}


def test_tokens_are_broadcast_only_up_to_a_bound(spark, monkeypatch):
    tokens = spark.createDataFrame([(1, 1, "p", 0, "c", "a secret of many letters", "strong")], "sample_key long, seq long, path string, pos int, category string, token string, strength string")
    sends = spark.createDataFrame([(1, 2, "d", "x a secret of many letters y"), (2, 2, "d", "a secret of many letters")], "sample_key long, seq long, destination string, payload string")
    found = []
    for most in (taint.BROADCAST_GRAMS, 0):
        monkeypatch.setattr(taint, "BROADCAST_GRAMS", most)
        found.append(sorted((r.sample_key, r.send_seq, r.token) for r in taint.flows(tokens, sends).collect()))
    assert found[0] == found[1] == [(1, 2, "a secret of many letters")]
