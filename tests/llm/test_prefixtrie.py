import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from trawl.llm.prefixtrie import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, key string"
LAST = object()


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            pair = (role or "", text or "")
            own[c].append(((turn is not None, turn or 0), hashlib.md5(f"{len(pair[0].encode())}:{pair[0]}{pair[1]}".encode()).hexdigest(), pair))
    own = {c: [t[2] for t in sorted(x, key=lambda t: t[:2])] for c, x in own.items()}
    members, ends, children = defaultdict(set), defaultdict(set), defaultdict(set)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
            if d:
                children[path[: d - 1]].add(path[:d])
        ends[path].add(c)
    totals = {}
    for node in sorted(members, key=len, reverse=True):
        saved = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        below = [totals[x] for x in children[node]]
        totals[node] = (sum(x[0] for x in below) or 1, saved + sum(x[1] for x in below))
    out = []
    for node, convs in members.items():
        parent = min(members[node[:-1]]) if node else None
        sha = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        out.append((min(convs), len(node), parent, len(convs), len(children[node]), *totals[node], sha))
    return sorted(out, key=str)


def run(spark, rows):
    frame = spark.createDataFrame([(*r, 7, "clash") for r in rows], SCHEMA)
    return sorted(map(tuple, trie(frame).collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(400), 90):
        for turn in range(rng.choice([1, 2, 3, 5, 9, 12, 30])):
            rows.append((c, rng.choice([turn, turn, turn, None, 3]), rng.choice(["user", "user", "bot", None]), rng.choice(["a", "a", "é", "long text", "", None])))
    rows += [(c, turn, "user", f"same {turn}") for c in range(1000, 1200, 5) for turn in range(6)]
    rows += [(c, 0, "user", "only") for c in range(2001, 2100, 5)]
    rows += [(3000, turn, "user", "x") for turn in range(700)] + [(3002, turn, "user", "x") for turn in range(300)]
    rows += [(None, 1, "user", "nobody"), rows[0], rows[0]]
    assert run(spark, rows) == brute(rows)


def test_one_conversation_that_a_third_of_all_are(spark):
    rows = [(5 * c, turn, "user", "hot" if c % 3 == 0 else f"{c % 40}") for c in range(300) for turn in range(4)]
    assert run(spark, rows) == brute(rows)


def test_small_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, 1, "user", "x")]) == []
    turnless = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9)
    assert run(spark, [(turnless, 0, "user", "x")]) == brute([(turnless, 0, "user", "x")])
    assert run(spark, [(0, 0, None, None)]) == brute([(0, 0, None, None)])


def test_the_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert run(spark, rows) == brute(rows)


def test_equals_its_sql(spark, sf):
    import duckdb

    from trawl.llm.queries import ORACLES, op11_prefix_trie

    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS FROM read_parquet('{sf}/conversations.parquet')")
    want, got = con.sql(ORACLES["op11_prefix_trie"]), op11_prefix_trie(spark, sf)
    assert want.columns == got.columns
    assert sorted(want.fetchall(), key=str) == sorted(map(tuple, got.collect()), key=str)
