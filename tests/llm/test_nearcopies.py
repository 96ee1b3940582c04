import random

import numpy as np

from trawl.llm import nearcopies
from trawl.llm.nearcopies import common_shingles, firsts_of, near_copy_groups, shingle_sets, without_near_copies

SCHEMA = "doc_id long, text string, fp string, pair int, first long"


def shingles(text):
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def components(texts):
    """The smallest id reachable by links of true Jaccard similarity 0.8."""
    sets = {k: shingles(t) for k, t in texts.items()}
    holders = {}
    for k, s in sets.items():
        for x in s or {None}:
            holders.setdefault(x, []).append(k)
    low = {k: k for k in sets}
    near = {k: [k] for k in sets}
    for k, s in sets.items():
        for o in {o for x in s or {None} for o in holders[x]}:
            if not s and not sets[o] or 5 * len(s & sets[o]) >= 4 * len(s | sets[o]):
                near[k].append(o)
    while (new := {k: min(low[o] for o in near[k]) for k in sets}) != low:
        low = new
    return low


def edited(rng, text, share):
    return " ".join(w if rng.random() > share else f"new{rng.randrange(10**6)}" for w in text.split())


def corpus():
    rng = random.Random(5)
    words = [f"word{i}" for i in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.choice([3, 8, 60, 200, 500]))) for _ in range(120)]
    texts += [edited(rng, t, share) for t in texts[:60] for share in (0.0, 0.01, 0.02, 0.03, 0.05, 0.1)]  # under, over and about 0.8
    texts += [edited(rng, texts[100], 0.02) for _ in range(150)] + ["", "", "one", "one"]
    return {k: t for k, t in enumerate(texts)}


def test_groups_equal_true_similarity(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "FEW_PAIRS", 8)
    texts, rows = corpus(), []
    rows = [(k, t, "clash", 1, 2) for k, t in texts.items()]
    want = components(texts)
    assert 100 < sum(k != v for k, v in want.items()) < len(want) - 50
    for block_rows in (50, 4096):
        got = {r.doc_id: r.component_id for r in near_copy_groups(spark.createDataFrame(rows, SCHEMA), block_rows=block_rows).collect()}
        assert got.keys() == want.keys()
        assert all(want[v] == want[k] for k, v in got.items())  # none is linked below the similarity
        linked = [k for k, v in want.items() if k != v]
        assert sum(got[k] == want[k] for k in linked) >= 0.99 * len(linked)


def test_what_stays(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(5, text, "", 1, 1), (3, text + " more", "", 1, 1), (None, text, "", 1, 1), (None, None, "", 1, 1), (8, None, "", 1, 1), (9, "", "", 1, 1), (4, "a b c", "", 1, 1), (4, text, "", 1, 1), (7, "a b d", "", 1, 1)]
    frame = spark.createDataFrame(rows, SCHEMA)
    kept = without_near_copies(frame)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 0, 3, 4, 4, 7, 8]  # 4 stands for its first text, so both its rows stay
    assert without_near_copies(frame.limit(0)).collect() == []


def test_common_shingles(monkeypatch):
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 500, n)).astype(np.uint64) for n in rng.integers(0, 300, 40)]
    x, y = np.nonzero(np.triu(np.ones((40, 40), bool), 1))
    want = [len(set(sets[i].tolist()) & set(sets[j].tolist())) for i, j in zip(x, y, strict=True)]
    monkeypatch.setattr(nearcopies, "SHINGLES_AT_ONCE", 7)
    assert common_shingles(sets, x, y).tolist() == want
    assert common_shingles(sets, x[:9], y[:9]).tolist() == want[:9]


def test_shuffle_follows_the_input(spark):
    rng = random.Random(9)

    def written(n):
        """Bytes shuffled for so many texts that have nothing in common."""
        texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(12)) for _ in range(n)]
        rows = spark.createDataFrame([(k, t, "", 1, 1) for k, t in enumerate(texts)], SCHEMA)
        store = spark._jsc.sc().statusStore()
        total = lambda: sum(store.executorList(False).apply(k).totalShuffleWrite() for k in range(store.executorList(False).size()))
        before = total()
        assert near_copy_groups(rows, block_rows=50).where("doc_id <> component_id").isEmpty()
        return total() - before

    assert 0 < written(6000) < 6 * written(1500)


def test_shingle_sets(monkeypatch):
    texts = [b"", None, b" a  B c ", b"A b\tc", b"a b", b"ab", "é É x y z w é É x y z".encode(), b"\x1ca b c d", b"one two three four five", b"One two\nthree four five six", b"b a"]
    for at_once in (1, 1 << 18):
        monkeypatch.setattr("trawl.llm.nearcopies.TEXT_AT_ONCE", at_once)
        got = [frozenset(s.tolist()) for s in shingle_sets(texts, 5)]
        words = [(t or b"").lower().split() for t in texts]
        want = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
        assert [len(s) for s in got] == [len(s) for s in want]
        for a, x in zip(got, want, strict=True):
            assert [len(a & b) for b in got] == [len(x & y) for y in want]


def test_similar_sets_share_a_first_shingle():
    for size in range(1, 60):
        for other in range(size, 75):
            least = next((c for c in range(size + 1) if 5 * c >= 4 * (size + other - c)), None)  # so many in common are similar
            if least is not None:  # at worst what isn't common comes first in both
                assert firsts_of(size, 0.8) > size - least and firsts_of(other, 0.8) > other - least
