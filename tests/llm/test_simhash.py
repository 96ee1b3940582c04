import numpy as np
import xxhash

from trawl.llm.simhash import fingerprint, linked, radius_for, shingle_hashes, simhash_groups, wide_fingerprint

SCHEMA = "doc_id long, text string, fp string, root int"


def brute(rows):
    """Fingerprints bit by bit and components by plain propagation."""
    fps = []
    for _, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = [w for w in low.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    low = [d for d, _ in rows]
    for _ in rows:
        low = [min(low[j] for j in range(len(rows)) if (fps[i] ^ fps[j]).bit_count() <= 4) for i in range(len(rows))]
    return sorted((d, f"{f:016x}", c) for (d, _), f, c in zip(rows, fps, low, strict=True))


def test_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}É" for i in range(50)]
    base = [" ".join(rng.choice(vocabulary, 200)) for _ in range(6)]
    rows = [(10 * i + j, t.replace("w1", "W1", j) + " tail" * (j % 3)) for i, t in enumerate(base) for j in range(9)]
    rows += [(900, None), (901, ""), (902, "one"), (902, "one"), (903, "a b c"), (904, " x \t y\n"), (905, "z " * 5000)]
    docs = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], SCHEMA)
    got = simhash_groups(docs, block_rows=7)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_tiles_lose_no_link():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**63, 900, np.int64).view(np.uint64)
    b = np.concatenate([a[:300] ^ np.uint64(0b1011), rng.integers(0, 2**63, 300, np.int64).view(np.uint64)])
    moved, root = (x.ravel() for x in linked(a[:, None], b[:, None], 4))
    assert {frozenset(p) for p in zip(moved.tolist(), root.tolist(), strict=True)} == {frozenset((int(x), int(x) ^ 0b1011)) for x in a[:300]}


def test_empty_table(spark):
    assert simhash_groups(spark.createDataFrame([], SCHEMA)).collect() == []


def test_words_split_on_ascii_space_only():
    assert fingerprint("a b".encode(), 4) == fingerprint("A B".encode(), 4) != fingerprint(b"a b", 4)


def test_wide_fingerprints_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(vocabulary, 120)) for _ in range(40)]
    texts += [" ".join(w if i % 60 != k else "x" for i, w in enumerate(t.split())) for k, t in enumerate(texts[:20])]
    docs = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[1]), (None, texts[1])]
    fps = [wide_fingerprint(shingle_hashes(t.encode(), 5), 4) for _, t in docs]
    assert all(int(f[0]) == fingerprint(t.encode(), 5) for f, (_, t) in zip(fps, docs, strict=True))
    radius = radius_for(0.8, 256)
    near = lambda a, b: int(np.bitwise_count(a ^ b).sum()) <= radius
    low = {i: i for i, _ in docs if i is not None}
    for _ in low:
        low = {i: min(low[j] for j, g in enumerate(fps[:60]) if near(fps[i], g)) for i in low}
    assert {i for i, k in low.items() if i != k} >= set(range(40, 60))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in simhash_groups(table, 5, radius, block_rows=9, lanes=4).collect() if r.doc_id is not None} == set(low.items())


def test_radius_and_null_ids(spark):
    assert radius_for(1.0, 256) == 0 and 38 < radius_for(0.8, 256) < 52
    docs = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (7, "a b c d e f"), (None, "x y")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in simhash_groups(docs).collect()) == [(0, 0), (0, 7), (0, 7), (7, 7)]
