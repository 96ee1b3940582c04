import math

import numpy as np

from trawl.llm.embeddings import near_vectors, plan_of

SCHEMA = "vec_id long, embedding array<float>, label int, cid long, root string"


def brute(rows, threshold=0.98):
    def sound(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    unit = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if sound(v, y) else None for _, v, y in rows]
    near = [
        [j for j in range(len(rows)) if j != i and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and unit[i].size == unit[j].size and unit[i] @ unit[j] >= threshold]
        for i in range(len(rows))
    ]
    low = [r[0] for r in rows]
    for _ in rows:
        low = [min([low[i], *(low[j] for j in near[i])]) for i in range(len(rows))]
    return sorted((r[0], len(n), c, r[0] == c) for r, n, c in zip(rows, near, low, strict=True))


def test_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g in range(12):
        centre = rng.normal(size=32)
        for _ in range(int(rng.integers(1, 14))):
            rows.append((len(rows), (centre + rng.normal(size=32) * 0.06).astype(np.float32).tolist(), g % 3))
    rows += [(200 + i, rows[0][1], rows[0][2]) for i in range(5)] + [(200, rows[0][1], rows[0][2])]
    zero = [0.0] * 32
    rows += [(300, None, 1), (301, zero, 1), (302, [float("nan"), *zero[1:]], 1), (303, [float("inf"), *zero[1:]], 1), (304, [None, *rows[0][1][1:]], 0), (305, rows[0][1], None), (306, [], 1), (307, [1.0, 2.0], 0), (308, [2.0, 4.0], 0)]
    frame = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA)
    expected = brute(rows)
    assert sorted(map(tuple, near_vectors(frame).collect())) == expected
    assert sorted(map(tuple, near_vectors(frame, block_rows=3).collect())) == expected


def test_finds_what_the_table_holds(spark):
    path = "/root/testdata/sf0.1/embeddings.parquet"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(path).collect()]
    expected = {r[0]: r[1] for r in brute(rows)}
    got = {r.vec_id: r.n_links for r in near_vectors(spark.read.parquet(path)).collect()}
    assert all(got[k] <= n for k, n in expected.items())
    assert sum(got.values()) >= 0.99 * sum(expected.values())


def test_empty_table(spark):
    assert near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []


def test_bits_follow_the_classes_and_tables_hold_the_recall():
    assert plan_of(0, 0.98) == plan_of(200_000, 0.98) == (10, 10)
    for n in (10**6, 10**7, 10**9):
        tables, bits = plan_of(n, 0.98)
        assert n / 2**bits <= 256 and 1 - (1 - (1 - math.acos(0.98) / math.pi) ** bits) ** tables >= 0.999
    assert plan_of(10**9, 1.0)[0] == 1
