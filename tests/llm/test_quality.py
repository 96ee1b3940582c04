import math
import random
import tracemalloc
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np

from trawl.llm.quality import ALPHABET, BEGIN, END, ORDER, SPELT_AT_ONCE, Shard, SYMBOLS, WORD, cut, grams, judge, perplexities, spellings, squeeze, train, train_words, trigrams

SCHEMA = "doc_id long, text string, lang string, cut string, of int"


def brute_model(texts):
    """Interpolated modified Kneser-Ney over symbol tuples, straight from its definition."""
    counts = {4: Counter()}
    for t in texts:
        s = (28,) * 3 + tuple(int(ALPHABET[ord(c)]) for c in t)
        counts[4].update(s[i : i + 4] for i in range(len(s) - 3))
    for n in (3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])

    def rates(n):
        n1, n2, n3, n4 = (sum(1 for v in counts[n].values() if v == k) for k in range(1, 5))
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        raw = [k - (k + 1) * y * b / a if a and b else k * 0.5 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        return [min(max(r, 0.1), k - 0.05) for k, r in enumerate(raw, 1)]

    off, after = {n: rates(n) for n in counts}, {n: defaultdict(list) for n in counts}
    for n, held in counts.items():
        for g, c in held.items():
            after[n][g[:-1]].append(c)

    def p(g):
        n = len(g)
        if not n:
            return 1 / 32
        low, held = p(g[1:]), after[n].get(g[:-1])
        if not held:
            return low
        d = lambda c: off[n][min(c, 3) - 1] if c else 0
        c = counts[n][g]
        return (c - d(c)) / sum(held) + sum(map(d, held)) / sum(held) * low

    return p


def test_equals_definition_and_sums_to_one(spark):
    texts = ["The cat sat on the mat, the cat.", "Über 12 cafés!\n", "aaa bbb aaa abab", "the theme of thesis 9"]
    logs = train(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    assert np.allclose(np.exp(logs.astype(float)).reshape(-1, 32).sum(axis=1), 1, atol=1e-4)
    p = brute_model(texts)
    rng = np.random.default_rng(0)
    asked = [tuple(map(int, g)) for g in rng.integers(0, 32, (300, 4))] + [(19, 7, 4, 27), (28, 28, 28, 19), (0, 0, 0, 27), (27, 2, 0, 19)]
    for g in asked:
        assert math.isclose(logs[((g[0] * 32 + g[1]) * 32 + g[2]) * 32 + g[3]], math.log(p(g)), rel_tol=1e-4)


def test_rejects_junk_and_keeps_the_rest(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = judge(docs, labels)
    assert held.columns == [*docs.columns, "perplexity", "cut", "kept"]
    rows = held.join(labels, "doc_id").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.5 * len(bad)


def test_defined_results(spark):
    docs = spark.createDataFrame([(1, None, "en", "x", 1), (2, "", None, "x", 1), (3, "text here", None, "x", 1), (3, "text here", None, "x", 1)], SCHEMA)
    labels = spark.createDataFrame([(3, 1), (3, 1), (None, 1), (9, None)], "doc_id long, quality int")
    assert [(r.doc_id, r.perplexity is None, r.kept) for r in judge(docs, labels).orderBy("doc_id").collect()] == [(1, True, True), (2, True, True), (3, False, True), (3, False, True)]
    assert all(r.kept for r in judge(docs, labels.limit(0)).collect())
    assert judge(docs.limit(0), labels).collect() == []


def test_cuts_are_of_the_language(spark):
    """``cut`` and ``kept`` against plain quantiles over the held-out trusted texts; a small language isn't judged by a large one."""
    rng = random.Random(6)
    words = {"en": [f"en{i}" for i in range(3000)], "xx": [f"xx{i}" for i in range(30)], "yy": [f"yy{i}" for i in range(300)]}
    docs = [(k, " ".join(rng.choices(words[lang], k=rng.randrange(20, 60))), lang, "x", 1) for k, lang in enumerate(["en"] * 900 + ["xx"] * 200 + ["yy"] * 12)]
    docs += [(5000 + k, " ".join(rng.choices([f"junk{i}" for i in range(500)], k=30)), "xx", "x", 1) for k in range(10)]
    frame = spark.createDataFrame(docs, SCHEMA)
    labels = spark.createDataFrame([(d[0], 1) for d in docs if d[0] < 5000], "doc_id long, quality int")
    rows = judge(frame, labels).selectExpr("*", "pmod(xxhash64(text), 4) = 0 AS out", "cast(floor(log2(length(text) + 1)) AS int) AS band").collect()
    held = [r for r in rows if r.out and r.doc_id < 5000]
    quantile = lambda some: sorted(r.perplexity for r in some)[max(0, math.ceil(0.99 * len(some)) - 1)]
    for r in rows:
        groups = (([h for h in held if (h.lang, h.band) == (r.lang, r.band)], 100), ([h for h in held if h.lang == r.lang], 20), ([h for h in held if h.band == r.band], 100), (held, 0))
        want = quantile(next(g for g, least in groups if len(g) >= least))
        assert math.isclose(r.cut, want, rel_tol=1e-9) and r.kept == (r.perplexity <= r.cut)
    assert not any(r.kept for r in rows if r.doc_id >= 5000)
    assert max(r.cut for r in rows if r.lang == "xx") < min(r.cut for r in rows if r.lang == "en")


def test_words_equal_definition(spark):
    texts = ["the cat sat on the mat . the cat sat", "the dog sat on the cat", "a dog , a cat , a mat", "the the the"]
    asked = [*texts, "the cat sat on a zebra", "mat mat dog the cat", "unseen words only"]
    trusted = spark.createDataFrame([(t,) for t in texts], "text string")
    logs = train(trusted)
    read = lambda t: [BEGIN, BEGIN, *WORD.findall(t), END]
    counts = {3: Counter(tuple(w[i : i + 3]) for w in map(read, texts) for i in range(len(w) - 2))}
    for n in (2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])

    def off(n, c):
        a, b, d, e = (sum(v == k for v in counts[n].values()) for k in range(1, 5))
        y = a / (a + 2 * b) if a and b else 0.5
        raw = [k - (k + 1) * y * q / p if p and q else k * 0.5 for k, p, q in ((1, a, b), (2, b, d), (3, d, e))]
        return min(max(raw[min(c, 3) - 1], 0.1), min(c, 3) - 0.05) if c else 0

    def p(g):
        if not g:
            raise AssertionError
        low = p(g[1:]) if len(g) > 1 else math.exp(float(logs[grams("\n")][0]) if g[0] == END else float(logs[grams(g[0] + " ")].sum()))
        after = [c for k, c in counts[len(g)].items() if k[:-1] == g[:-1]]
        if not after:
            return low
        c = counts[len(g)][g]
        return (c - off(len(g), c)) / sum(after) + sum(off(len(g), k) for k in after) / sum(after) * low

    keyed = spark.createDataFrame(list(enumerate(asked)), "key long, text string").repartition(3)
    got = {r.key: r.perplexity for r in perplexities(keyed, train_words(trusted, logs), logs).collect()}
    for k, t in enumerate(asked):
        w = read(t)
        own = [math.log(p(tuple(w[i : i + 3]))) for i in range(len(w) - 2)]
        assert math.isclose(got[k], math.exp(-sum(own) / len(own)), rel_tol=1e-4)


def test_spread_words_weigh_the_same(spark):
    rng = random.Random(5)
    words = ["the", "of", "cat", "dog", "mat", "sat", "on", ",", "ran", "house"]
    texts = [" ".join(rng.choices(words, range(20, 0, -2), k=rng.randrange(1, 60))) for _ in range(60)]
    trusted = spark.createDataFrame([(t,) for t in texts[:40]], "text string").repartition(3)
    logs = train(trusted)
    keyed = spark.createDataFrame([*enumerate([*texts, "a zebra", "the", "x of the y"]), (0, texts[0])], "key long, text string").repartition(3)
    plain, one, every = (train_words(trusted, logs, share) for share in (1, 0.12, 0))
    assert not plain.hot and 0 < len(one.hot) < len(every.hot)
    plain, *spread = ({r.key: r.perplexity for r in perplexities(keyed, m, logs).collect()} for m in (plain, one, every))
    assert len(plain) == 63
    for got in spread:
        assert got.keys() == plain.keys() and all(math.isclose(got[k], plain[k], rel_tol=1e-9) for k in plain)


def test_word_order_counts(spark):
    rng = random.Random(1)
    words = [a + b for a in ("ba", "le", "ti", "mo", "su", "ra") for b in ("n", "ker", "dal", "sto", "vi")]
    follow = {w: rng.sample(words, 2) for w in words}

    def text():
        made = [rng.choice(words)]
        while len(made) < 150:
            made.append(rng.choice(follow[made[-1]]))
        return made

    good = [text() for _ in range(240)]
    rows = [(k, " ".join(w), "en", "x", 1) for k, w in enumerate(good)]
    rows += [(1000 + k, " ".join(rng.sample(w, len(w))), "en", "x", 1) for k, w in enumerate(good[:40])]
    rows += [(2000 + k, " ".join(text()), "en", "x", 1) for k in range(40)]
    labels = spark.createDataFrame([(k, 1) for k in range(240)], "doc_id long, quality int")
    kept = Counter(r.doc_id // 1000 for r in judge(spark.createDataFrame(rows, SCHEMA), labels).where("kept").collect())
    assert kept[1] == 0 and kept[2] >= 36


def test_words_are_spelt_together_as_each_alone():
    logs = np.random.default_rng(5).normal(size=SYMBOLS**ORDER).astype(np.float32)
    words = ["a", "zürich", "日", "𝒳y", "-", "x" * 70, *(f"w{i}" for i in range(SPELT_AT_ONCE))]
    alone = [logs[grams(w + " ")].sum(dtype=np.float64) for w in words]
    assert np.allclose(spellings(words, logs), alone, rtol=1e-12) and spellings([], logs).size == 0


def test_distinct_trigrams_of_a_shard_need_little_memory():
    rng = np.random.default_rng(6)
    rows = []
    for _ in range(8):
        words = np.unique(rng.integers(3, 1 << 48, 5000, np.uint64))
        rows.append((squeeze(words), *(squeeze(rng.integers(0, words.size, 50_000, np.uint32)) for _ in range(3))))
    tracemalloc.start()
    gram, n, *_ = trigrams(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n.sum() == 400_000 and (np.diff(gram.astype(np.int64)) > 0).all()
    assert peak < 110 * n.sum()


def test_words_are_cut_as_the_pattern_does():
    rng = random.Random(7)
    texts = ["", " \n\t", "a_1 b\x1c日本カ, x!!", "İΣ ΑΣ", "".join(map(chr, rng.choices([*range(1, 0xD800), *range(0xE000, 0x110000)], k=20_000)))]
    seen = {}
    for text in texts:
        hashes, starts, ends = cut(text)
        words = [text[a:b] for a, b in zip(starts, ends, strict=True)]
        assert words == WORD.findall(text)
        assert all(seen.setdefault(w, h) == h for w, h in zip(words, hashes.tolist(), strict=True))
    assert len(set(seen.values())) == len(seen)


def test_model_on_disk_holds_each_trigram_once(spark):
    rng, sizes = random.Random(8), []
    for n in (100, 6400):
        texts = [" ".join(rng.choices("abcdef", k=40)) for _ in range(n)]
        trusted = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
        model = train_words(trusted, np.full(SYMBOLS**ORDER, -1, np.float32))
        sizes.append(sum(f.stat().st_size for f in Path(model.folder.removeprefix("file:")).rglob("*.parquet")))
    assert sizes[1] < 1.5 * sizes[0]


def test_weights_of_a_shard_need_little_memory():
    rng, n = np.random.default_rng(3), 300_000
    word = np.sort(rng.integers(0, 1 << 48, 60_000).astype(np.uint64))
    first, middle, last = (np.minimum(rng.zipf(1.2, n), word.size - 1).astype(np.uint32), rng.integers(0, 1200, n).astype(np.uint32), rng.integers(0, word.size, n).astype(np.uint32))
    row = tuple(map(squeeze, (word, first, middle, last, np.ones(n, np.uint32))))
    side = tuple(map(squeeze, (np.full(word.size, 1, np.uint8), word, np.ones(word.size), np.full(word.size, -10.0))))
    tracemalloc.start()
    Shard({k: [0.5, 0.9, 1.2] for k in (1, 2, 3)}, 10**7, 0.5, {3: 0.1}, side, row)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 180 * n
