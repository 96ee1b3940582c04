import random
import re

from trawl.llm.decontaminate import clean, common, leaks

SCHEMA = "doc_id long, text string, item_id long, passage int"


def test_common_equals_plain_dynamic_programming():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(1, 20))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(max(new[-1], row[j + 1], row[j] + (x == y)))
            row = new
        assert common(a, b) == row[-1]


def fixture(spark):
    rng = random.Random(5)
    vocabulary = [f"wort{i}" for i in range(3000)] + ["the", "of"] * 400
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, text(rng.randrange(15, 130))) for k in range(30)]
    docs, truth = [], set()
    for d in range(300):
        w = text(rng.randrange(5, 400))
        if d % 10 == 0:
            item = items[d // 10][1][:]
            if d % 20 == 0:  # paraphrase: every sixth word is another
                item = [rng.choice(vocabulary) if i % 6 == 5 else x for i, x in enumerate(item)]
            at = rng.randrange(len(w))
            w[at:at] = item
            truth.add((d, d // 10))
        docs.append((d, " ".join(w).capitalize() + ".", 1, 2))
    docs += [(900, None, 1, 1), (901, "", 1, 1), (0, docs[0][1], 1, 1)]
    marks = [(k, " ".join(w), "x") for k, w in items] + [(900, None, "x"), (901, "", "x"), (902, "the of the of the of the of the", "x"), (None, "wort1 " * 20, "x")]
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(marks, "item_id long, text string, doc_id string"), truth


def test_finds_planted_items_only(spark):
    docs, marks, truth = fixture(spark)
    got = leaks(docs, marks).collect()
    assert {(r.doc_id, r.item_id) for r in got} == truth and len(got) == len(truth) + 1
    for block in (1, 7):  # an item's passages in several blocks are still one row
        again = leaks(docs, marks, block=block).collect()
        assert {(r.doc_id, r.item_id) for r in again} == truth and len(again) == len(truth) + 1
    left = clean(docs, marks)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in truth}


def test_equals_brute_force_on_the_table(spark, sf):
    docs, marks = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    flat = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    items = [(r.item_id, f" {flat(r.text)} ") for r in marks.collect()]
    whole = {(r.doc_id, i) for r in docs.collect() for i, t in items if t in f" {flat(r.text)} "}
    got = {(r.doc_id, r.item_id) for r in leaks(docs, marks).collect()}
    assert whole and whole <= got and len(got) <= 1.2 * len(whole)


def test_empty_tables(spark):
    docs, marks, _ = fixture(spark)
    assert leaks(docs.limit(0), marks).collect() == [] == leaks(docs, marks.limit(0)).collect()


def test_finds_items_that_most_documents_hold_or_a_word_drowns(spark):
    rng = random.Random(8)
    vocabulary = [f"wort{i}" for i in range(2000)]
    hot, rare = (rng.sample(vocabulary, 20) for _ in range(2))
    docs = [(d, " ".join(rng.choices(vocabulary, k=60) + (hot if d % 2 else []) + rng.choices(vocabulary, k=60)), 1, 1) for d in range(200)]
    docs.append((500, " ".join([*rare, *rare[:1] * 200]), 1, 1))
    marks = [(1, " ".join(hot), "x"), (2, " ".join(rare), "x")]
    got = leaks(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(marks, "item_id long, text string, doc_id string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(d, 1) for d in range(1, 200, 2)} | {(500, 2)}


def test_short_items_null_ids_and_synonyms(spark):
    rng = random.Random(9)
    vocabulary = [f"wort{i}" for i in range(2000)]
    twin = {w: f"zwilling{i}" for i, w in enumerate(vocabulary)}
    items = [(k, rng.sample(vocabulary, 40)) for k in range(20)]
    docs = [(None, " ".join(rng.choices(vocabulary, k=50) + items[0][1] + rng.choices(vocabulary, k=50)), 1, 1), (None, " ".join(rng.choices(vocabulary, k=90)), 1, 1)]
    docs += [(d, " ".join(rng.choices(vocabulary, k=30) + ["fünf", "kurze", "Wörter", "am", "Ort"] * (d % 2) + rng.choices(vocabulary, k=3000)), 1, 1) for d in range(10)]
    docs += [(10, "fünf kurze am Wörter Ort fünf kurze x Wörter am Ort", 1, 1)]
    for k, w in items[1:]:  # three words in ten are synonyms, and two neighbours in eight change places
        said = [twin[x] if i % 10 in (2, 5, 8) and i < 32 else x for i, x in enumerate(w)]
        for i in range(0, 32, 8):
            said[i], said[i + 1] = said[i + 1], said[i]
        docs.append((100 + k, " ".join(rng.choices(vocabulary, k=100) + said + rng.choices(vocabulary, k=100)), 1, 1))
    marks = [(k, " ".join(w), "x") for k, w in items] + [(50, "Fünf kurze Wörter am Ort", "x"), (51, "wort1 nirgends", "x")]
    docs, marks = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(marks, "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id) for r in leaks(docs, marks).collect()}
    assert {p for p in got if p[1] in (50, 51) or p[0] is None} == {(None, 0)} | {(d, 50) for d in range(1, 10, 2)}
    assert len(got & {(100 + k, k) for k in range(1, 20)}) >= 0.9 * 19 and got <= {(None, 0)} | {(d, 50) for d in range(1, 10, 2)} | {(100 + k, k) for k in range(20)}
    left = clean(docs, marks)
    assert left.where("doc_id IS NULL").count() == 1 and left.where("doc_id < 10").count() == 5


def test_finds_reordered_items(spark):
    """Items in noise whose halves or thirds have changed places, with words between them; and none that only share words."""
    rng = random.Random(12)
    vocabulary = [f"wort{i}" for i in range(2500)] + ["the", "of", "and"] * 300
    noise = lambda n: rng.choices(vocabulary, k=n)
    items = [(k, noise(45)) for k in range(40)]
    docs = []
    for k, w in items:
        halves, thirds = w[22:] + w[:22], w[30:] + w[15:30] + w[:15]
        docs += [(100 + k, halves), (200 + k, thirds), (300 + k, w[22:] + noise(5) + w[:22]), (400 + k, rng.sample(w, len(w)))]
    frame = spark.createDataFrame([(d, " ".join(noise(60) + w + noise(60)), 1, 1) for d, w in docs], SCHEMA)
    got = {(r.doc_id, r.item_id) for r in leaks(frame, spark.createDataFrame([(k, " ".join(w), "x") for k, w in items], "item_id long, text string, doc_id string")).collect()}
    assert all(d % 100 == k for d, k in got)
    for kind in (100, 200, 300):
        assert len([d for d, _ in got if kind <= d < kind + 100]) >= 38, kind
    assert not [d for d, _ in got if d >= 400]
