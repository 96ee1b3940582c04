import math
import random
import re

from pyspark.sql import functions as F

from trawl.llm.toxicity import Lexicon, features, learn_lexicons, toxicity


def held():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


SCHEMA = "doc_id long, text string, lang string, score string, f int, toxic int"


def fixture(spark):
    rng = random.Random(1)
    plain = [f"wort{chr(97 + i)}" for i in range(20)]
    rows, labels = [], []
    for d in range(400):
        w = [rng.choice(plain) for _ in range(30)]
        toxic = d % 5 == 0
        if toxic:
            for _ in range(3):
                w[rng.randrange(30)] = rng.choice(["grumble", "grumbling", "snarkface"])
        rows.append((d, " ".join(w), "x", "s", 0, 9))
        labels.append((d, int(toxic)))
    rows += [(1000, None, None, None, 0, 0), (1001, "", None, None, 0, 0), (1002, "you GRUMBLE " * 4000, "", "", 0, 0), (0, rows[0][1], "x", "s", 0, 9)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([*labels, (5, 1), (None, 1), (7, None)], "doc_id long, toxic int")


def test_held_out_accuracy_and_defined_results(spark):
    docs, labels = fixture(spark)
    rows = toxicity(docs, labels, held()).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    apart = [r for r in rows if r.held_out and r.doc_id < 400]
    assert len(apart) > 50 and all(r.predicted == int(r.doc_id % 5 == 0) for r in apart)
    by = {r.doc_id: r for r in rows}
    assert by[1000].predicted == by[1001].predicted == 0 and by[1002].predicted == 1


def test_labels_of_one_kind_and_empty_tables(spark):
    docs, labels = fixture(spark)
    assert {r.score for r in toxicity(docs, labels.where("toxic = 0"), held()).collect()} == {0.0}
    assert {r.score for r in toxicity(docs, labels.limit(0), held()).collect()} == {0.0}
    assert toxicity(docs.limit(0), labels, held()).collect() == []


def test_obfuscated_words_resolve():
    lexicon = Lexicon({"idiot": 7.0})
    assert features("what an 1d10t", lexicon)[-1] == 1 == features("an i.d.i.o.t here", lexicon)[-1]
    assert features("an id10m here a b", lexicon)[-1] == 0
    assert features("you idiot", lexicon)[7] == 1 and features("you " + "x " * 9 + "idiot", lexicon)[7] == 0


def test_lexicons_equal_plain_counts(spark):
    """Terms, odds and folds, counted document by document."""
    rng = random.Random(2)
    vocabulary = [a + b + c for a in "abc" for b in "xyz" for c in ("lo", "mire", "nunde")]
    rows = []
    for _ in range(300):
        toxic, words = rng.random() < 0.4, rng.choices(vocabulary, k=6)
        rows.append((" ".join([*words, *(rng.choices(["giftig", "giftiger", "übel"], k=2) if toxic and rng.random() < 0.8 else [])]), int(toxic), rng.randrange(2)))
    got = learn_lexicons(spark.createDataFrame(rows, "text string, toxic int, fold int"), 5)
    for lexicon, folds in zip(got, ((0, 1), (1,), (0,)), strict=True):
        counts = {}
        for text, toxic, fold in rows:
            for t in {x for w in text.split() for x in (w, *(f"{w[:k]}*" for k in (4, 5, 6) if len(w) > k))} if fold in folds else ():
                counts.setdefault(t, [0, 0])[toxic] += 1
        all_of = [sum(t == k and f in folds for _, t, f in rows) for k in (0, 1)]
        odds = {t: math.log((a + 0.5) / (all_of[1] + 1)) - math.log((b + 0.5) / (all_of[0] + 1)) for t, (b, a) in counts.items() if a >= 3}
        kept = sorted((t for t, x in odds.items() if x >= 2.5), key=lambda t: (-odds[t] * math.sqrt(counts[t][1]), t))[:5]
        assert lexicon.keys() == set(kept) and all(math.isclose(lexicon[t], odds[t], rel_tol=1e-9) for t in kept)


def test_features_equal_plain_counts():
    lexicon = {"giftig": 5.0, "gift*": 3.0, "mies": 4.5}
    odds = lambda w: max([lexicon.get(w, 0.0), *(lexicon.get(f"{w[:k]}*", 0.0) for k in (4, 5, 6) if len(w) > k)])
    for text in ("", "Du bist GIFTIG!!", "giftzwerg und mies, sagt man dir? NEIN", "eins zwei drei vier fünf sechs sieben giftig acht neun zehn elf zwölf du", "g1ftig m1es m-i-e-s wort", "ÄÖÜ ß é 123"):
        words = re.findall(r"\w+", text.lower())
        hits = [i for i, w in enumerate(words) if odds(w)]
        near = sum(any(words[j] in ("du", "dir") for j in range(max(0, i - 5), min(len(words), i + 6))) for i in hits)
        n, strong, second = max(1, len(words)), sum(odds(words[i]) >= 4 for i in hits), sum(w in ("du", "dir") for w in words)
        capitals, letters = sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜ" for c in text), sum(c.isalpha() for c in text)
        shouted = len([w for w in re.findall(r"\w+", text) if len(w) >= 3 and all(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜ" for c in w)])
        marks = sum(not c.isspace() and not c.isalnum() and c != "_" for c in text)
        want = [math.log1p(len(words)), math.log1p(len(hits)), len(hits) / n, math.log1p(strong), strong / n, sum(map(odds, words)) / n, max(map(odds, words), default=0.0), near / max(1, len(hits)), second / n, capitals / max(1, letters), shouted / n, sum(c in "!?" for c in text) / max(1, len(text)), marks / max(1, len(text))]
        got = features(text, Lexicon(lexicon))
        assert all(math.isclose(a, b, abs_tol=1e-12) for a, b in zip(got, want, strict=False)), text
    disguised = features("g1ftig m1es m-i-e-s wort", Lexicon(lexicon))
    assert (disguised[13], disguised[14]) == (3 / len(re.findall(r"\w+", "g1ftig m1es m-i-e-s wort")), 3.0)


def test_scores_rise_with_the_trees(spark):
    """The calibration is isotonic: scores keep the order of what the trees say, held-out rows included, and null ids pass."""
    docs, labels = fixture(spark)[:2]
    more = docs.unionByName(docs.limit(3).withColumn("doc_id", F.lit(None).cast("long")))
    rows = toxicity(more, labels, held()).collect()
    assert sum(r.doc_id is None for r in rows) == 3 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    by_text = {r.doc_id: r.text for r in docs.collect()}
    scores = {}
    for r in rows:
        if r.doc_id is not None:
            scores.setdefault(by_text[r.doc_id], set()).add(r.score)
    assert all(len(s) == 1 for s in scores.values()) and len({s for x in scores.values() for s in x}) > 1
