"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

A lexicon is learned first: words and word beginnings that labelled toxic
documents hold and others do not, by smoothed log odds. Dense features of a
text are lexicon densities, how near hits stand to second-person words, capitals, punctuation,
and obfuscated spellings (digits and signs for letters, letters set apart) that
resolve to the lexicon. Boosted trees are fitted on them and
an isotonic regression turns their output into a probability. Labelled rows fall into two folds by a hash of
their id: a row the trees learn from is read with a lexicon that the other fold taught, and the
regression sees what trees of the other fold say, so neither is fitted on what it was taught with. Where a
fold lacks labels of one kind, the regression sees the fitted rows themselves.

Labels enter only through the fitted model; the sample is bounded by
``max_train`` rows, chosen by a hash of the id. Every whole text is scored.

Defined results: a null text counts as empty; repeated labels of a document count as
toxic if any does; without labels of both kinds every score is the share of toxic labels (0 without any);
repeated rows are scored each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import broadcast_if, pin

MAX_TRAIN = 200_000
#: Size of the lexicon; its entries have the greatest evidence.
LEXICON = 4_000
STEMS = (4, 5, 6)
LEAST_DOCS, LEAST_ODDS, STRONG_ODDS = 3, 2.5, 4.0
NEAR = 5
REMEMBERED = 500_000
BROADCAST_ROWS = 1_000_000

WORD = re.compile(r"\w+")
#: Second-person words of the table's languages, and signs that stand for letters.
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos usted ustedes ti tus vosotros os".split())
LEET = str.maketrans("013457@$!|€", "oieastasile")
DISGUISED = re.compile(r"(?<!\S)(?=\S*[^\W\d_])(?=\S*[\d@$!|€*])[\w@$!|€*]{3,40}")
APART = re.compile(r"(?<!\w)(?:[^\W\d_][ .\-_*]){3,20}[^\W\d_](?!\w)")
NOT_LETTERS = bytes(b for b in range(256) if not chr(b).isalpha() or b > 127)
FEATURES = ("words", "hits", "density", "strong", "strong_density", "mass", "top", "near_second", "second", "capitals", "shouted", "bangs", "punctuation", "disguised", "disguised_hits")


def terms(word: str) -> list[str]:
    """A word and its beginnings, as the lexicon names them."""
    return [word, *(f"{word[:k]}*" for k in STEMS if len(word) > k)]


class Lexicon(dict):
    """Word to its greatest log odds, found once and then kept."""

    def __init__(self, odds: dict[str, float]) -> None:
        super().__init__()
        self.odds = odds

    def __missing__(self, word: str) -> float:
        if len(self) > REMEMBERED:
            self.clear()
        found = self[word] = max(self.odds.get(t, 0.0) for t in terms(word))
        return found


def features(text: str, lexicon: Lexicon) -> list[float]:
    words = WORD.findall(text.lower())
    n = max(1, len(words))
    odds = list(map(lexicon.__getitem__, words))
    hits = [i for i, x in enumerate(odds) if x]
    strong = sum(1 for i in hits if odds[i] >= STRONG_ODDS)
    second = [i for i, w in enumerate(words) if w in SECOND]
    at = np.array(second)
    near = sum(1 for i in hits if second and (k := int(np.searchsorted(at, i - NEAR))) < len(second) and second[k] <= i + NEAR)
    letters = sum(map(str.isalpha, text)) if not text.isascii() else len(text.encode().translate(None, NOT_LETTERS))
    capitals = len(re.findall(r"[A-ZÀ-ÖØ-Þ]", text))
    shouted = len(re.findall(r"\b[A-ZÀ-ÖØ-Þ]{3,}\b", text))
    bangs, marks = text.count("!") + text.count("?"), len(re.findall(r"[^\w\s]", text))
    disguised = disguised_hits = 0
    for found in DISGUISED.findall(text):
        plain = re.sub(r"[*_]", "", found.lower().translate(LEET))
        raw = found.lower().strip("!*_")
        if plain != raw and plain.isalpha():
            disguised += 1
            disguised_hits += lexicon[plain] >= STRONG_ODDS and not any(lexicon[w] >= STRONG_ODDS for w in WORD.findall(raw))
    for found in APART.findall(text):
        disguised += 1
        disguised_hits += lexicon[re.sub(r"[ .\-_*]", "", found).lower()] >= STRONG_ODDS
    size = max(1, len(text))
    return [
        float(np.log1p(len(words))), float(np.log1p(len(hits))), len(hits) / n, float(np.log1p(strong)), strong / n, sum(odds) / n, max(odds, default=0.0), near / max(1, len(hits)), len(second) / n,
        capitals / max(1, letters), shouted / n, bangs / size, marks / size, disguised / n, float(disguised_hits),
    ]


def learn_lexicons(train: DataFrame, size: int) -> list[dict[str, float]]:
    """Terms of ``train(text, toxic, fold)`` by how far they favour toxic documents; at most ``size``.

    The first lexicon is learned from all rows, the others each from the rows of the fold that isn't
    theirs: fold 0 is read with the second, which fold 1 taught, and fold 1 with the third.
    """
    names = [f"{kind}{fold}" for fold in (0, 1) for kind in "ba"]
    counted = [F.count_if((F.col("toxic") == t) & (F.col("fold") == k)).alias(f"{'ba'[t]}{k}") for k in (0, 1) for t in (0, 1)]
    totals = train.agg(*counted).first()

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list[int]] = {}
            for text, toxic, fold in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                for t in {t for w in set(WORD.findall(text.lower())) for t in terms(w)}:
                    found.setdefault(t, [0, 0, 0, 0])[2 * fold + toxic] += 1
            counts = np.array(list(found.values()), np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *(pa.array(counts[:, k]) for k in range(4))], ["term", *names])

    counts = pin(train.select("text", "toxic", "fold").mapInArrow(held, ", ".join(["term string", *(f"{n} long" for n in names)])).groupBy("term").agg(*(F.sum(n).alias(n) for n in names)).where(F.col("a0") + F.col("a1") >= LEAST_DOCS))
    made = []
    for folds in ((0, 1), (1,), (0,)):
        a, b = (sum((F.col(f"{kind}{k}") for k in folds), F.lit(0)) for kind in "ab")
        p, n = (sum(totals[f"{kind}{k}"] for k in folds) for kind in "ab")
        odds = F.log((a + 0.5) / (p + 1.0)) - F.log((b + 0.5) / (n + 1.0))
        told = counts.where(a >= LEAST_DOCS).select("term", odds.alias("odds"), (odds * F.sqrt(a)).alias("evidence")).where(F.col("odds") >= LEAST_ODDS)
        made.append({r.term: r.odds for r in told.orderBy(F.desc("evidence"), "term").limit(size).collect()})
    return made


def with_features(docs: DataFrame, lexicons: list[dict[str, float]], keep: str) -> DataFrame:
    """``docs`` (the columns of the schema ``keep``, then which lexicon reads the text, and the text) with ``f``."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicons)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers = [Lexicon(x) for x in shared.value]
        for batch in batches:
            texts, by = batch.column("text").to_pylist(), batch.column("by").to_pylist()
            rows = pa.array([features(t or "", readers[k]) for t, k in zip(texts, by, strict=True)], pa.list_(pa.float64()))
            rest = [c for c, name in zip(batch.columns, batch.schema.names, strict=True) if name not in ("by", "text")]
            yield pa.RecordBatch.from_arrays([*rest, rows], [*(x for x in batch.schema.names if x not in ("by", "text")), "f"])

    return docs.mapInArrow(run, f"{keep}, f array<double>")


def toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.3, max_train: int = MAX_TRAIN, lexicon_size: int = LEXICON) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, held_out, score, predicted)``; rows with ``held_out`` (of doc_id) teach nothing."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out)
    known = pin(known)
    rows = known.count()
    chosen = known if rows <= max_train else pin(known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < max_train / rows * 1_000_000))
    train = docs.join(broadcast_if(chosen, BROADCAST_ROWS), "doc_id")
    kinds = {r.toxic: r["count"] for r in train.groupBy("toxic").count().collect()}
    out = [F.col("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out")]
    if len(kinds) < 2:
        share = F.lit(float(kinds.get(1, 0) > 0))
        return docs.select(*out, share.alias("score"), (share >= threshold).cast("int").alias("predicted"))
    train = train.select("doc_id", "toxic", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(2)).cast("int").alias("fold"), "text")
    lexicons = learn_lexicons(train, lexicon_size)
    read = train.select("doc_id", "toxic", "fold", (F.col("fold") + 1).alias("by"), "text")
    fit = pin(with_features(read, lexicons, "doc_id long, toxic int, fold int").select(F.col("toxic").cast("double").alias("label"), "fold", array_to_vector("f").alias("features")))
    grow = lambda rows: GBTClassifier(maxIter=15, maxDepth=3, stepSize=0.3, seed=1).fit(rows.coalesce(8))
    margin = vector_to_array("probability")[1]
    folds = {r.fold for r in fit.groupBy("fold").agg(F.count_distinct("label").alias("n")).where("n = 2").collect()}
    if folds == {0, 1}:  # calibrated on what trees of the other fold say
        told = [grow(fit.where(f"fold <> {k}")).transform(fit.where(f"fold = {k}")).select("label", margin.alias("margin")) for k in (0, 1)]
        told = told[0].unionByName(told[1])
    trees = grow(fit)
    if folds != {0, 1}:
        told = trees.transform(fit).select("label", margin.alias("margin"))
    steps = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="score").fit(pin(told))
    asked = with_features(docs.select("doc_id", F.lit(0).alias("by"), "text"), lexicons[:1], "doc_id long").select("doc_id", array_to_vector("f").alias("features"))
    scored = steps.transform(trees.transform(asked).select("doc_id", margin.alias("margin")))
    score = F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0))
    return scored.select(*out, score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
