"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages and searched in blocks of at most ``BLOCK`` passages, each block
against all documents. A block's words are its term space (words outside it can't add to a match), at most
``BLOCK * PASSAGE`` of them whatever the corpus holds; everything that tasks are sent is bounded by that.

One pass over the texts keeps where each document holds words of the space; all else works on these hits.
Words are weighted by inverse document frequency over the whole corpus. A distributed randomised SVD gives the
latent space: tasks multiply their windows' TF-IDF rows A with a random test matrix (A^T A Omega), the sums
are orthonormalised together with the passages (scaled to one length), and the least rank is kept that leaves every passage
``ENERGY`` of its squared weight. Windows of every document are projected; a window is a candidate for a
passage if its latent vector, in the passage's direction, covers enough of the passage's. A word counts once
in a step. Candidates are checked on the words: longest common subsequence, of the whole passage or of its halves or thirds
wherever each stands, and for looser matches
(paraphrases) also that the passage's closing words, where an item's answer stands, are there. An item of fewer
than ``LEAST_WORDS`` words is a match where all its words stand side by side.

Defined results: null or empty texts and items without words match nothing; a passage of nothing but words that
over a third of all documents hold has to be there nearly verbatim; rows with a null id are searched as
all others and keep the null; repeated rows give a row each; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import broadcast_if, pin

WORD = re.compile(r"\w+")
STEP = 32  # a window is two steps of words
PASSAGE = 48
LEAST_WORDS = 8
TOPICS = 32
BLOCK = 512
LEAST_IDF = 1.0
#: Weight of words under that bound: they count, but can't make a candidate alone where a passage has others.
FREQUENT = 0.05
ENERGY = 0.5
COVER = 0.35
VERBATIM, PARAPHRASE, ANSWER = 0.8, 0.55, 0.6
ANSWER_WORDS = 8
SEED = 6
STEPS_AT_ONCE = 512
#: Hashes of contaminated texts (16 bytes each) that may be broadcast.
BROADCAST_ROWS = 1_000_000
LEAKS = "doc_id long, item_id long, cosine double, overlap double, answer double, h1 long, h2 long"

Item = tuple[int | None, list[str]]


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def passages_of(words: list[str]) -> list[list[str]]:
    """An item's words cut evenly into passages of at most ``PASSAGE``; a short item is one."""
    n = -(-len(words) // PASSAGE)
    return [words[k * len(words) // n : (k + 1) * len(words) // n] for k in range(n)]


def blocks_of(benchmark: DataFrame, block: int) -> Iterator[list[Item]]:
    """``(item_id, passage)`` of all items in blocks; one block is held at a time."""
    held: list[Item] = []
    for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        for p in passages_of(words_of(r.text)):
            held.append((r.item_id, p))
            if len(held) == block:
                yield held
                held = []
    if held:
        yield held


def common(a: list, b: list) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    at: dict = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for w in b:
        hit = row & at.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def verdict(passage: list, region: list) -> tuple[float, float]:
    """Shares of the passage and of its closing words that the region holds in order; halves or thirds of it may have changed places."""
    n, close, held = len(passage), passage[-ANSWER_WORDS:], set(region)
    present = sum(w in held for w in passage)  # no order holds more
    if present < PARAPHRASE * n:
        return 0.0, 0.0
    whole, answer = common(passage, region) / n, common(close, region) / len(close)
    if whole < VERBATIM <= present / n:
        for parts in (2, 3):
            cuts = [n * k // parts for k in range(parts + 1)]
            if n // parts >= LEAST_WORDS:
                moved = sum(common(passage[i:j], region) for i, j in zip(cuts, cuts[1:], strict=False)) / n
                whole = max(whole, moved) if moved >= VERBATIM else whole
    return whole, answer


def is_leak(whole: float, answer: float) -> bool:
    return whole >= VERBATIM or whole >= PARAPHRASE and answer >= ANSWER


def hits_of(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """``(doc_id, h1, h2, n_words, at, term)``: two hashes of each text, and where it holds words of the space, as packed int32."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            lengths, ats, terms = [], [], []
            for text in batch.column(3):
                w = words_of(text.as_py())
                term = np.fromiter(map(known.get, w, [-1] * len(w)), np.int32, len(w))
                at = np.flatnonzero(term >= 0).astype(np.int32)
                lengths.append(len(w))
                ats.append(at.tobytes())
                terms.append(term[at].tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(lengths, pa.int32()), pa.array(ats, pa.binary()), pa.array(terms, pa.binary())], ["doc_id", "h1", "h2", "n_words", "at", "term"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), *text_hashes(), text).mapInArrow(run, "doc_id long, h1 long, h2 long, n_words int, at binary, term binary")


def text_hashes() -> list:
    text = F.col("text").cast("string")
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All integers of a binary column, and where each row's begin and end."""
    edges = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    raw = memoryview(column.buffers()[2] or b"")[edges[0] : edges[-1]]
    return np.frombuffer(raw, np.int32), (edges - edges[0]) // 4


def document_counts(hits: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """In how many documents each term is, and how many documents there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size + 1, np.int64)
        for batch in batches:
            term, edges = packed(batch.column(0))
            once = np.unique(np.repeat(np.arange(len(edges) - 1), np.diff(edges)) * size + term)
            held[:size] += np.bincount(once % size, minlength=size)
            held[size] += batch.num_rows
        seen = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(held[seen])], ["term", "n"])

    counts = np.zeros(size + 1, np.int64)
    for r in hits.select("term").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row for each word of the block
        counts[r.term] = r.n
    return counts[:size], int(counts[size])


class Windows:
    """The hits of a batch of documents, dealt to steps; two neighbouring steps of a document are a window."""

    def __init__(self, lengths: np.ndarray, at: pa.Array, term: pa.Array, weight: np.ndarray) -> None:
        self.at, self.edges = packed(at)
        self.term = packed(term)[0]
        self.first = np.concatenate([[0], np.cumsum(lengths // STEP + 2)])
        step = np.repeat(self.first[:-1], np.diff(self.edges)) + self.at // STEP
        self.step, self.word = np.divmod(np.unique(step * weight.size + self.term), weight.size)  # each word once a step
        self.begin = np.searchsorted(self.step, np.arange(self.first[-1] + 1))
        self.weight = weight

    def energy(self) -> np.ndarray:
        """Of each window; not less than the weight of its different words."""
        e = np.bincount(self.step, self.weight[self.word] ** 2, self.first[-1])
        return e[:-1] + e[1:]

    def project(self, weighted: np.ndarray, first: int, last: int) -> np.ndarray:
        """Sums of the steps' rows of ``weighted`` (a basis times the words' weights)."""
        sums = np.zeros((last - first, weighted.shape[1]), np.float32)
        cut = self.begin[first : last + 1]
        held = np.flatnonzero(np.diff(cut))
        if held.size:
            sums[held] = np.add.reduceat(weighted[self.word[cut[0] : cut[-1]]], cut[held] - cut[0], axis=0)
        return sums


def corpus_sketch(hits: DataFrame, weight: np.ndarray, topics: int) -> np.ndarray:
    """``A^T A Omega`` over all steps A of the corpus, for a fixed random Omega."""
    size = weight.size
    names = [f"g{i}" for i in range(topics)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        omega = (np.random.default_rng(SEED).normal(size=(size, topics)) * weight[:, None]).astype(np.float32)
        held = np.zeros((size, topics))
        for batch in batches:
            w = Windows(batch.column(0).to_numpy(), batch.column(1), batch.column(2), weight)
            for at in range(0, w.first[-1], STEPS_AT_ONCE):
                end = min(at + STEPS_AT_ONCE, w.first[-1])
                z, hit = w.project(omega, at, end), slice(w.begin[at], w.begin[end])
                spread = z[w.step[hit] - at] * weight[w.word[hit], None]
                for k in range(topics):
                    held[:, k] += np.bincount(w.word[hit], spread[:, k], size)
        seen = np.flatnonzero(held.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(seen), *(pa.array(held[seen, i]) for i in range(topics))], ["term", *names])

    schema = ", ".join(["term long", *(f"{n} double" for n in names)])
    summed = hits.select("n_words", "at", "term").mapInArrow(run, schema).groupBy("term").agg(*(F.sum(n).alias(n) for n in names)).toPandas()  # a row for each word of the block
    sketch = np.zeros((size, topics))
    sketch[summed["term"].to_numpy(dtype=np.int64)] = summed[names].to_numpy()
    return sketch


def latent_space(passages: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """Orthonormal columns in falling singular values, the fewest that leave every passage ``ENERGY`` of its squared weight."""
    scaled = sketch / max(1e-12, np.linalg.norm(sketch, axis=0).max())
    q, r = np.linalg.qr(np.concatenate([passages.T, scaled], axis=1))
    basis = (q @ np.linalg.svd(r, full_matrices=False)[0]).astype(np.float32)
    kept = np.cumsum((passages @ basis) ** 2, axis=1) / np.maximum(1e-12, (passages**2).sum(axis=1, keepdims=True))
    rank = 1 + int(np.argmax(np.append(kept.min(axis=0) >= ENERGY, True)))
    return basis[:, :rank]


def block_leaks(docs: DataFrame, block: list[Item], topics: int) -> DataFrame:
    """The documents that hold an item of the block, as ``LEAKS``."""
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, p in block for w in p}))}
    hits = pin(hits_of(docs, vocabulary))
    counts, n = document_counts(hits, len(vocabulary))
    idf = np.log((n + 1) / np.maximum(1, counts))
    weight = np.where(idf < LEAST_IDF, FREQUENT, idf).astype(np.float32)
    coded = [(item, [vocabulary[w] for w in p]) for item, p in block]
    short = [(item, p, int(np.argmin(counts[p]))) for item, p in coded if len(p) < LEAST_WORDS]
    long = [(item, p) for item, p in coded if len(p) >= LEAST_WORDS]
    rows = np.zeros((len(long), len(vocabulary)), np.float32)
    for i, (_, p) in enumerate(long):
        rows[i, p] = weight[p]
    energy = (rows**2).sum(axis=1)
    basis = latent_space(rows / np.sqrt(energy)[:, None], corpus_sketch(hits, weight, topics)) if long else np.zeros((len(vocabulary), 0), np.float32)
    latent = rows @ basis
    length = np.linalg.norm(latent, axis=1)
    least = COVER * float(energy.min(initial=np.inf))
    shared = docs.sparkSession.sparkContext.broadcast((weight, basis * weight[:, None], latent / np.maximum(1e-9, length)[:, None], length, long, short, [bool((idf[p] < LEAST_IDF).all()) for _, p in long]))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, weighted, unit, length, long, short, frequent = shared.value
        for batch in batches:
            w = Windows(batch.column("n_words").to_numpy(), batch.column("at"), batch.column("term"), weight)
            best: dict[tuple[int, int | None], tuple[float, float, float]] = {}

            def tell(doc: int, item: int | None, found: tuple[float, float, float]) -> None:
                best[doc, item] = max(best.get((doc, item), (0.0, 0.0, 0.0)), found)  # noqa: B023

            for item, p, anchor in short:
                spot = np.flatnonzero(w.term == p[anchor]) - anchor
                spot = spot[(spot >= 0) & (spot + len(p) <= w.term.size)]
                for j, t in enumerate(p):
                    spot = spot[(w.term[spot + j] == t) & (w.at[spot + j] == w.at[spot] + j)]
                doc = np.searchsorted(w.edges, spot, "right") - 1
                for d in np.unique(doc[spot + len(p) <= w.edges[doc + 1]]).tolist():
                    tell(d, item, (1.0, 1.0, 1.0))
            if not long:
                yield answer(batch, best)
                continue
            energy = w.energy()
            for at in range(0, energy.size, STEPS_AT_ONCE):
                end = min(at + STEPS_AT_ONCE, energy.size)
                some = at + np.flatnonzero(energy[at:end] >= least)  # others can't cover a passage's weight
                steps = w.project(weighted, at, end + 1)
                z = steps[some - at] + steps[some - at + 1]
                dots = z @ unit.T
                x, y = np.nonzero(dots >= COVER * length)
                cosine = dots[x, y] / np.maximum(1e-9, np.linalg.norm(z[x], axis=1))
                docs = np.searchsorted(w.first, some[x], "right") - 1
                begin = (some[x] - w.first[docs]) * STEP
                for d, k, c, b in zip(docs.tolist(), y.tolist(), cosine.tolist(), begin.tolist(), strict=True):
                    item, p = long[k]
                    held = slice(w.edges[d], w.edges[d + 1])
                    where = w.at[held]
                    a, z_ = np.searchsorted(where, (b - PASSAGE, b + 2 * STEP + PASSAGE))
                    region = w.term[held][a:z_].tolist()
                    if frequent[k]:  # such words are in order in any long text, so only stretches of the passage's length count
                        place = where[a:z_].tolist()
                        stretches = [[t for t, q in zip(region[i:], place[i:], strict=True) if q < place[i] + len(p)] for i in range(len(region))]
                        whole, close = max((verdict(p, s) for s in stretches), default=(0.0, 0.0))
                        leak = whole >= VERBATIM
                    else:
                        whole, close = verdict(p, region)
                        leak = is_leak(whole, close)
                    if leak:
                        tell(d, item, (whole, close, c))
            yield answer(batch, best)

    return hits.mapInArrow(look, LEAKS)


def answer(batch: pa.RecordBatch, best: dict[tuple[int, int | None], tuple[float, float, float]]) -> pa.RecordBatch:
    """The rows of ``LEAKS`` for what was found in a batch."""
    of = pa.array([d for d, _ in best], pa.int64())
    doc, h1, h2 = (batch.column(c).take(of) for c in ("doc_id", "h1", "h2"))
    values = [pa.array([v[k] for v in best.values()], pa.float64()) for k in (2, 0, 1)]
    return pa.RecordBatch.from_arrays([doc, pa.array([i for _, i in best], pa.int64()), *values, h1, h2], ["doc_id", "item_id", "cosine", "overlap", "answer", "h1", "h2"])


def all_leaks(docs: DataFrame, benchmark: DataFrame, block: int, topics: int) -> DataFrame:
    """``LEAKS`` with the ``block`` that found each."""
    found = docs.sparkSession.createDataFrame([], f"{LEAKS}, block int")
    for k, some in enumerate(blocks_of(benchmark, block)):
        found = found.unionByName(pin(block_leaks(docs, some, topics)).withColumn("block", F.lit(k)))
    return found


def leaks(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK, topics: int = TOPICS) -> DataFrame:
    """``(doc_id, item_id, cosine, overlap, answer)`` for each document that holds a benchmark item.

    An item whose passages lie in several blocks is found by some of them; its best find holds. A block
    tells of each repeated row, so the rows of one find are as many as one block has of it.
    """
    row = ["doc_id", "h1", "h2", "item_id"]
    each = all_leaks(docs, benchmark, block, topics).groupBy(*row, "block").agg(F.count("*").alias("n"), F.max(F.struct("overlap", "answer", "cosine")).alias("best"))
    once = each.groupBy(*row).agg(F.max("n").alias("n"), F.max("best").alias("best"))
    return once.select("doc_id", "item_id", "best.cosine", "best.overlap", "best.answer", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("nth")).drop("nth")


def clean(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK, topics: int = TOPICS) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; texts are told apart by two hashes, so ids may be null."""
    found = pin(all_leaks(docs, benchmark, block, topics).select("h1", "h2").distinct())
    h1, h2 = text_hashes()
    marked = docs.select("*", h1.alias("_bd_h1"), h2.alias("_bd_h2"))
    gone = broadcast_if(found, BROADCAST_ROWS)
    return marked.join(gone, (F.col("_bd_h1") == F.col("h1")) & (F.col("_bd_h2") == F.col("h2")), "left_anti").select(*docs.columns)
