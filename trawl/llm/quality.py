"""Quality by perplexity under an interpolated modified Kneser-Ney model of word trigrams.

The model is trained on trusted text: documents labelled of good quality. It holds
every word n-gram up to three words of that text, so it grows with the input; below single words
stands a model of characters (32 symbols, four-grams, a table of 4 MB) that spells words never seen. An n-gram is a 48-bit hash.

In its back-off form a log probability is a sum: what the spelling gives, plus weights of the word,
of the last two and three words, and of the one and two words before. All but the weights of single words belong to
the shard of the trigram's middle word: trusted and asked trigrams are packed by it, meet there, and the
weights are added up, so that a document's perplexity follows from its sums. Of trusted trigrams the distinct ones are
kept; asked texts meet them in ``PASSES`` passes, whose shuffle files go one after another. Shards tell each other only how many
n-grams have which count and how many left neighbours a word has. A hot middle word is spread over all shards by the word
before it; its pairs are then counted in common. No task holds more than one shard of the model.

A document is rejected if its perplexity exceeds the cut of its language and length (by powers of
two): a quantile of trusted documents that the model was not trained on, a ``HELD`` th of all.
With fewer than ``LEAST`` of these the cut is that of the language if it has ``LEAST_OWN``; only then that of the length in all languages, or of all.

Defined results: a null or empty text has no perplexity and is kept; without any trusted
document all are kept; a null language is a language of its own; repeated labels count once;
repeated rows are scored each; an empty table gives an empty result; columns named
like the results are replaced.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import broadcast_if, new_folder, pin, remove_folder, shuffles_removed, stored

BITS, ORDER = 5, 4
SYMBOLS = 1 << BITS
DIGIT, SPACE, LINE, MARK, SIGN, OTHER = range(26, 32)
TRUSTED_QUANTILE = 0.99
HELD = 4
LEAST, LEAST_OWN = 100, 20
#: Words; a sign and a letter of a script without spaces stand alone.
WORD = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]|[^\W\u3040-\u30ff\u3400-\u9fff]+|[^\w\s]")
NONE, BEGIN, END = range(3)
#: Trusted text that one task weighs at once; shards grow in number with the text.
SHARD_BYTES = 4 << 20
LEAST_SHARDS = 16
#: Words packed at once, and distinct words that the search for frequent ones remembers.
WORDS_AT_ONCE = 1 << 20
CHARS_AT_ONCE = 1 << 20
SPELT_AT_ONCE = 1 << 15
WORDS_HELD = 1 << 18
#: Passes over the asked texts, each with a share of them.
PASSES = 4
#: Ids of trusted documents, or documents' perplexities, that may be broadcast.
BROADCAST_ROWS = 4_000_000
BROADCAST_LANGS = 100_000


def symbol(code: int) -> int:
    char = chr(code)
    base = unicodedata.normalize("NFD", char)[0].lower()
    if "a" <= base <= "z":
        return ord(base) - ord("a")
    kind = unicodedata.category(char)
    if char in "\n\r":
        return LINE
    if kind[0] == "Z" or char in "\t\x0b\x0c":
        return SPACE
    if kind == "Nd":
        return DIGIT
    if char in ".,;:?!'\"()-¡¿«»’“”":
        return MARK
    return OTHER if kind[0] in "LM" else SIGN


ALPHABET = np.array([symbol(c) if not 0xD800 <= c < 0xE000 else OTHER for c in range(1 << 16)], np.uint8)


def grams(text: str) -> np.ndarray:
    """The four-gram at each symbol of the text; line ends stand before the first."""
    s = np.concatenate([np.full(ORDER - 1, LINE, np.uint8), ALPHABET[np.frombuffer(text.encode("utf-16-le"), np.uint16)]]).astype(np.int64)
    n = s.size - ORDER + 1
    return sum(s[k : k + n] << BITS * (ORDER - 1 - k) for k in range(ORDER))


def rates_of(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """What the modified Kneser-Ney estimate takes off counts of 1, 2, and 3 or more, from how many n-grams have counts 1 to 4."""
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    rates = [k - (k + 1) * y * b / a if a and b else k * 0.5 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return [min(max(r, 0.1), k - 0.05) for k, r in enumerate(rates, 1)]


def taken_off(rates: list[float]) -> Column:
    """What ``rates`` take off each count ``n``."""
    return F.when(F.col("n") == 1, rates[0]).when(F.col("n") == 2, rates[1]).otherwise(rates[2])


def discounts(counts: DataFrame) -> Column:
    return taken_off(rates_of(*counts.agg(*(F.count_if(F.col("n") == k) for k in range(1, 5))).first()))


def discounted(counts: DataFrame, order: int, lower: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """One order of the model from ``counts(gram, n)``.

    Gives ``(gram, p)`` for the observed grams and ``(context, back)``, the
    weight left to the lower order, whose ``(gram, p)`` are in ``lower``.
    """
    off = discounts(counts)
    context = F.shiftright("gram", BITS)
    contexts = counts.groupBy(context.alias("context")).agg(F.sum("n").alias("total"), F.sum(off).alias("taken")).withColumn("back", F.col("taken") / F.col("total"))
    known = counts.withColumn("context", context).join(contexts, "context")
    direct = (F.col("n") - off) / F.col("total")
    if lower is None:
        return known.select("gram", (direct + F.col("back") / SYMBOLS).alias("p")), contexts.select("context", "back")
    suffix = F.col("gram").bitwiseAND((1 << BITS * (order - 1)) - 1)
    joined = known.withColumn("suffix", suffix).join(lower.select(F.col("gram").alias("suffix"), F.col("p").alias("low")), "suffix")
    return joined.select("gram", (direct + F.col("back") * F.col("low")).alias("p")), contexts.select("context", "back")


def train(trusted: DataFrame) -> np.ndarray:
    """Log probabilities of all 32^4 four-grams from ``trusted(text)``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(SYMBOLS**ORDER, np.int64)
        for batch in batches:
            for text in batch.column(0):
                g = grams(text.as_py())
                np.add.at(held, g, 1)
        seen = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(held[seen])], ["gram", "n"])

    counts = [pin(trusted.select("text").where("text <> ''").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")))]
    for order in range(ORDER, 1, -1):  # below the top a gram counts its distinct left neighbours
        counts.append(pin(counts[-1].groupBy(F.col("gram").bitwiseAND((1 << BITS * (order - 1)) - 1).alias("gram")).agg(F.count("*").alias("n"))))
    dense, lower = np.full(1, 1 / SYMBOLS), None
    for order, held in enumerate(reversed(counts), 1):
        observed, contexts = discounted(held, order, lower)
        lower = pin(observed)
        back = np.ones(SYMBOLS ** (order - 1))
        weights, known = contexts.toPandas(), lower.toPandas()  # 32^3 and 32^4 rows at most
        back[weights["context"].to_numpy()] = weights["back"]
        dense = np.repeat(back, SYMBOLS) * (np.tile(dense, SYMBOLS) if order > 1 else dense)
        dense[known["gram"].to_numpy()] = known["p"]
    return np.log(dense).astype(np.float32)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """48-bit hashes of pairs of hashes."""
    x = (a * np.uint64(0x9E3779B97F4A7C15) ^ b) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ x >> np.uint64(32)) * np.uint64(0xFF51AFD7ED558CCD) >> np.uint64(16)


def squeeze(values: np.ndarray) -> bytes:
    """``values`` compressed, equal bytes of all values side by side."""
    planes = values.view(np.uint8).reshape(values.size, values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def expand(data: bytes, kind: type) -> np.ndarray:
    raw, width = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8), np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, raw.size // width).T).view(kind).ravel()


def found(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Values of the ``asked`` among sorted ``keys``; 0 where there is none."""
    if not keys.size:
        return np.zeros(asked.size)
    at = np.minimum(np.searchsorted(keys, asked), keys.size - 1)
    return np.where(keys[at] == asked, values[at], 0.0)


def merged(key: np.ndarray, n: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, the sums of their counts, and the columns of one row of each."""
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    at = np.flatnonzero(np.concatenate([np.ones(min(key.size, 1), bool), ordered[1:] != ordered[:-1]]))
    return ordered[at], np.add.reduceat(n[order], at) if at.size else n, *(c[order[at]] for c in columns)


def spellings(words: list[str], logs: np.ndarray) -> np.ndarray:
    """Log probabilities of the words by their characters and the space after each, each as a text of its own."""
    made = [np.zeros(0)]
    for at in range(0, len(words), SPELT_AT_ONCE):
        lines = "\n" * (ORDER - 1)
        codes = np.frombuffer("".join(f"{lines}{w} " for w in words[at : at + SPELT_AT_ONCE]).encode("utf-16-le"), np.uint16)
        s = ALPHABET[codes].astype(np.int32)
        n = s.size - ORDER + 1
        each = logs[sum(s[k : k + n] << BITS * (ORDER - 1 - k) for k in range(ORDER))].astype(np.float64)
        ends = np.flatnonzero(codes == ord(" "))  # no word holds a space
        starts = np.append(0, ends[:-1] + 1)
        bounds = np.stack([starts, ends - ORDER + 2], axis=1).ravel()  # from a word's first symbol to its space, and the lines before the next
        made.append(np.add.reduceat(each, bounds[:-1])[::2])
    return np.concatenate(made)


@cache
def kinds() -> np.ndarray:
    """What each code point is to ``WORD``: 0 white space, 1 part of a word, 2 a word of its own."""
    codes = np.arange(0x110000, dtype="<u4")
    codes[0xD800:0xE000] = ord(" ")
    every, made = codes.tobytes().decode("utf-32-le"), np.full(codes.size, 2, np.uint8)
    for kind, pattern in ((0, r"\s+"), (1, r"[^\W\u3040-\u30ff\u3400-\u9fff]+")):
        for m in re.finditer(pattern, every):
            made[slice(*m.span())] = kind
    return made


def cut(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """48-bit hashes, starts and ends of the words that ``WORD`` finds in the text."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kind = kinds()[codes]
    goes_on = (kind[1:] == 1) & (kind[:-1] == 1)
    inside = kind > 0
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~goes_on
    end[:-1] &= ~goes_on
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    size = ends - starts
    if not size.size:
        return np.zeros(0, np.uint64), starts, ends
    first = np.cumsum(size) - size
    powers = np.cumprod(np.full(size.max(), 0xD1342543DE82EF95, np.uint64))
    each = codes[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    each ^= each >> np.uint64(29)
    each *= powers[np.arange(each.size) - np.repeat(first, size)]
    return mix(np.add.reduceat(each, first), size.astype(np.uint64)), starts, ends


class Words:
    """Texts as hashes of words, with the log probabilities by characters of the distinct words."""

    def __init__(self, logs: np.ndarray) -> None:
        self.logs = logs
        self.clear()

    def clear(self) -> None:
        """Nothing, a begin and an end come first; an end is spelt as a line end."""
        self.known, self.spelt = np.array([NONE, BEGIN, END], np.uint64), np.array([0.0, 0.0, self.logs[grams("\n")][0]])

    def read(self, texts: list[str]) -> list[np.ndarray]:
        """The words of each text between two begins and an end."""
        texts = [t.lower() for t in texts]
        text = "\n".join(texts)
        hashes, starts, ends = cut(text)
        word, at = np.unique(hashes, return_index=True)
        new = ~np.isin(word, self.known, assume_unique=True)
        spelt = spellings([text[a:b] for a, b in zip(starts[at[new]].tolist(), ends[at[new]].tolist(), strict=True)], self.logs)
        known = np.concatenate([self.known, word[new]])
        order = np.argsort(known)
        self.known = known[order]  # single precision packs well, and every table rounds alike
        self.spelt = np.concatenate([self.spelt, spelt.astype(np.float32)])[order]
        bounds = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
        return [np.concatenate([[BEGIN, BEGIN], own, [END]]).astype(np.uint64) for own in np.split(hashes, bounds[:-1])]


PACKED = "shard int, kind int, words binary, first binary, middle binary, last binary, spelt binary, docs binary, keys binary"
SIDE, TRUSTED, ASKED, LENGTHS = range(4)


def packed_trigrams(keyed: DataFrame, logs: np.ndarray, shards: int, hot: list[int], kind: int) -> DataFrame:
    """``keyed(key, text)`` as packed rows for each shard: word trigrams in document order, and documents' lengths.

    A trigram lies in the shard of its middle word, or if that is ``hot``, in that of its first two words;
    asked trigrams with a hot middle word lie once more, without the first word, in that of the last two. Texts packed at once
    are a chunk, which its asked rows name; their documents are numbered in it, and the row of lengths has the keys.
    """
    shared = keyed.sparkSession.sparkContext.broadcast((logs, np.array(sorted(hot), np.uint64)))
    names = [c.split()[0] for c in PACKED.split(", ")]
    types = [pa.int32()] * 2 + [pa.binary()] * 7

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, spread = shared.value
        words, texts, keys, own_keys, size = Words(table), [], [], set(), 0
        chunks = iter(range(TaskContext.get().partitionId() << 32, 1 << 62))  # the same if a task is run again

        def flush() -> Iterator[pa.RecordBatch]:
            chunk = np.int64(next(chunks)).tobytes()
            hashes, spelt = words.known, words.spelt
            lengths = np.array([t.size - 2 for t in texts])
            place = np.searchsorted(hashes, np.concatenate(texts)).astype(np.uint32)
            doc = np.repeat(np.arange(len(texts), dtype=np.uint32), lengths)
            at = np.arange(doc.size) + 2 * doc
            u, v, w = (place[at + k] for k in range(3))
            if kind == ASKED:
                spelling = np.add.reduceat(spelt[w], np.cumsum(lengths) - lengths)
            home, wide = (hashes % np.uint64(shards)).astype(np.uint32), np.isin(hashes, spread)
            shard = home[v]
            split = wide[v]
            if split.any():
                shard[split] = mix(hashes[u[split]], hashes[v[split]]) % np.uint64(shards)
                if kind == ASKED:
                    pair = (mix(hashes[v[split]], hashes[w[split]]) % np.uint64(shards)).astype(np.uint32)
                    shard, doc = np.concatenate([shard, pair]), np.concatenate([doc, doc[split]])
                    u, v, w = np.concatenate([u, np.zeros(pair.size, np.uint32)]), np.concatenate([v, v[split]]), np.concatenate([w, w[split]])
            order = np.argsort(shard.astype(np.int64) * len(texts) + doc, kind="stable").astype(np.uint32)
            shard, doc = shard[order], doc[order]
            u, v, w = (part[order] for part in (u, v, w))
            every = np.array(keys, np.int64)
            ends = np.append(np.flatnonzero(np.diff(shard)) + 1, shard.size)
            for a, b in zip([0, *ends[:-1]], ends, strict=True):
                parts = [part[a:b] for part in (u, v, w)]
                if b - a < hashes.size >> 4:
                    used, rank = np.unique(np.concatenate(parts), return_inverse=True)
                    first, middle, last = rank.astype(np.uint32).reshape(3, -1)
                else:  # many of all words
                    there = np.zeros(hashes.size, bool)
                    for part in parts:
                        there[part] = True
                    used, rank = np.flatnonzero(there), np.cumsum(there, dtype=np.uint32) - np.uint32(1)
                    first, middle, last = (rank[part] for part in parts)
                starts = np.append(0, np.flatnonzero(np.diff(doc[a:b])) + 1)  # asked pairs of hot words stand with their document
                own, runs = doc[a:b][starts], np.diff(starts, append=b - a)
                fields = [squeeze(hashes[used]), *map(squeeze, (first, middle, last))]
                fields += [chunk, squeeze(runs.astype(np.uint32)), squeeze(own)] if kind == ASKED else [squeeze(spelt[used[np.unique(middle)]]), b"", b""]
                yield row(int(shard[a]), kind, *fields)
            if kind == ASKED:
                yield row(int(every[0] % shards), LENGTHS, chunk, b"", b"", b"", squeeze(spelling), squeeze(lengths.astype(np.uint32)), squeeze(every))

        def row(*fields: object) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f], t) for f, t in zip(fields, types, strict=True)], names)

        some, chars = [], 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if kind == ASKED and key in own_keys:  # a copy would add to length and sum alike
                    continue
                own_keys.add(key)
                keys.append(key)
                some.append(text.as_py())
                chars += len(some[-1])
                if chars < CHARS_AT_ONCE:
                    continue
                texts += words.read(some)
                size += sum(t.size for t in texts[-len(some) :])
                some, chars = [], 0
                if size >= WORDS_AT_ONCE:
                    yield from flush()
                    words.clear()
                    own_keys.clear()
                    texts, keys, size = [], [], 0
        if some:
            texts += words.read(some)
        if texts:
            yield from flush()

    return keyed.mapInArrow(run, PACKED)


def distinct(rows: list[tuple[bytes, bytes, bytes, bytes]]) -> tuple[np.ndarray, ...]:
    """``(word, u, v, w, gram, n)``: the distinct trigrams of packed rows, as numbers in ``word``; numbers are kept, not hashes, until they are distinct."""
    own = [expand(words, np.uint64) for words, *_ in rows]
    word = np.unique(np.concatenate(own))
    places = [np.searchsorted(word, o).astype(np.uint32) for o in own]
    u, v, w = (np.concatenate([p[expand(r[k], np.uint32)] for p, r in zip(places, rows, strict=True)]) for k in (1, 2, 3))
    gram = mix(mix(word[u], word[v]), word[w])
    order = np.argsort(gram)
    gram = gram[order]
    at = np.flatnonzero(np.concatenate([np.ones(min(gram.size, 1), bool), gram[1:] != gram[:-1]]))
    n, gram, order = np.diff(at, append=order.size), gram[at], order[at]
    return word, u[order], v[order], w[order], gram, n


def trigrams(rows: list[tuple[bytes, bytes, bytes, bytes]]) -> tuple[np.ndarray, ...]:
    """``(gram, n, context, suffix, middle, last)`` of the distinct trigrams of packed rows."""
    word, u, v, w, gram, n = distinct(rows)
    middle, last = word[v], word[w]
    return gram, n, mix(word[u], middle), mix(middle, last), middle, last


def kept_trigrams(words: bytes, first: bytes, middle: bytes, last: bytes, times: bytes) -> tuple[np.ndarray, ...]:
    """What ``trigrams`` gives, of the row in which ``survey`` keeps a shard."""
    word, (u, v, w), n = expand(words, np.uint64), (expand(k, np.uint32) for k in (first, middle, last)), expand(times, np.uint32)
    context = mix(word[u], word[v])
    gram = mix(context, word[w])
    order = np.argsort(gram)
    middle, last = word[v[order]], word[w[order]]
    return gram[order], n[order], context[order], mix(middle, last), middle, last


def frequent_words(texts: DataFrame, share: float) -> list[int]:
    """Hashes of the words that fill more than ``share`` of a hashed sixteenth of the texts: fewer than ``1 / share``.

    They only say how the work is spread; the model doesn't depend on them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, n, total = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                own, count = np.unique(cut("\n".join(t.lower() for t in batch.column(0).slice(at, 256).to_pylist()))[0], return_counts=True)
                total += count.sum()
                word, n = merged(np.concatenate([word, own]), np.concatenate([n, count]))
                if word.size > WORDS_HELD:  # a word left out here is no frequent one of this task
                    best = np.sort(np.argsort(-n, kind="stable")[: WORDS_HELD // 2])
                    word, n = word[best], n[best]
        best = np.argsort(-n, kind="stable")[: int(2 / share) if share else None]
        columns = np.append(word[best].astype(np.int64), NONE), np.append(n[best], total)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["word", "n"])

    counts = pin(texts.where(F.pmod(F.xxhash64("text"), F.lit(16)) == 0).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = counts.where(F.col("word") == NONE).agg(F.max("n")).first()[0] or 0
    return [r.word for r in counts.where((F.col("n") > total * share) & (F.col("word") != NONE)).collect()]


@dataclass
class Model:
    """The distinct trigrams of trusted text, a row for each shard, and what a shard must know of the others to weigh them.

    ``total`` and ``back`` are those of single words, ``middles`` has what a hot middle word adds, ``start`` what single words leave to the spelling, ``end`` what a text's end adds.
    """

    folder: str
    kept: DataFrame
    side: DataFrame
    shards: int
    hot: list[int]
    rates: dict[int, list[float]]
    total: int
    back: float
    middles: dict[int, float]
    start: float
    end: float

    def remove(self) -> None:
        """Remove its tables, once the perplexities asked of it are pinned."""
        remove_folder(self.kept.sparkSession, self.folder)


TOLD = "shard int, a long, b long, c long, n long, x double, words binary, first binary, middle binary, last binary, times binary, kind int"


def survey(packed: DataFrame, hot: list[int]) -> DataFrame:
    """What each shard of ``packed`` tells the others, and its distinct trigrams.

    Kind 0: how many n-grams of order ``a`` have count ``b``; 1: words ``a`` in the middle or at the end of trigrams, with the
    number of their left neighbours and the spelling of middle words; 2: pairs of a hot word ``a`` and a word ``b``, hashed ``c``, likewise;
    3: the trigrams, in the order of middle, first and last word, and their counts.
    """
    spread = np.array(sorted(hot), np.uint64)

    def run(rows: pa.Table) -> pa.Table:
        raw = [rows.column(c).to_pylist() for c in ("words", "first", "middle", "last", "spelt")]
        every, u, v, w, _, n = distinct(list(zip(*raw[:4], strict=True)))
        middle, last = every[v], every[w]
        pair, left, middle, last = merged(mix(middle, last), np.ones(middle.size, np.int64), middle, last)
        wide = np.isin(middle, spread)
        of_middle = []
        for words, middles, known in zip(raw[0], raw[2], raw[4], strict=True):
            of_middle.append((expand(words, np.uint64)[np.unique(expand(middles, np.uint32))], expand(known, np.float64)))
        spelt, at = np.unique(np.concatenate([a for a, _ in of_middle]), return_index=True)
        value = np.concatenate([x for _, x in of_middle])[at]
        spelt, value = spelt[spelt != BEGIN], value[spelt != BEGIN]
        word = np.union1d(spelt, last)
        by_word = np.full(word.size, np.nan)
        by_word[np.searchsorted(word, spelt)] = value
        parts = [(0, np.full(4, order), np.arange(1, 5), 0, np.array([(c == k).sum() for k in range(1, 5)]), 0.0) for order, c in ((3, n), (2, left[~wide]))]
        parts.append((1, word, 0, 0, np.bincount(np.searchsorted(word, last), ~wide, word.size), by_word))
        parts.append((2, middle[wide], last[wide], pair[wide], left[wide], 0.0))
        parts.append((3, np.zeros(1), 0, 0, 0, 0.0))
        columns = []
        for k, kind in enumerate([np.int32, *[np.int64] * 4, np.float64]):
            columns.append(np.concatenate([np.broadcast_to(np.asarray(p[k]), p[1].shape).astype(kind) for p in parts]))
        kind, *columns = columns
        columns[-1] = pa.array(columns[-1], from_pandas=True)  # no spelling is null
        order = np.lexsort((w, u, v))
        packs = [squeeze(every), *(squeeze(c[order].astype(np.uint32)) for c in (u, v, w, n))]
        binaries = [pa.concat_arrays([pa.nulls(kind.size - 1, pa.binary()), pa.array([p], pa.binary())]) for p in packs]
        names = [c.split()[0] for c in TOLD.split(", ")]
        return pa.table([np.full(kind.size, rows.column("shard")[0].as_py(), np.int32), *columns, *binaries, kind], names=names)

    return packed.groupBy("shard").applyInArrow(run, TOLD)


def train_words(trusted: DataFrame, logs: np.ndarray, share: float | None = None) -> Model:
    """The model of all word n-grams of ``trusted(text)``; words over ``share`` of it are hot (by default a quarter of one shard's part, as several such words can be in one shard)."""
    trusted = trusted.select(F.lit(0).cast("long").alias("key"), "text").where("text <> ''")
    size = trusted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(LEAST_SHARDS, math.ceil(size / SHARD_BYTES))
    hot = frequent_words(trusted.select("text"), 1 / (4 * shards) if share is None else share)
    spark = trusted.sparkSession
    folder = new_folder(spark)
    with shuffles_removed(spark):
        survey(packed_trigrams(trusted, logs, shards, hot, TRUSTED).repartitionById(shards, F.col("shard")), hot).write.partitionBy("kind").parquet(f"{folder}/told")
    told = spark.read.schema(TOLD).parquet(f"{folder}/told")
    rates, n, taken = {}, F.col("n"), {}
    counted = {(r.a, r.b): r.n for r in told.where("kind = 0").groupBy("a", "b").agg(F.sum("n").alias("n")).collect()}  # eight rows
    pairs = pin(told.where("kind = 2").groupBy("a", "b", "c").agg(F.sum("n").alias("n")))
    wide = pairs.agg(*(F.count_if(n == k) for k in range(1, 5))).first()
    rates[3] = rates_of(*(counted.get((3, k), 0) for k in range(1, 5)))
    rates[2] = rates_of(*(counted.get((2, k), 0) + wide[k - 1] for k in range(1, 5)))
    end = spark.createDataFrame([(END, 0, float(logs[grams("\n")][0]))], "word long, n long, spelt double")
    none = F.lit(None).cast("double")
    heard = told.where("kind = 1").select(F.col("a").alias("word"), "n", F.col("x").alias("spelt")).unionByName(pairs.select(F.col("b").alias("word"), F.lit(1).cast("long").alias("n"), none.alias("spelt")))
    one = pin(heard.unionByName(end).groupBy("word").agg(F.sum("n").alias("n"), F.max("spelt").alias("spelt")).where("n > 0"))
    rates[1] = rates_of(*one.agg(*(F.count_if(n == k) for k in range(1, 5))).first())
    total, off = one.agg(F.sum("n"), F.sum(taken_off(rates[1]))).first()
    back = off / total if total else 1.0
    low = F.exp("spelt") * back
    known = one.withColumn("p", (n - taken_off(rates[1])) / F.lit(total or 1) + low).select("word", "p", F.log(F.col("p") / low).alias("weight"))
    ends = known.where(F.col("word") == END).first()
    # hot pairs: their second words by join, their first words as there are few
    sums = pairs.groupBy("a").agg(F.sum("n").alias("total"), (F.sum(taken_off(rates[2])) / F.sum("n")).alias("back"))
    lead = pin(sums.join(known.withColumnRenamed("word", "a"), "a", "left").select("a", "total", "back", (F.log("back") + F.coalesce("weight", F.lit(0.0))).alias("adds")))
    taken = {r.a: r.adds for r in lead.collect()}  # as many as there are hot words
    low = F.col("back") * F.col("p")
    weighed = pairs.join(F.broadcast(lead.select("a", "total", "back")), "a").join(known.select(F.col("word").alias("b"), "p"), "b")
    weighed = pin(weighed.select("c", ((n - taken_off(rates[2])) / F.col("total") + low).alias("x"), low.alias("low")))
    of_words = told.where("kind = 1").select("shard", F.col("a").alias("word")).join(one, "word").select("shard", F.lit(1).alias("what"), F.col("word").alias("id"), F.col("n").cast("double").alias("x"), F.col("spelt").alias("y"))
    of_pairs = told.where("kind = 2").select("shard", "c").join(weighed, "c").select("shard", F.lit(2).alias("what"), F.col("c").alias("id"), "x", F.lit(0.0).alias("y"))
    placed = weighed.select(F.pmod("c", F.lit(shards)).cast("int").alias("shard"), F.lit(3).alias("what"), F.col("c").alias("id"), F.log(F.col("x") / F.col("low")).alias("x"), F.lit(0.0).alias("y"))

    def pack(rows: pa.Table) -> pa.Table:
        what, ids, x, y = (rows.column(c).to_numpy() for c in ("what", "id", "x", "y"))
        order = np.lexsort((ids, what))
        columns = [what[order].astype(np.uint8), ids[order].astype(np.uint64), x[order], y[order]]
        whole = [rows.column("shard")[:1], pa.array([SIDE], pa.int32()), *([squeeze(c)] for c in columns), [b""], [b""], [b""]]
        return pa.table(whole, names=["shard", "kind", "words", "first", "middle", "last", "spelt", "docs", "keys"])

    side = of_words.unionByName(of_pairs).unionByName(placed).groupBy("shard").applyInArrow(pack, PACKED)
    side = stored(side, f"{folder}/side")
    for kind in range(3):
        remove_folder(spark, f"{folder}/told/kind={kind}")
    kept = spark.read.schema(TOLD).parquet(f"{folder}/told").where("kind = 3")
    kept = kept.select("shard", F.lit(TRUSTED).alias("kind"), "words", "first", "middle", "last", F.col("times").alias("spelt"), F.lit(b"").alias("docs"), F.lit(b"").alias("keys"))
    return Model(folder, kept, side, shards, hot, rates, total or 1, back, taken, math.log(back), ends.weight if ends else 0.0)


class Shard:
    """The weights of a shard's n-grams, from its trusted trigrams and what it was told of the others."""

    def __init__(self, model_rates: dict[int, list[float]], total: int, back: float, middles: dict[int, float], side: tuple | None, row: tuple | None) -> None:
        none = (np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))
        words, pairs, placed = none, none, none
        if side:
            what, ids, x, y = (expand(s, k) for s, k in zip(side, (np.uint8, np.uint64, np.float64, np.float64), strict=True))
            words, pairs, placed = ((ids[what == k], x[what == k], y[what == k]) for k in (1, 2, 3))
            low = np.exp(words[2]) * back
            p = (words[1] - np.array([0.0, *model_rates[1]])[np.minimum(words[1], 3).astype(np.int64)]) / total + low
            words = words[0], p, np.log(p / low)
        spread = sorted(middles)
        self.spread, self.adds = np.array(spread, np.uint64), np.array([middles[k] for k in spread], np.float64)
        self.gram, self.context, self.middle, self.pair = none[:2], none[:2], none[:2], placed[:2]
        if row is None:
            return
        rate = {k: np.array([0.0, *r]) for k, r in model_rates.items()}
        gram, n, context, suffix, middle, last = kept_trigrams(*row)
        pair, left, first, second = merged(suffix, np.ones(suffix.size, np.int32), middle, last)
        del middle, last  # arrays go as soon as they can: a worker holds what it ever needed at once
        suffix = np.searchsorted(pair, suffix).astype(np.uint32)
        wide = np.isin(first, self.spread)
        p2 = found(pairs[0], pairs[1], pair)
        cold = ~wide
        of, at = np.unique(first[cold], return_inverse=True)
        off = rate[2][np.minimum(left[cold], 3)]
        total = np.bincount(at, left[cold], of.size)
        back = np.bincount(at, off, of.size) / total
        low = back[at] * found(*words[:2], second[cold])
        p2[cold] = (left[cold] - off) / total[at] + low
        own = pair[cold], np.log(p2[cold] / low)
        ids = np.concatenate([own[0], placed[0]])
        order = np.argsort(ids)
        self.pair = ids[order], np.concatenate([own[1], placed[1]])[order]
        self.middle = of, np.log(back) + found(words[0], words[2], of)
        del ids, order, own, pair, left, first, second, wide, cold, at, off, low, pairs, placed, words
        of, at = np.unique(context, return_inverse=True)
        del context
        at = at.astype(np.uint32)
        off = rate[3][np.minimum(n, 3)]
        total = np.bincount(at, n, of.size)
        back = np.bincount(at, off, of.size) / total
        low = back[at] * p2[suffix]
        del p2, suffix
        n = (n - off) / total[at]
        del off, at
        n += low
        n /= low
        self.gram = gram, np.log(n, out=n)
        self.context = of, np.log(back)

    def weigh(self, word: np.ndarray, first: np.ndarray, middle: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The weights of trigrams given as numbers in ``word``; a longer n-gram is looked for only where its context is known."""
        v = word[middle]
        context = mix(word[first], v)
        value = found(*self.context, context)
        at = np.flatnonzero(value)
        value[at] += found(*self.gram, mix(context[at], word[last[at]]))
        wide, cold = np.isin(word, self.spread)[middle], np.isin(word, self.middle[0])[middle]
        at = np.flatnonzero(np.where(wide, (word == NONE)[first], cold))
        adds = found(*self.middle, word) + found(self.spread, self.adds, word)
        value[at] += found(*self.pair, mix(v[at], word[last[at]])) + adds[middle[at]]
        return value


def perplexities(keyed: DataFrame, model: Model, logs: np.ndarray) -> DataFrame:
    """``(key, perplexity)``, pinned, one row for each key of ``keyed(key, text)``; equal keys have equal texts."""
    rates, single, middles, start, end = model.rates, (model.total, model.back), model.middles, model.start, model.end

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, side, kept, held = -1, None, None, None
        for batch in batches:
            for shard, kind, words, first, middle, last, spelt, docs, keys in (tuple(c[i].as_py() for c in batch.columns) for i in range(batch.num_rows)):
                if shard != at:
                    at, side, kept, held = shard, None, None, None
                if kind == SIDE:
                    side = words, first, middle, last
                elif kind == TRUSTED:
                    kept = words, first, middle, last, spelt
                else:
                    runs = expand(docs, np.uint32)
                    if kind == LENGTHS:
                        chunk, total = words, expand(spelt, np.float64) + start * runs + end
                        rest = keys, docs, None
                    else:
                        if held is None:
                            held, side, kept = Shard(rates, *single, middles, side, kept), None, None
                        word = expand(words, np.uint64)
                        value = held.weigh(word, *(expand(k, np.uint32) for k in (first, middle, last)))
                        chunk, total = spelt, np.add.reduceat(value, np.append(0, np.cumsum(runs[:-1], dtype=np.int64)))
                        rest = None, None, keys
                    fields = [pa.array(np.frombuffer(chunk, np.int64)), *(pa.array([f], pa.binary()) for f in (*rest, squeeze(total)))]
                    yield pa.RecordBatch.from_arrays(fields, ["chunk", "keys", "n", "at", "total"])

    def add(rows: pa.Table) -> pa.Table:
        """The sums of a chunk's documents over the shards."""
        told = list(zip(*(rows.column(c).to_pylist() for c in ("keys", "n", "at", "total")), strict=True))
        key, n, total = next((expand(k, np.int64), expand(m, np.uint32), np.array(expand(t, np.float64))) for k, m, at, t in told if at is None)
        for _, _, at, t in told:
            if at is not None:
                total[expand(at, np.uint32)] += expand(t, np.float64)
        return pa.table({"key": key, "n": n.astype(np.int64), "total": total})

    made = None
    for turn in range(PASSES):
        some = keyed.select("key", "text").where(F.pmod(F.shiftright("key", 20), F.lit(PASSES)) == turn)
        asked = packed_trigrams(some, logs, model.shards, model.hot, ASKED)
        both = model.side.unionByName(model.kept).unionByName(asked).repartitionById(model.shards, F.col("shard")).sortWithinPartitions("shard", "kind")
        summed = both.mapInArrow(meet, "chunk long, keys binary, n binary, at binary, total binary").groupBy("chunk").applyInArrow(add, "key long, n long, total double")
        sums = summed.groupBy("key").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        own = pin(sums.select("key", F.exp(-F.col("total") / F.col("n")).alias("perplexity")))
        made = own if made is None else made.unionByName(own)
    return made


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()


def judge(docs: DataFrame, labels: DataFrame, quantile: float = TRUSTED_QUANTILE) -> DataFrame:
    """``docs`` with ``perplexity``, ``cut`` and ``kept``."""
    docs = docs.drop("perplexity", "cut", "kept")
    good = broadcast_if(pin(trusted_ids(labels)), BROADCAST_ROWS)
    text = F.col("text").cast("string")
    lang: Column = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    key, band = F.xxhash64(text), F.floor(F.log2(F.length(text) + 1)).cast("int")
    trusted = docs.select("doc_id", text.alias("text"), lang.alias("of"), band.alias("band"), key.alias("key")).where("text <> ''").join(good, "doc_id", "left_semi")
    held = F.pmod("key", F.lit(HELD)) == 0
    sides = {r.held: r.n for r in trusted.groupBy(held.alias("held")).agg(F.count("*").alias("n")).collect()}  # two rows at most
    split = len(sides) == 2
    learnt = trusted.where(~held) if split else trusted
    logs = train(learnt)
    model = train_words(learnt, logs)
    scores = perplexities(docs.where("text <> ''").select(key.alias("key"), text.alias("text")), model, logs)
    model.remove()
    asked = (trusted.where(held) if split else trusted).select("of", "band", "key").join(broadcast_if(scores, BROADCAST_ROWS), "key")
    at = F.percentile_approx("perplexity", quantile, 100_000)
    cells = pin(asked.groupBy("of", "band").agg(at.alias("cell"), F.count("*").alias("cell_n")))
    bands = asked.groupBy("band").agg(at.alias("wide"), F.count("*").alias("wide_n"))
    langs = asked.groupBy("of").agg(at.alias("own"), F.count("*").alias("own_n"))
    every = asked.agg(at.alias("any")).first()["any"]
    judged = docs.withColumn("key", key).withColumn("of", lang).withColumn("band", band)
    for table, on in ((broadcast_if(scores, BROADCAST_ROWS), "key"), (broadcast_if(cells, BROADCAST_LANGS), ["of", "band"]), (F.broadcast(bands), "band"), (broadcast_if(pin(langs), BROADCAST_LANGS), "of")):
        judged = judged.join(table, on, "left")
    enough = [F.when(F.col(f"{c}_n") >= n, F.col(c)) for c, n in (("cell", LEAST), ("own", LEAST_OWN), ("wide", LEAST))]
    judged = judged.withColumn("cut", F.coalesce(*enough, F.lit(every).cast("double")))
    return judged.withColumn("kept", F.coalesce(F.col("perplexity") <= F.col("cut"), F.lit(True))).select(*docs.columns, "perplexity", "cut", "kept")
