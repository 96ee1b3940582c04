"""Two tokenizers' ids of the same texts, aligned in groups, and how often ids are linked in the whole corpus.

A transducer reads both id sequences of a text. Its state is which side leads and the
lead's unmatched bytes, the dangling suffix; the side behind gives the next token. A
transition depends on the state and that token alone and is kept, so each is compared
byte by byte once. Where the suffix is empty, tokens of both sides end: a group closes,
and its last two tokens, whose byte ranges end together, are a link.

Neither tokenizer lets a token cross the place before a single space or line end that
stands between other characters, and none looks past it. So both always end there, the
transducer is in its empty state, and a text is a sequence of pieces whose ids and
groups are found once and kept (``KEPT`` short pieces a worker).

Texts are read in blocks of bounded size. A block keeps its distinct pieces, and each
document as numbers of pieces; it sends every id pair to the corpus sums once, with its
count, however often it occurs, so pairs that fill the corpus are no hot keys. The sums
(at most one a pair of ids) and the highest sum of each B id (at most its vocabulary)
return to the blocks' pairs, and each block adds up its documents.

Defined results: null and empty texts, and texts whose tokens' joined bytes aren't a space
and the text (a text with U+2581 is one), have zeros and an empty string; repeated rows
each have their own result and count each; null ids stay; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import stored
from trawl.llm.tokens import byte_letters

#: Pieces of up to ``SHORT`` characters that one worker keeps, and transitions; at the limit it starts anew.
KEPT, SHORT, MOVES = 900_000, 48, 2_000_000
#: A block closes at so many bytes of text or documents.
BLOCK_BYTES, BLOCK_DOCS = 4_000_000, 1024
B_IDS = 1 << 20
#: Stands behind a text's last id; no id is as high.
END = (1 << 32) - 1
BLOCKS = "block string, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pieces binary, keys array<long>, counts array<long>, ends binary, links binary"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Transducer:
    """States and kept transitions. State 0 is the empty residual; the others are a side that leads and its unmatched bytes."""

    def __init__(self, a: list[bytes], b: list[bytes], most: int = MOVES) -> None:
        self.bytes, self.most = (a, b), most
        self.clear()

    def clear(self) -> None:
        self.states: list[tuple[int, bytes]] = [(1, b"")]  # with nothing unmatched, A gives the next token
        self.leads = [1]
        self.numbers = {(0, b""): 0, (1, b""): 0}
        self.moves: dict[int, int] = {}

    def move(self, state: int, token: int) -> int:
        """The state after the side behind has given ``token``; -1 if the bytes differ."""
        lead, residual = self.states[state]
        mine = self.bytes[1 - lead][token]
        if len(mine) <= len(residual):
            to = (lead, residual[len(mine) :]) if residual.startswith(mine) else None
        else:
            to = (1 - lead, mine[len(residual) :]) if mine.startswith(residual) else None
        if to is None:
            return -1
        if to not in self.numbers:
            self.numbers[to] = len(self.states)
            self.states.append(to)
            self.leads.append(to[0])
        return self.numbers[to]

    def groups(self, a: list[int], b: list[int]) -> list[tuple[int, int]] | None:
        """Where groups end, as places in ``a`` and ``b``; None if the two don't spell the same bytes."""
        if len(self.moves) > self.most:
            self.clear()
        moves, leads, state, i, j, ends = self.moves, self.leads, 0, 0, 0, []
        a, b = [*a, END], [*b, END]
        while True:
            if leads[state]:
                token = a[i]
                i += 1
            else:
                token = b[j]
                j += 1
            key = state << 32 | token
            to = moves.get(key)
            if to is None:
                if token == END:
                    return ends if state == 0 and i == len(a) and j == len(b) - 1 else None
                to = moves[key] = self.move(state, token)
                if to < 0:
                    return None
            state = to
            if not state:
                ends.append((i, j))


class Aligner:
    """Pieces of texts to ``(n_a, n_b, groups as text, id pairs)``, or None where the bytes differ."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        of = {letter: byte for byte, letter in enumerate(byte_letters())}
        names = {i: t.content for i, t in self.a.get_added_tokens_decoder().items()}
        if self.a.normalizer is not None:
            raise ValueError("the first tokenizer must spell texts as they are")
        plain = [names.get(i) or self.a.id_to_token(i) for i in range(self.a.get_vocab_size())]
        spelled = [t.encode() if i in names else bytes(map(of.__getitem__, t)) for i, t in enumerate(plain)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        raw = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.walk = Transducer(spelled, raw)
        self.names = list(map(str, range(max(len(spelled), len(raw)))))
        self.known: dict[str, tuple | None] = {}

    def ids(self, pieces: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """Of pieces that begin with a space, or with a line end after other pieces."""
        mine = [e.ids for e in self.a.encode_batch_fast(pieces, add_special_tokens=False)]
        # B puts a space before what it gets; after a line end's piece that space is a token of its own, as the line end is no part of any
        theirs = self.b.encode([p[1:] if p[0] == " " else p for p in pieces], num_threads=1)
        for piece, x, y in zip(pieces, mine, theirs, strict=True):
            yield x, y if piece[0] == " " else y[1:]

    def align(self, piece: str, a: list[int], b: list[int]) -> tuple | None:
        """A's tokens always spell the piece; if B's spell the same, the transducer comes to its end."""
        ends = self.walk.groups(a, b)
        if ends is None:
            return None
        said, pairs, i, j, names = [], [], 0, 0, self.names
        for x, y in ends:
            left = names[a[i]] if x - i == 1 else ",".join(map(names.__getitem__, a[i:x]))
            said.append(f"{left}|{names[b[j]] if y - j == 1 else ','.join(map(names.__getitem__, b[j:y]))};")
            pairs.append(a[x - 1] * B_IDS + b[y - 1])
            i, j = x, y
        return len(a), len(b), "".join(said), array("q", pairs).tobytes()

    def learn(self, pieces: list[str]) -> list[tuple | None]:
        """The results of those pieces, none twice; short ones are kept."""
        known = self.known
        new = [p for p in pieces if p not in known]
        found = {p: self.align(p, a, b) for p, (a, b) in zip(new, self.ids(new), strict=True)} if new else {}
        results = [found[p] if p in found else known[p] for p in pieces]
        if len(known) + len(found) > KEPT:
            known.clear()
            found = dict(zip(pieces, results, strict=True))
        known.update((p, x) for p, x in found.items() if len(p) <= SHORT)
        return results


@cache
def aligner(a_path: str, b_path: str) -> Aligner:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
    return Aligner(a_path, b_path)


SCHEMA = pa.schema(
    [("block", pa.string()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups")), ("groups_sha256", pa.string()), ("pieces", pa.binary()), ("keys", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("ends", pa.binary()), ("links", pa.binary())]
)


def pieces_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The texts, each behind a space, cut into pieces; and where each text's pieces end. Null and empty texts have none."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts.filter(pa.array(lengths > 0)).cast(pa.large_string()), pa.scalar(" ", pa.large_string()))
    offsets = np.frombuffer(spaced.buffers()[1] or bytes(8), np.int64)[spaced.offset : spaced.offset + len(spaced) + 1] if len(spaced) else np.zeros(1, np.int64)
    data = np.frombuffer(spaced.buffers()[2] or b"", np.uint8)[: offsets[-1]] if len(spaced) else np.zeros(0, np.uint8)
    gap = (data == 32) | (data == 10)
    starts = np.zeros(data.size + 1, bool)
    if data.size > 2:
        starts[1:-2] = gap[1:-1] & ~gap[:-2] & ~gap[2:]
    starts[np.concatenate([offsets[1:] - 1, offsets[:-1]])] = False  # a text's first and last characters have no neighbour there
    starts[offsets] = True
    at = np.flatnonzero(starts)
    pieces = pa.Array.from_buffers(pa.large_string(), at.size - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)])
    ends = np.zeros(len(texts), np.int64)
    ends[lengths > 0] = np.diff(np.searchsorted(at, offsets))
    return pieces.dictionary_encode(), np.cumsum(ends)


def per_text(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of ``values[begin : end]``."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[end] - total[begin]


def rows_of(docs: pa.Array, texts: pa.Array, learn: Callable[[list[str]], list[tuple | None]]) -> Iterator[pa.RecordBatch]:
    """A row for each document, and one with the block's id pairs, their counts, and which of them each piece links."""
    block = uuid.uuid4().hex
    pieces, end = pieces_of(texts)
    begin = np.concatenate([[0], end[:-1]])
    index = pieces.indices.to_numpy()
    results = learn(pieces.dictionary.to_pylist())
    sizes = np.array([(r[0], r[1], len(r[3]) // 8) if r else (0, 0, 0) for r in results], np.int64).reshape(-1, 3)
    sound = (per_text(np.array([r is None for r in results], bool)[index], begin, end) == 0) & (end > begin)
    said = pa.array([r[2] if r else "" for r in results], pa.large_string()).take(pieces.indices)
    ends, spelled = np.frombuffer(said.buffers()[1] or bytes(8), np.int64)[: len(said) + 1], memoryview(said.buffers()[2] or b"")
    linked = np.frombuffer(b"".join(r[3] for r in results if r), np.int64)
    keys, place = np.unique(linked, return_inverse=True)
    used = np.bincount(index[np.repeat(sound, end - begin)], minlength=len(results))
    counts = np.bincount(place, weights=np.repeat(used, sizes[:, 2]), minlength=keys.size).astype(np.int64)
    there = np.flatnonzero(counts)  # pieces of unsound texts alone link nothing
    spot = np.full(keys.size, -1, np.int32)
    spot[there] = np.arange(there.size)
    sums = [np.where(sound, per_text(sizes[index, k], begin, end), 0).tolist() for k in range(3)]
    out = []
    for k, doc in enumerate(docs.to_pylist()):
        a, b = begin[k], end[k]
        sha = hashlib.sha256(spelled[ends[a] : ends[b] - 1]).hexdigest() if sound[k] else ""
        out.append((block, doc, sums[0][k], sums[1][k], sums[2][k], sha, index[a:b].tobytes() if sound[k] else b"", None, None, None, None))
    out.append((block, None, None, None, None, None, None, keys[there].tolist(), counts[there].tolist(), np.cumsum(sizes[:, 2]).astype(np.int32).tobytes(), spot[place].astype(np.int32).tobytes()))
    for at in range(0, len(out), 64):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[at : at + 64], strict=True), SCHEMA.types, strict=True)], schema=SCHEMA)


def blocks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``docs(doc_id, text)`` to rows of ``BLOCKS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learn = aligner(a_path, b_path).learn
        held: list[pa.RecordBatch] = []
        filled = count = 0

        def close() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held).combine_chunks()
            return rows_of(*(whole.column(k).combine_chunks() for k in range(2)), learn)

        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            first = 0
            for k, size in enumerate(sizes):
                filled, count = filled + size, count + 1
                if filled >= BLOCK_BYTES or count >= BLOCK_DOCS or k + 1 == len(sizes):
                    held.append(batch.slice(first, k + 1 - first))
                    first = k + 1
                if filled >= BLOCK_BYTES or count >= BLOCK_DOCS:
                    yield from close()
                    held, filled, count = [], 0, 0
        if held:
            yield from close()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, BLOCKS)


def summed(docs: pa.Table, values: pa.Table) -> pa.Table:
    """Documents of one block with the sums over their links; ``docs`` holds the block's own row too."""
    rows = docs.to_pylist()
    own = next((r for r in rows if r["ends"] is not None), None)
    ends, links = (np.frombuffer(own[c], np.int32) for c in ("ends", "links"))
    count, best = np.zeros(len(own["keys"]) + 1, np.int64), np.zeros(len(own["keys"]) + 1, np.int64)  # the last is that of pieces that link nothing
    at = values["at"].to_numpy()
    count[at], best[at] = values["n"].to_numpy(), values["best"].to_numpy(zero_copy_only=False)
    piece = np.repeat(np.arange(ends.size), np.diff(ends, prepend=0))
    by_piece = [np.zeros(ends.size, np.int64) for _ in range(2)]
    for total, value in zip(by_piece, (best, count), strict=True):
        np.add.at(total, piece, value[links])
    out = []
    for r in rows:
        if r["ends"] is None:
            k = np.frombuffer(r["pieces"], np.int32)
            out.append((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_groups"], *(int(v[k].sum()) for v in by_piece), r["groups_sha256"]))
    names = [c.split()[0] for c in RESULT.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string()]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds], names)


def pair_counts(made: DataFrame) -> DataFrame:
    """``(key, n, best)``: of every id pair the links in the corpus, and whether that is its B id's highest count."""
    sums = stored(made.where("keys IS NOT NULL").select(F.explode(F.arrays_zip("keys", "counts")).alias("p")).groupBy(F.col("p.keys").alias("key")).agg(F.sum("p.counts").alias("n")).withColumn("b", F.col("key") % B_IDS))
    highest = sums.groupBy("b").agg(F.max("n").alias("most"))  # a row for each B id: the vocabulary bounds it
    return sums.join(F.broadcast(highest), "b").select("key", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``docs(doc_id, text)`` to one row of ``RESULT`` each."""
    made = stored(blocks(docs, a_path, b_path))
    asked = made.where("keys IS NOT NULL").select(F.col("block").alias("of"), F.posexplode("keys").alias("at", "key"))
    values = asked.join(pair_counts(made), "key").select("of", "at", "n", "best")
    return made.groupBy("block").cogroup(values.groupBy("of")).applyInArrow(summed, RESULT)
