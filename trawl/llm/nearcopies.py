"""Near copies by their shingle sets: shared rare shingles give the candidates, the sets decide.

A text's class is a fingerprint and a hash of its set of shingles, so texts of equal sets are one. Two sets of the wanted
Jaccard similarity share one of their first shingles in any order that is the same for all: of n shingles the first
n less the share that must be common, and one more. The order is by rarity, so that few other classes have these; rarity comes from counts by
hash, and only says how much work there is. Classes meet in shards of such shingles, and those whose
fingerprints differ in no more bits than the similarity gives, and ``DEVIATIONS`` standard deviations more, are candidates. Only
classes with a candidate partner get their sets, from one of their documents. The sets of a component of candidates meet in one task,
or those of a large one in the tasks of its block pairs, and only pairs whose sets have the
wanted similarity are linked. A tile with many candidate pairs counts all their common shingles by products
of incidence matrices, so a large group of near copies costs tiles, not pairs. A task gives out its
links contracted to local roots. What is shuffled grows with the input: no class travels to all others.

Defined results: a null text is empty, and empty texts are one class; rows that share an id are one document; rows without an id are in no group; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import broadcast_if, connected_components, pin, union_pairs
from trawl.llm.quality import expand, squeeze
from trawl.llm.simhash import TILE_ROWS, binaries, close_rows, component_ids, gap, half_counts, radius_for, tiles, wide_fingerprint

LANES, SET_LANES = 2, 2
WIDTH = LANES + SET_LANES
BLOCK_ROWS = 4096
BLOCK_BYTES = 32 << 20
#: Sets that are compared together although they belong to several components.
GROUP_ROWS, GROUP_BYTES = 1024, 8 << 20
DEVIATIONS = 6
#: Up to so many candidate pairs of a tile pair are compared one by one.
FEW_PAIRS = 64
SHINGLES_AT_ONCE = 8192
#: Classes (some 70 bytes each) that may be broadcast to fetch their texts; ids that may be to drop their rows.
BROADCAST_ROWS = 500_000
#: Counters of shingles, and those that travel in a row.
COUNTERS, COUNTERS_AT_ONCE = 1 << 22, 1 << 16
#: First shingles that one task compares, those packed at once, and bits of them that are kept.
SHARD_KEYS, KEYS_AT_ONCE, KEY_BITS = 1 << 21, 1 << 19, 48
LEAST_SHARDS = 16
#: Classes that share a shingle of which all pairs are made at once; more are compared in tiles.
FEW_CLASSES, PAIRS_AT_ONCE = 64, 1 << 19
TEXT_AT_ONCE = 1 << 18

#: Bytes as the words see them: ASCII letters small, ASCII white space between words.
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
BLANK = np.array([not bytes([b]).split() for b in range(256)])
CODES = np.random.default_rng(42).integers(0, 1 << 64, 256, np.uint64)
FACTOR = 0xD1342543DE82EF95


def mixed(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def sets_at_once(texts: list[bytes], shingle: int) -> Iterator[np.ndarray]:
    codes = LOWER[np.frombuffer(b" ".join([*texts, b""]), np.uint8)]
    inside = ~BLANK[codes]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))  # of each word its first byte and the one behind it
    starts, size = edges[::2], np.diff(edges)[::2]
    word = np.zeros(0, np.uint64)
    if size.size:
        first = np.cumsum(size) - size
        powers = np.cumprod(np.full(size.max(), FACTOR, np.uint64))
        each = CODES[codes[inside]] * powers[np.arange(first[-1] + size[-1]) - np.repeat(first, size)]
        word = mixed(np.add.reduceat(each, first))
    held = max(0, word.size - shingle + 1)
    spans = word[:held]
    for k in range(1, shingle):
        spans = mixed(spans * np.uint64(FACTOR) + word[k : k + held])
    at = 0
    for end in np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts])).tolist():
        short = word[at:end] if end - at < shingle else word[:0]
        whole = mixed(short[:1] + np.uint64(short.size))
        for k in range(1, short.size):
            whole = mixed(whole * np.uint64(FACTOR) + short[k : k + 1])
        yield whole if end - at < shingle else np.unique(spans[at : end - shingle + 1])
        at = end


def shingle_sets(texts: Iterable[bytes | None], shingle: int) -> Iterator[np.ndarray]:
    """The hashes of each text's distinct shingles of words, in order; a shorter text is one shingle, one without words has none."""
    some, size = [], 0
    for text in texts:
        some.append(text or b"")
        size += len(some[-1])
        if size >= TEXT_AT_ONCE:
            yield from sets_at_once(some, shingle)
            some, size = [], 0
    yield from sets_at_once(some, shingle)


def class_of(hashes: np.ndarray) -> bytes:
    """The fingerprint and the hash of a set of shingles."""
    return wide_fingerprint(hashes, LANES).astype(">u8").tobytes() + hashlib.blake2b(hashes.tobytes(), digest_size=8 * SET_LANES).digest()


def firsts_of(size: int, similarity: float) -> int:
    """So many first shingles of a set of ``size`` hold one of any other of that similarity."""
    return size - math.ceil(similarity * size - 1e-9) + 1 if size else 0


def counter(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(COUNTERS - 1)).astype(np.int64)


def marked_texts(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``(doc_id, text_hash, fp, keys)``: each document's class and the number of its first shingles; and rows with ``part``, in which a task's ``counts`` of shingles are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            classes, keys = [], []
            for hashes in shingle_sets((t.as_py() for t in batch.column(2)), shingle):
                classes.append(class_of(hashes))
                keys.append(firsts_of(hashes.size, similarity))
                np.add.at(held, counter(hashes), 1)
            none = [pa.nulls(len(classes), t) for t in (pa.int32(), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(classes, pa.binary()), pa.array(keys, pa.int32()), *none], names)
        for part, counts in enumerate(np.split(held, COUNTERS // COUNTERS_AT_ONCE)):
            if counts.any():
                none = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.int32())]
                yield pa.RecordBatch.from_arrays([*none, pa.array([part], pa.int32()), pa.array([squeeze(counts)])], names)

    schema = "doc_id long, text_hash long, fp binary, keys int, part int, counts binary"
    names = [c.split()[0] for c in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def rarity(marked: DataFrame) -> np.ndarray:
    """For each counter how often its shingles occur, as a multiple of a logarithm; the documents' order doesn't matter."""

    def add(rows: pa.Table) -> pa.Table:
        total = sum(expand(c.as_py(), np.uint32).astype(np.int64) for c in rows.column("counts"))
        steps = np.minimum(255, np.rint(16 * np.log2(1 + total))).astype(np.uint8)
        return pa.table({"part": rows.column("part")[:1], "steps": pa.array([steps.tobytes()], pa.binary())})

    made = np.zeros(COUNTERS, np.uint8)
    for row in marked.where("part IS NOT NULL").select("part", "counts").groupBy("part").applyInArrow(add, "part int, steps binary").collect():  # a byte a counter
        made[row.part * COUNTERS_AT_ONCE :][:COUNTERS_AT_ONCE] = np.frombuffer(row.steps, np.uint8)
    return made


PACKED = "shard int, keys binary, owners binary, classes binary"


def packed_keys(docs: DataFrame, shingle: int, similarity: float, rare: np.ndarray, shards: int) -> DataFrame:
    """The first shingles of ``docs(text)`` as packed rows for each shard, with the classes that have them."""
    shared = docs.sparkSession.sparkContext.broadcast(rare)
    names = [c.split()[0] for c in PACKED.split(", ")]

    def flush(found: dict[bytes, np.ndarray]) -> Iterator[pa.RecordBatch]:
        key = np.concatenate([*found.values(), np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(found), dtype=np.uint32), [k.size for k in found.values()])
        order = np.argsort(key)
        key, owner = key[order], owner[order]
        shard = ((key >> np.uint64(KEY_BITS - 32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)  # ranges, so that keys in order pack well
        classes = np.frombuffer(b"".join(found), ">u8").reshape(-1, WIDTH)
        ends = np.append(np.flatnonzero(np.diff(shard)) + 1, shard.size)
        for a, b in zip([0, *ends[:-1]], ends, strict=True) if shard.size else []:
            used, own = np.unique(owner[a:b], return_inverse=True)
            fields = [squeeze(key[a:b]), squeeze(own.astype(np.uint32)), classes[used].tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array(shard[a : a + 1], pa.int32()), *(pa.array([f], pa.binary()) for f in fields)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, found, size = shared.value, {}, 0
        for batch in batches:
            for hashes in shingle_sets((t.as_py() for t in batch.column(0)), shingle):
                first = np.argsort(rank[counter(hashes)], kind="stable")[: firsts_of(hashes.size, similarity)]
                own = found.setdefault(class_of(hashes), hashes[first] >> np.uint64(64 - KEY_BITS))
                size += own.size
                if size >= KEYS_AT_ONCE:
                    yield from flush(found)
                    found, size = {}, 0
        yield from flush(found)

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, PACKED)


def shared_keys(rows: list[tuple[bytes, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of packed rows the classes that share a key with another, and, bucket by bucket, their numbers and the size of each bucket."""
    key = np.concatenate([expand(k, np.uint64) for k, _, _ in rows])
    classes = [np.frombuffer(c, f"V{8 * WIDTH}") for _, _, c in rows]
    before = np.cumsum([0, *(c.size for c in classes)])
    owner = np.concatenate([expand(o, np.uint32) + np.int64(b) for (_, o, _), b in zip(rows, before[:-1], strict=True)])
    order = np.argsort(key)
    key = key[order]
    same = key[1:] == key[:-1]
    twice = np.append(same, False) | np.insert(same, 0, False)
    key, owner = key[twice], owner[order[twice]]
    used, owner = np.unique(owner, return_inverse=True)
    word, number = np.unique(np.concatenate(classes)[used], return_inverse=True)
    owner = number[owner]
    order = np.lexsort((owner, key))
    key, owner = key[order], owner[order]
    new = np.append(True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1]))[: key.size]  # a class can stand in several rows
    key, owner = key[new], owner[new]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: key.size])
    size = np.diff(at, append=key.size)
    return np.frombuffer(word.tobytes(), ">u8").astype(np.uint64).reshape(-1, WIDTH), owner, size


def close_tiles(rows: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs of different rows within the radius, tile pair by tile pair; rows are in the order of ``ordered``."""
    bounds = tiles(rows[:, :LANES], TILE_ROWS)
    for i, bound in enumerate(bounds):
        at = i * TILE_ROWS
        close = np.flatnonzero(gap(bound, bounds) <= radius)
        for j in close[close >= i].tolist():
            x, y = close_rows(rows[at : at + TILE_ROWS, :LANES], rows[j * TILE_ROWS : (j + 1) * TILE_ROWS, :LANES], radius)
            x, y = x + at, y + j * TILE_ROWS
            new = x < y
            if new.any():
                yield x[new], y[new]


def ordered(rows: np.ndarray) -> np.ndarray:
    """Places by population counts, as tiles need them."""
    return np.lexsort(half_counts(rows[:, :LANES])[::-1])


def candidate_roots(classes: np.ndarray, owner: np.ndarray, size: np.ndarray, radius: int) -> np.ndarray:
    """The least class that each reaches by pairs within the radius that share a bucket."""
    root, start = np.arange(len(classes)), np.cumsum(size) - size
    for n in range(2, FEW_CLASSES + 1):
        left, right = np.triu_indices(n, 1)
        at = start[size == n]
        for some in np.split(at, range(PAIRS_AT_ONCE // left.size, at.size, PAIRS_AT_ONCE // left.size)):
            x, y = (owner[some[:, None] + side].ravel() for side in (left, right))
            open_ = root[x] != root[y]
            x, y = x[open_], y[open_]
            near = np.bitwise_count(classes[x, :LANES] ^ classes[y, :LANES]).sum(axis=1, dtype=np.int64) <= radius
            root = union_pairs(root, x[near], y[near])
    for at in np.flatnonzero(size > FEW_CLASSES).tolist():
        some = owner[start[at] : start[at] + size[at]]
        some = some[ordered(classes[some])]
        for x, y in close_tiles(classes[some], radius):
            root = union_pairs(root, some[x], some[y])
    return root


def common_shingles(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each pair the number of shingles in both."""
    if x.size <= FEW_PAIRS:
        return np.array([np.intersect1d(sets[i], sets[j], assume_unique=True).size for i, j in zip(x.tolist(), y.tolist(), strict=True)], np.int64)
    (left, ix), (right, iy) = (np.unique(side, return_inverse=True) for side in (x, y))
    flat = [np.concatenate([sets[k] for k in side.tolist()]) for side in (left, right)]
    owner = [np.repeat(np.arange(side.size), [sets[k].size for k in side.tolist()]) for side in (left, right)]
    both = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
    column, kept = [], []
    for values in flat:
        at = np.minimum(np.searchsorted(both, values), max(0, both.size - 1))
        column.append(at)
        kept.append(both[at] == values if both.size else np.zeros(values.size, bool))
    total = np.zeros((left.size, right.size), np.float32)
    for at in range(0, both.size, SHINGLES_AT_ONCE):
        holds = []
        for side, col, keep, own in zip((left, right), column, kept, owner, strict=True):
            some = keep & (col >= at) & (col < at + SHINGLES_AT_ONCE)
            matrix = np.zeros((side.size, min(SHINGLES_AT_ONCE, both.size - at)), np.float32)
            matrix[own[some], col[some] - at] = 1
            holds.append(matrix)
        total += holds[0] @ holds[1].T
    return total[ix, iy].astype(np.int64)


def candidates(docs: DataFrame, marked: DataFrame, shingle: int, similarity: float, radius: int) -> DataFrame:
    """Contracted links ``(a, b)`` between classes that share a first shingle and whose fingerprints are close."""
    keys = marked.agg(F.sum("keys")).first()[0] or 0
    shards = max(LEAST_SHARDS, math.ceil(keys / SHARD_KEYS))

    def meet(rows: pa.Table) -> pa.Table:
        classes, owner, size = shared_keys(list(zip(*(rows.column(c).to_pylist() for c in ("keys", "owners", "classes")), strict=True)))
        root = candidate_roots(classes, owner, size, radius)
        moved = np.flatnonzero(root != np.arange(root.size))
        return pa.table({"a": binaries(classes[moved]), "b": binaries(classes[root[moved]])})

    packed = packed_keys(docs, shingle, similarity, rarity(marked), shards)
    return packed.repartitionById(shards, F.col("shard")).groupBy("shard").applyInArrow(meet, "a binary, b binary")


def links(firsts: DataFrame, marked: DataFrame, docs: DataFrame, shingle: int, similarity: float, block_rows: int) -> DataFrame:
    """``firsts(fp, first, text_hash)`` to contracted links ``(a, b)`` between classes whose sets are as similar as that."""
    radius = radius_for(similarity, 64 * LANES, DEVIATIONS)
    among = connected_components(candidates(docs, marked, shingle, similarity, radius)).withColumnRenamed("node", "fp")
    wanted = firsts.join(among, "fp").select("fp", "root", F.col("first").alias("_nc_id"), F.col("text_hash").alias("_nc_hash"))
    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    texts = one.join(broadcast_if(pin(wanted), BROADCAST_ROWS), (F.col("doc_id") == F.col("_nc_id")) & (F.col("text_hash") == F.col("_nc_hash"))).select("fp", "root", "text")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.tobytes() for s in shingle_sets((t.as_py() for t in batch.column(2)), shingle)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.large_binary()).cast(pa.binary())], ["fp", "root", "shingles"])

    sets = pin(texts.mapInArrow(sets_of, "fp binary, root binary, shingles binary").dropDuplicates(["fp"]))
    sized = sets.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.length("shingles")).alias("bytes"))
    total = sized.agg(F.sum("n"), F.sum("bytes")).first()
    groups = max(1, math.ceil((total[0] or 0) / GROUP_ROWS), math.ceil((total[1] or 0) / GROUP_BYTES))
    parts = F.greatest(F.ceil(F.col("n") / block_rows), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    large = pin(sized.select("root", parts.alias("parts")).where("parts > 1"))
    own, other = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    spread = sets.join(broadcast_if(large, BROADCAST_ROWS), "root").withColumn("own", own).withColumn("other", other)
    spread = spread.select("fp", "shingles", F.xxhash64("root").alias("home"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    few = sets.join(broadcast_if(large, BROADCAST_ROWS), "root", "left_anti")
    few = few.select("fp", "shingles", F.pmod(F.xxhash64("root"), F.lit(groups)).alias("home"), F.lit(-1).alias("i"), F.lit(-1).alias("j"))

    def verify(rows: pa.Table) -> pa.Table:
        fps = np.frombuffer(b"".join(rows.column("fp").to_pylist()), ">u8").astype(np.uint64).reshape(-1, WIDTH)
        order = ordered(fps)
        fps, held = fps[order], rows.column("shingles").to_pylist()
        sets = [np.frombuffer(held[k], np.uint64) for k in order.tolist()]
        size = np.array([s.size for s in sets], np.int64)
        root = np.arange(len(fps))
        for x, y in close_tiles(fps, radius):
            fits = np.minimum(size[x], size[y]) >= similarity * np.maximum(size[x], size[y]) - 1e-9
            open_ = fits & (root[x] != root[y])
            x, y = x[open_], y[open_]
            common = common_shingles(sets, x, y)
            near = common >= similarity * (size[x] + size[y] - common) - 1e-9
            root = union_pairs(root, x[near], y[near])
        moved = np.flatnonzero(root != np.arange(root.size))
        return pa.table({"a": binaries(fps[moved]), "b": binaries(fps[root[moved]])})

    return few.unionByName(spread).groupBy("home", "i", "j").applyInArrow(verify, "a binary, b binary")


def near_copy_groups(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(doc_id, component_id)`` of the rows of ``docs(doc_id, text)`` that have an id: the smallest id that links of that similarity reach."""
    named = docs.where("doc_id IS NOT NULL")
    marked = pin(marked_texts(named, shingle, similarity))
    told, marked = marked, marked.where("part IS NULL").select("doc_id", "text_hash", "fp")
    firsts = pin(marked.groupBy("fp").agg(F.min(F.struct("doc_id", "text_hash")).alias("f"), F.count("*").alias("copies")).select("fp", F.col("f.doc_id").alias("first"), "f.text_hash", "copies"))
    return component_ids(marked.select("doc_id", "fp"), firsts.select("fp", "first", "copies"), links(firsts, told, named, shingle, similarity, block_rows)).select("doc_id", "component_id")


def without_near_copies(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """``docs`` with one document of each group of near copies, that with the smallest id.

    Rows that share an id are one document: they stay if any of them stands for its group. A row
    with a null id can't stand for a group and isn't known as a copy; it stays.
    """
    grouped = pin(near_copy_groups(docs, similarity, shingle))
    gone = grouped.groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays")).where("NOT stays")
    gone = broadcast_if(pin(gone.select(F.col("doc_id").alias("_nd_id"))), BROADCAST_ROWS)
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("_nd_id"), "left_anti")
