"""SimHash near-duplicates: tiled exact comparison of fingerprints of 64 bits, or of several times 64.

Every text becomes one fingerprint. Equal fingerprints collapse to one row before
anything is compared. The distinct fingerprints are ordered by the population
counts of their two halves and cut into blocks; two blocks meet in one task only
if their counts allow a distance within the radius, and inside the task tiles
with incompatible counts are skipped before the exclusive-or. A task reports its
components as links to a local root, never all pairs.

Defined results: a null text counts as empty; a text with fewer words than a
shingle is one shingle; a text without words has fingerprint zero and links like
any other. Repeated ids give one row each. A null id never gives a component its id; only a component of null
ids alone has a null one. Empty tables give empty results.
Other input columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import connected_components, join_spread, pin, union_pairs

SEED = 42
BLOCK_ROWS = 16384
#: Tasks that block pairs are dealt to, at most.
MOST_TASKS = 4096
TILE_ROWS = 256
HASHES_AT_ONCE = 1 << 16


def radius_for(similarity: float, bits: int, deviations: float = 1) -> int:
    """Bits in which texts of this Jaccard similarity of shingles differ, and so many standard deviations more.

    A bit differs with the angle between the shingle counts; sets of one size and
    similarity s have the cosine 2s / (1 + s).
    """
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return round(bits * share + deviations * np.sqrt(bits * share * (1 - share)))


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """A hash for each shingle of words, repeats included; a shorter text is one shingle, one without words has none."""
    words = (text or b"").lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    joined = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in joined), np.uint64)


def wide_fingerprint(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """The fingerprint of a text's shingles in ``lanes`` unsigned integers; the first is that of ``fingerprint``."""
    set_bits = np.zeros((lanes, 64), np.int64)
    for at in range(0, hashes.size, HASHES_AT_ONCE):
        part = hashes[at : at + HASHES_AT_ONCE]
        for k in range(lanes):
            if k:  # further lanes mix the hash again
                part = (part ^ part >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)
                part = (part ^ part >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
            set_bits[k] += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * set_bits > hashes.size, axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprint(text: bytes | None, shingle: int) -> int:
    return int(wide_fingerprint(shingle_hashes(text, shingle), 1)[0])


def fingerprints(docs: DataFrame, shingle: int = 4, lanes: int = 1) -> DataFrame:
    """``(doc_id, fp BINARY)``; the lanes stand big-endian one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [wide_fingerprint(shingle_hashes(t.as_py(), shingle), lanes).astype(">u8").tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.binary())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp binary")


def rows_of(fps: pa.Array, lanes: int) -> np.ndarray:
    """A binary column as rows of unsigned integers."""
    return np.frombuffer(b"".join(fps.to_pylist()), ">u8").astype(np.uint64).reshape(-1, lanes)


def binaries(rows: np.ndarray) -> pa.Array:
    width = 8 * rows.shape[1]
    raw = rows.astype(">u8").tobytes()
    return pa.array([raw[i : i + width] for i in range(0, len(raw), width)], pa.binary())


def half_counts(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Population counts of the upper and the lower half of each row."""
    lanes = fps.shape[1]
    if lanes == 1:
        fps = np.concatenate([fps >> np.uint64(32), fps & np.uint64(0xFFFFFFFF)], axis=1)
        lanes = 2
    counts = np.bitwise_count(fps).astype(np.int64)
    return counts[:, : lanes // 2].sum(axis=1), counts[:, lanes // 2 :].sum(axis=1)


def blocks_of(cells: list[tuple[int, int, int]], block_rows: int) -> tuple[dict[tuple[int, int], tuple[int, int]], np.ndarray]:
    """Cut cells ``(upper count, lower count, rows)`` into blocks of about ``block_rows``.

    Returns for each cell its first block and number of blocks, and for each block
    the bounds of both counts. There are at most (half the bits + 1) squared cells.
    """
    place, bounds, filled = {}, [], block_rows
    for hi, lo, n in sorted(cells):
        if n > block_rows:
            parts = -(-n // block_rows)
            place[hi, lo] = len(bounds), parts
            bounds += [[hi, hi, lo, lo]] * parts
            filled = block_rows
            continue
        if filled + n > block_rows:
            bounds.append([hi, hi, lo, lo])
            filled = 0
        filled += n
        bounds[-1] = [min(bounds[-1][0], hi), max(bounds[-1][1], hi), min(bounds[-1][2], lo), max(bounds[-1][3], lo)]
        place[hi, lo] = len(bounds) - 1, 1
    return place, np.array(bounds, np.int64).reshape(-1, 4)


def gap(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The least distance that the count bounds allow between one block or tile and many."""
    apart = lambda k: np.maximum(0, np.maximum(one[k] - many[:, k + 1], many[:, k] - one[k + 1]))
    return apart(0) + apart(2)


def tiles(fps: np.ndarray, rows: int) -> np.ndarray:
    hi, lo = half_counts(fps)
    cut = np.arange(0, len(fps), rows)
    return np.stack([f.reduceat(c, cut) for c in (hi, lo) for f in (np.minimum, np.maximum)], axis=1)


def close_rows(mine: np.ndarray, other: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows of two tiles that differ in at most ``radius`` bits."""
    lanes = mine.shape[1]
    first = min(2, lanes)  # bits of some lanes rule out most pairs
    apart = np.bitwise_count(mine[:, None, 0] ^ other[None, :, 0])
    for k in range(1, first):
        apart += np.bitwise_count(mine[:, None, k] ^ other[None, :, k])
    x, y = np.nonzero(apart <= radius)
    if lanes > first:
        near = apart[x, y] + np.bitwise_count(mine[x, first:] ^ other[y, first:]).sum(axis=1, dtype=np.int64) <= radius
        x, y = x[near], y[near]
    return x, y


def linked(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All links of the block pair, contracted: fingerprints and their local roots."""
    order = lambda x: x[np.lexsort(half_counts(x)[::-1])]
    a = order(a)
    both = a if b is None else np.concatenate([a, order(b)])
    base = 0 if b is None else len(a)
    other = both[base:]
    root = np.arange(len(both))
    others = tiles(other, TILE_ROWS)
    for i, bound in enumerate(tiles(a, TILE_ROWS)):
        at = i * TILE_ROWS
        close = np.flatnonzero(gap(bound, others) <= radius)
        for j in close[close >= i] if b is None else close:
            x, y = close_rows(a[at : at + TILE_ROWS], other[j * TILE_ROWS : (j + 1) * TILE_ROWS], radius)
            root = union_pairs(root, x + at, y + base + j * TILE_ROWS)
    moved = np.flatnonzero(root != np.arange(root.size))
    return both[moved], both[root[moved]]


def block_pairs(fps: DataFrame, radius: int, block_rows: int, lanes: int, more: int = 0) -> tuple[DataFrame, int]:
    """Distinct ``fps(fp)`` to ``(pair, second, fps)``: the packed blocks of each pair that its counts allow; and the number of blocks.

    ``more`` lanes behind those that are compared go along. A block is one packed row of at most ``block_rows`` fingerprints and travels to
    the tasks of its block pairs as such. The work is that of comparing all block
    pairs with compatible counts, so it grows with the square of the distinct
    fingerprints; it is dealt to as many tasks as there are block pairs, up to ``MOST_TASKS``.
    """
    width = lanes + more

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hi, lo = half_counts(rows_of(batch.column(0), width)[:, :lanes])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hi), pa.array(lo)], ["fp", "hi", "lo"])

    halves = fps.select("fp").mapInArrow(counted, "fp binary, hi long, lo long")
    cells = [tuple(r) for r in halves.groupBy("hi", "lo").count().collect()]  # half the bits squared at most
    place, bounds = blocks_of(cells, block_rows)
    blocks = len(bounds)
    met = sum(int((gap(bound, bounds[k:]) <= radius).sum()) for k, bound in enumerate(bounds))

    def place_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = rows_of(batch.column(0), width)
            first = np.array([place[c] for c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)], np.int64).reshape(-1, 2)
            block = first[:, 0] + (fp[:, 0] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % np.maximum(1, first[:, 1])
            yield pa.RecordBatch.from_arrays([pa.array(block), batch.column(0)], ["block", "fp"])

    def pack(rows: pa.Table) -> pa.Table:
        return pa.table({"block": rows.column("block")[:1], "fps": [b"".join(rows.column("fp").to_pylist())]})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, fps in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for p in np.flatnonzero(gap(bounds[k], bounds) <= radius).tolist():
                    yield pa.RecordBatch.from_arrays([pa.array([min(k, p) * blocks + max(k, p)]), pa.array([k > p]), pa.array([fps.as_py()])], ["pair", "second", "fps"])

    packed = halves.mapInArrow(place_rows, "block long, fp binary").groupBy("block").applyInArrow(pack, "block long, fps binary")
    return packed.mapInArrow(deal, "pair long, second boolean, fps binary").repartition(max(1, min(met, MOST_TASKS)), "pair"), blocks


def sides_of(key: tuple, rows: pa.Table, blocks: int, width: int) -> tuple[np.ndarray, np.ndarray | None] | None:
    """The two blocks of a pair, or one and None if a block meets itself; None if a block is empty."""
    sides = {s: np.frombuffer(f, ">u8").astype(np.uint64).reshape(-1, width) for s, f in zip(rows.column("second").to_pylist(), rows.column("fps").to_pylist(), strict=True)}
    alone = key[0].as_py() // blocks == key[0].as_py() % blocks
    return (sides[False], sides.get(True)) if alone or len(sides) == 2 else None


def link_fingerprints(fps: DataFrame, radius: int = 4, block_rows: int = BLOCK_ROWS, lanes: int = 1) -> DataFrame:
    """Distinct ``fps(fp)`` to links ``(a, b)`` whose components are those of all pairs in the radius."""
    dealt, blocks = block_pairs(fps, radius, block_rows, lanes)

    def meet(key: tuple, rows: pa.Table) -> pa.Table:
        sides = sides_of(key, rows, blocks, lanes)
        a, b = linked(*sides, radius) if sides else (np.zeros((0, lanes), np.uint64),) * 2
        return pa.table({"a": binaries(a), "b": binaries(b)})

    return dealt.groupBy("pair").applyInArrow(meet, "a binary, b binary")


def component_ids(marked: DataFrame, firsts: DataFrame, links: DataFrame) -> DataFrame:
    """``marked`` with ``component_id``; ``firsts(fp, first, copies)`` has its classes, ``links(a, b)`` are of them."""
    roots = connected_components(links)
    member = pin(firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", "copies", F.coalesce("root", "fp").alias("root")))
    least = pin(member.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("classes")))
    named = pin(join_spread(member, least, ["root"], "classes").select("fp", "copies", "component_id"))
    return join_spread(marked, named, ["fp"], "copies")


def simhash_groups(docs: DataFrame, shingle: int = 4, radius: int = 4, block_rows: int = BLOCK_ROWS, lanes: int = 1) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row for each row of ``docs(doc_id, text)``."""
    marked = pin(fingerprints(docs, shingle, lanes))
    firsts = pin(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")))
    found = component_ids(marked, firsts, link_fingerprints(firsts, radius, block_rows, lanes))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
