"""Sequence packing by minimum bin slack over the multiset of remaining lengths.

A document's ids (with the end id) are cut into full windows and one remainder.
Only the number of pieces of each length is collected, at most ``window`` counts
whatever the input. On these counts a bounded subset-sum over bitsets finds, for
the longest length left, the lengths that fill its window closest to capacity;
backtracking gives how many of each, and the pattern repeats as often as the
counts allow. A piece finds its sequence from its rank among the pieces of its
length, which per-partition counters and their prefix sums give without a sort.

Defined results: a null text counts as empty and is just its end id; repeated rows
are documents of their own; an empty table gives an empty result; other input
columns are not read. Sequences are numbered from 0.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm.common import pin
from trawl.llm.tokens import encoder

PIECES = "part int, doc_id long, start long, length int, rank long, ids_crc32 long, doc_tokens long"
TEXTS_AT_ONCE = 256


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset from ``counts`` (length to how many) whose sum is closest below or at ``room``.

    Bit s of a reach says that some choice sums to s. The lengths enter in falling
    order and the search ends as soon as the room can be filled exactly.
    """
    reach, mask, goal, steps = 1, (1 << room + 1) - 1, 1 << room, []
    for length in sorted((k for k, n in counts.items() if n and k <= room), reverse=True):
        steps.append((length, reach))
        left, copies = min(counts[length], room // length), 1
        while left:  # binary splitting of the bounded count
            take = min(copies, left)
            reach |= reach << take * length & mask
            left -= take
            copies *= 2
        if reach & goal:
            break
    total, used = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        n = 0
        while not before >> total & 1:
            total -= length
            n += 1
        if n:
            used[length] = n
    return used


def plan(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows ``(length, rank_from, rank_to, first_sequence, per_sequence, offset)`` for all pieces.

    Each pattern uses up at least one length, so the plan's size depends on the
    window, never on the number of pieces.
    """
    left, given, rows, sequence = Counter(counts), Counter(), [], 0
    while left := +left:
        longest = max(left)
        left[longest] -= 1
        used = Counter(fullest(left, window - longest)) + Counter({longest: 1})
        left[longest] += 1
        times = min(left[k] // n for k, n in used.items())
        offset = 0
        for length, n in sorted(used.items(), reverse=True):
            rows.append((length, given[length], given[length] + times * n, sequence, n, offset))
            given[length] += times * n
            left[length] -= times * n
            offset += n * length
        sequence += times
    return rows


def pieces(docs: DataFrame, tokenizer: str, end_id: int, window: int) -> DataFrame:
    """All pieces of all documents, each ranked among those of its length in its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer)
        seen: Counter[int] = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                some = batch.slice(at, TEXTS_AT_ONCE)
                ids, ends = words.batch(some.column(2), end_id)
                raw, begin, rows = memoryview(ids.astype("<u4").tobytes()), 0, []
                for part, doc, end in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), ends.tolist(), strict=True):
                    for start in range(begin, end, window):
                        n = min(window, end - start)
                        rows.append((part, doc, start - begin, n, seen[n], zlib.crc32(raw[4 * start : 4 * (start + n)]), end - begin))
                        seen[n] += 1
                    begin = end
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["part", "doc_id", "start", "length", "rank", "ids_crc32", "doc_tokens"])

    cast = lambda batches: (b.cast(pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("rank", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])) for b in run(batches))
    return docs.select(F.spark_partition_id().alias("part"), F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(cast, PIECES)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, window: int = 1024) -> DataFrame:
    """``docs(doc_id, text)`` to one row for each piece, with its sequence and offset there."""
    made = pin(pieces(docs, tokenizer, end_id, window))  # pinned: ranks stay those of one run
    held = pin(made.groupBy("length", "part").agg(F.count("*").alias("n")))
    counts = {r.length: r.n for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `window` rows
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select("length", "part", "before")
    where = docs.sparkSession.createDataFrame(plan(counts, window), "length int, rank_from long, rank_to long, first long, per long, at int")
    k = F.col("rank") - F.col("rank_from")
    return (
        made.join(starts, ["length", "part"])
        .withColumn("rank", F.col("rank") + F.col("before"))
        .join(F.broadcast(where), "length")  # its size depends on the window only
        .where("rank >= rank_from AND rank < rank_to")
        .select("doc_id", "start", F.col("length").cast("long"), "ids_crc32", "doc_tokens", (F.col("first") + F.floor(k / F.col("per"))).alias("sequence_id"), (F.col("at") + k % F.col("per") * F.col("length")).alias("offset"))
    )
