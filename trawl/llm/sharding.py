"""Resharding by minimum-cost flow: move the fewest bytes from old shards to new capacities.

Law held: ``bytes`` (shard sizes near equal). Rows lie in old shards; each old
shard is cut into blocks, only block sizes are summed, and the flow between old
and new shards is solved on those few totals. A byte that stays costs nothing and
a moved byte costs one. The solved flows become intervals of each old shard's
byte sequence; a row goes where its first byte falls, so a shard misses its
capacity by a few rows at most. Block prefix sums place rows without sorting any
shard whole.

Equal texts are not kept together: the law is on sizes, and one group of copies may
exceed a shard. ``rewrite`` then writes the files of the shards that change; a row key tells
repeated and null ids apart. Defined results: a null text has size 1 (no bytes plus one) and
text_crc32 0, like an empty one; repeated rows are placed one by one; an empty table gives an empty
result; other input columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm.common import broadcast_if, pin

BLOCK_ROWS = 16384
#: Moved rows (24 bytes each) that may be broadcast.
BROADCAST_ROWS = 1_000_000


def fewest_bytes(old: Sequence[int], capacity: Sequence[int]) -> dict[tuple[int, int], int]:
    """Minimum-cost flow from old shards to new capacities; cost one per byte that changes shard.

    Successive shortest paths with potentials over the small bipartite graph
    (source, old shards, new shards, sink). ``sum(old) <= sum(capacity)``.
    """
    n, m = len(old), len(capacity)
    source, sink = n + m, n + m + 1
    arcs: list[list[int]] = []  # head, capacity left, cost; arc k ^ 1 is the reverse of arc k
    out: list[list[int]] = [[] for _ in range(n + m + 2)]

    def arc(a: int, b: int, room: int, cost: int) -> None:
        for tail, head, left, price in ((a, b, room, cost), (b, a, 0, -cost)):
            out[tail].append(len(arcs))
            arcs.append([head, left, price])

    total = sum(old)
    for i, have in enumerate(old):
        arc(source, i, have, 0)
        for j in range(m):
            arc(i, n + j, total, int(i != j))
    for j, room in enumerate(capacity):
        arc(n + j, sink, room, 0)
    potential = [0] * len(out)
    while True:
        far, by, heap = {source: 0}, {}, [(0, source)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for k in out[a]:
                b, left, price = arcs[k]
                step = d + price + potential[a] - potential[b]
                if left and step < far.get(b, step + 1):
                    far[b], by[b] = step, k
                    heapq.heappush(heap, (step, b))
        if sink not in far:
            break
        for a in range(len(out)):
            potential[a] += min(far.get(a, far[sink]), far[sink])
        path, a = [], sink
        while a != source:
            path.append(by[a])
            a = arcs[by[a] ^ 1][0]
        pushed = min(arcs[k][1] for k in path)
        for k in path:
            arcs[k][1] -= pushed
            arcs[k ^ 1][1] += pushed
    return {(i, arcs[k][0] - n): arcs[k ^ 1][1] for i in range(n) for k in out[i] if n <= arcs[k][0] < n + m and arcs[k ^ 1][1]}


def spans(flows: dict[tuple[int, int], int]) -> list[tuple[int, int, int, int]]:
    """Flows as ``(old, begin, end, new)`` intervals of each old shard's bytes; what stays comes first."""
    made = []
    for i in sorted({i for i, _ in flows}):
        at = 0
        for j in sorted((j for k, j in flows if k == i), key=lambda j: (j != i, j)):
            made.append((i, at, at + flows[i, j], j))
            at += flows[i, j]
    return made


def running(parts: DataFrame, group: Sequence[str], value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over the earlier blocks of the group; ``parts`` has a row for each block."""
    before = Window.partitionBy(*group).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn(name, F.coalesce(F.sum(value).over(before), F.lit(0)))


def sized_rows(rows: DataFrame, *others: str | Column) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return rows.select(*others, F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))


def numbered(files: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``files(row_key, shard, doc_id, text)`` to ``(doc_id, size, text_crc32, shard, slot)``, slots counting each shard's rows."""
    sized = pin(sized_rows(files, "row_key", "shard"))
    blocks = max(1, -(-sized.count() // block_rows))
    sized = sized.withColumn("block", F.pmod(F.xxhash64("doc_id", "row_key"), F.lit(blocks)))
    slots = running(sized.groupBy("shard", "block").count(), ["shard"], "count", "first").select("shard", "block", "first")
    rank = F.row_number().over(Window.partitionBy("shard", "block").orderBy("size", "text_crc32", "doc_id", "row_key")) - 1
    return sized.withColumn("rank", rank).join(slots, ["shard", "block"]).select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("rank")).alias("slot"))


def reshard(rows: DataFrame, old_shard: Column, shards: int = 16, block_rows: int = BLOCK_ROWS, capacity: Sequence[int] | None = None, key: str | None = None) -> DataFrame:
    """``rows(doc_id, text)`` to ``(doc_id, size, text_crc32, old_shard, shard, slot)``.

    ``key`` names a column that tells all rows apart; it is added to the result.

    ``capacity`` gives each new shard's bytes (in all at least the rows' bytes);
    without it all get an equal share.
    """
    keys = [key] if key else []
    sized = sized_rows(rows, *keys, old_shard.cast("int").alias("old_shard"))
    sized = pin(sized)
    n = sized.count()
    blocks = max(1, -(-n // block_rows))
    sized = sized.withColumn("block", F.pmod(F.xxhash64("doc_id", *keys), F.lit(blocks)))
    parts = pin(sized.groupBy("old_shard", "block").agg(F.sum("size").alias("bytes")))
    have = {r.old_shard: r.bytes for r in parts.groupBy("old_shard").agg(F.sum("bytes").alias("bytes")).collect()}  # a row for each old shard
    total = sum(have.values())
    old = [have.get(i, 0) for i in range(max([shards - 1, *have]) + 1)]
    flows = fewest_bytes(old, capacity or [total // shards + (j < total % shards) for j in range(shards)])
    plan = sized.sparkSession.createDataFrame(spans(flows), "old_shard int, begin long, end long, shard int")
    order = ["size", "text_crc32", "doc_id", *keys]
    inside = Window.partitionBy("old_shard", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    starts = running(parts, ["old_shard"], "bytes", "start").select("old_shard", "block", "start")
    placed = (
        sized.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(starts, ["old_shard", "block"])
        .withColumn("at", F.col("start") + F.col("inner"))
        .join(F.broadcast(plan), "old_shard")  # at most old shards x new shards rows
        .where("at >= begin AND at < end")
    )
    placed = pin(placed.select(*keys, "doc_id", "size", "text_crc32", "old_shard", "shard", "block"))
    slots = running(placed.groupBy("shard", "block").count(), ["shard"], "count", "first").select("shard", "block", "first")
    rank = F.row_number().over(Window.partitionBy("shard", "block").orderBy(*order)) - 1
    return placed.withColumn("rank", rank).join(slots, ["shard", "block"]).select(*keys, "doc_id", "size", "text_crc32", "old_shard", "shard", (F.col("first") + F.col("rank")).alias("slot"))


def rewrite(old_path: str, moves: DataFrame, new_path: str, columns: Sequence[str], key: str = "doc_id") -> list[int]:
    """Write the rows of a dataset partitioned by ``shard`` anew, where ``moves`` says they changed shard.

    ``moves(key, old_shard, shard)``; with repeated or null ids ``key`` has to be a row key. Old
    shards that lose no row are not read; their files stay as they are. Shards that lose rows are rewritten
    without them, and moved rows are written once, into ``new_path`` under their
    new shard. Returns the shards that lose rows: their old files are void.
    """
    spark = moves.sparkSession
    gone = broadcast_if(pin(moves.where("shard <> old_shard").select(key, "old_shard", "shard")), BROADCAST_ROWS)
    touched = [r.old_shard for r in gone.select("old_shard").distinct().collect()]  # shard numbers only
    held = spark.read.parquet(old_path).where(F.col("shard").isin(touched)).withColumnRenamed("shard", "old_shard")
    left = held.join(gone, [key, "old_shard"], "left").withColumn("shard", F.coalesce("shard", "old_shard"))
    left.select(*columns, "shard").write.mode("overwrite").partitionBy("shard").parquet(new_path)
    return touched


def resharded_files(docs: DataFrame, old_shard: Column, folder: str, shards: int = 16) -> DataFrame:
    """Write ``docs(doc_id, text, ...)`` as old shards, rewrite the affected files, and read ``(row_key, shard, doc_id, text)`` back from the files."""
    spark, old_path, new_path = docs.sparkSession, f"{folder}/old", f"{folder}/new"
    other = [c for c in docs.columns if c not in ("shard", "row_key")]
    written = docs.select(*other, F.monotonically_increasing_id().alias("row_key"), old_shard.cast("int").alias("shard"))
    written.write.partitionBy("shard").parquet(old_path)
    kept = spark.read.schema(written.schema).parquet(old_path)
    columns = ["row_key", "shard", F.col("doc_id").cast("long"), F.col("text").cast("string")]
    if kept.isEmpty():
        return kept.select(*columns)
    moves = pin(reshard(kept, F.col("shard"), shards, key="row_key").select("row_key", "old_shard", "shard"))
    touched = rewrite(old_path, moves, new_path, [*other, "row_key"], "row_key")
    files = kept.where(~F.col("shard").isin(touched)).select(*columns)
    return files.unionByName(spark.read.parquet(new_path).select(*columns)) if touched else files
