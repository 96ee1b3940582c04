"""A trie of conversations' turns: what prefixes they share, and what storing each prefix once would save.

Patricia construction. A conversation is the hashes (128 bits) of its turns, and all
conversations are sorted by them in ranges, those of equal turns by id. A task walks its
range with a stack of the points on the path: where neighbours part, where one ends, and
leaves. The turns between two points are the lower point's edge. Counts, leaves and
savings are added up at points alone; when a point closes, its edge's unary nodes follow
from it by suffix sums of the edge's sizes.

A range cuts a few nodes in two: those on the path that its first conversation shares
with the one before, and its last with the one behind. These are given out as parts,
with the hash of their prefix, and added up by it; everything else is final. So a turn or a conversation
that a third of all have is a part in each range, no key of many rows. The ids that end at a
node cut in two come as one packed part for each range, and are read in a stream.

Conversations are first rebuilt: ``c`` gets the first ``h(c)`` turns of the first one in its ``family``
and keeps its own after ``h(c)``. The hashes and sizes of one conversation (some 40 bytes a turn) are one
row; its texts never are.

Defined results: turns are ordered by number, null first, then equal ones by the hash of role and text, and a
repeated row is a further turn; null roles and texts are empty; rows without a conv_id are no
conversation and are left out; an empty table has no nodes, not even a root; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm.common import join_spread, pin, stored

FAMILY, HEADS = 5, 9
WIDE = 16
AT_ONCE = 8192
FIELDS = [
    ("key", pa.binary(), "binary"), ("part", pa.int32(), "int"), ("parent_key", pa.binary(), "binary"), ("ends", pa.binary(), "binary"), ("conv_id", pa.int64(), "long"), ("depth", pa.int64(), "long"), ("parent_conv_id", pa.int64(), "long"),
    ("n_convs", pa.int64(), "long"), ("n_children", pa.int64(), "long"), ("n_leaves", pa.int64(), "long"), ("saved_tokens", pa.int64(), "long"), ("ends_sha256", pa.string(), "string"),
]
SCHEMA = ", ".join(f"{name} {kind}" for name, _, kind in FIELDS)
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
NO_ENDS = hashlib.sha256(b"").hexdigest()


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``(conv_id, path, sizes)``: of every conversation the hashes of its rebuilt turns, joined, and the bytes of their texts."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turn = F.struct("turn", F.md5(F.concat(F.octet_length(role), F.lit(":"), role, text)).alias("hash"), F.octet_length(text).alias("size"))
    own = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    first = F.col("conv_id") - F.pmod("conv_id", F.lit(FAMILY))
    heads = own.where(first == F.col("conv_id")).select(F.col("conv_id").alias("first"), F.slice("turns", 1, HEADS - 1).alias("head"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS)).cast("int")
    head = F.coalesce("head", F.slice("turns", 1, 0))
    whole = own.withColumn("first", first).join(heads, "first", "left").select("conv_id", F.concat(F.slice(head, F.lit(1), h), F.slice("turns", h + 1, F.size("turns"))).alias("turns"))
    return whole.select("conv_id", F.unhex(F.array_join("turns.hash", "")).alias("path"), F.col("turns.size").alias("sizes"))


def in_ranges(paths: DataFrame) -> DataFrame:
    """Sorted by path and id, in ranges numbered by ``part``; pinned, so every later reader sees the same ranges."""
    parts = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pin(paths.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id").withColumn("part", F.spark_partition_id()))


def shared(a: str, b: str) -> F.Column:
    """How many leading turns two paths share; null if there aren't two."""
    n = (F.least(F.octet_length(a), F.octet_length(b)) / WIDE).cast("int")
    at = lambda c, i: F.col(c).substr(i * WIDE + 1, F.lit(WIDE))
    differs = F.array_position(F.transform(F.sequence(F.lit(0), n - 1), lambda i: at(a, i) == at(b, i)), False)
    return F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.when(n == 0, 0).when(differs == 0, n).otherwise(differs.cast("int") - 1))


def seams(ranges: DataFrame) -> dict[int, tuple[int, int]]:
    """For each range the depth to which its first path is shared with the range before, and its last with the one behind; two numbers a range."""

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for batch in batches:
            if batch.num_rows:
                first, last = first or batch.slice(0, 1), batch.slice(batch.num_rows - 1, 1)
        if first is not None:
            yield pa.RecordBatch.from_arrays([first.column(0), first.column(1), last.column(1)], ["part", "first", "last"])

    ends = ranges.select("part", "path").mapInArrow(outer, "part int, first binary, last binary")
    order = Window.orderBy("part")  # a row for each range
    both = ends.withColumns({"before": F.lag("last").over(order), "behind": F.lead("first").over(order)})
    rows = both.select("part", F.coalesce(shared("before", "first"), F.lit(0)), F.coalesce(shared("last", "behind"), F.lit(-1)))
    return {part: (left, right) for part, left, right in rows.collect()}


class Point:
    """A branch, end or leaf on the current path, with sums over the rows below it."""

    __slots__ = ("below", "children", "depth", "ends", "first", "leaves", "low", "n", "named", "waiting")

    def __init__(self, depth: int) -> None:
        self.depth, self.n, self.low, self.children, self.leaves, self.below = depth, 0, None, 0, 0, 0
        self.first, self.named = False, False  # holds the range's first row; has a child
        self.ends, self.waiting = bytearray(), []


class Walk:
    """One range's conversations in order to rows of ``SCHEMA``."""

    def __init__(self, part: int, left: int, right: int) -> None:
        self.part, self.left, self.right = part, left, right
        self.stack: list[Point] = []
        self.path, self.sizes = b"", []
        self.rows: list[tuple] = []

    def keys(self, path: bytes, depth: int) -> list[bytes]:
        """Hashes of the prefixes of ``path`` down to ``depth``."""
        h = hashlib.md5(usedforsecurity=False)
        found = [h.digest()]
        for d in range(depth):
            h.update(path[d * WIDE : (d + 1) * WIDE])
            found.append(h.digest())
        return found

    def cut(self, point: Point, depth: int, last: bool) -> bytes | None:
        """The key of the node at ``depth`` on ``point``'s edge if other ranges have parts of it."""
        if point.first and depth <= self.left:
            return self.first_keys[depth]
        return self.last_keys[depth] if last and depth <= self.right else None

    def close(self, point: Point, above: Point, last: bool = False) -> None:
        """The nodes of ``point``'s edge, lowest first; what ``above`` needs of them goes there."""
        if not point.named and not (last and point.depth <= self.right):
            point.leaves += 1
        for row in point.waiting:
            key = self.cut(point, point.depth, last)
            self.rows.append((*row[:2], key, *row[3:6], None if key else point.low, *row[7:]))
        saved, children, ends = point.below, point.children, bytes(point.ends[:-1])
        for depth in range(point.depth, above.depth, -1):
            key, behind = self.cut(point, depth, last), self.cut(point, depth - 1, last)
            new = not (point.first and depth <= self.left)
            saved += (point.n - new) * self.sizes[depth - 1]
            row = (key, self.part, behind, ends if key and point.ends and depth == point.depth else None, point.low, depth, point.low, point.n, children, point.leaves, saved, None if key else hashlib.sha256(ends).hexdigest() if ends else NO_ENDS)
            if depth > above.depth + 1 or key:
                self.rows.append(row if not behind else (*row[:6], None, *row[7:]))
            elif above.first and above.depth <= self.left:  # its key is known already
                self.rows.append((*row[:2], self.first_keys[above.depth], *row[3:6], None, *row[7:]))
            else:
                above.waiting.append(row)
            children, ends = int(new), b""
        above.n += point.n
        above.low = point.low if above.low is None else min(above.low, point.low)
        above.leaves += point.leaves
        above.below += saved
        above.first |= point.first
        above.named = True
        above.children += not (point.first and above.depth + 1 <= self.left)

    def back_to(self, depth: int) -> None:
        """Close all points under ``depth``; then there is one at ``depth``."""
        stack = self.stack
        while stack[-1].depth > depth:
            point = stack.pop()
            if stack[-1].depth < depth:
                stack.append(Point(depth))
            self.close(point, stack[-1])

    def add(self, conv: int, path: bytes, sizes: list[int]) -> None:
        stack, n = self.stack, len(sizes)
        opening = not stack
        if opening:
            stack.append(Point(0))
            stack[0].first = True
            self.first_keys = self.keys(path, self.left)
        else:
            depth, most = 0, min(n, len(self.sizes))
            if path[: most * WIDE] == self.path[: most * WIDE]:
                depth = most
            else:
                while path[depth * WIDE : (depth + 1) * WIDE] == self.path[depth * WIDE : (depth + 1) * WIDE]:
                    depth += 1
            self.back_to(depth)
        if stack[-1].depth < n:
            stack.append(Point(n))
            stack[-1].first = opening
        end = stack[-1]
        end.n += 1
        end.low = conv if end.low is None else min(end.low, conv)
        end.ends += b"%d," % conv
        self.path, self.sizes = path, sizes

    def finish(self) -> None:
        stack = self.stack
        self.last_keys = self.keys(self.path, max(self.right, 0))
        while len(stack) > 1:
            point = stack.pop()
            self.close(point, stack[-1], last=True)
        root = stack[0]
        leaf = not root.named and self.right < 0
        self.rows.append((self.first_keys[0], self.part, None, bytes(root.ends[:-1]) if root.ends else None, root.low, 0, None, root.n, root.children, root.leaves + leaf, root.below, None))

    def flushed(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t, _) in zip(zip(*rows, strict=True), FIELDS, strict=True)], [f[0] for f in FIELDS])


def nodes(ranges: DataFrame) -> DataFrame:
    """Rows of ``SCHEMA``: nodes, and (with a key) parts of nodes that several ranges have."""
    open_to = seams(ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = None
        for batch in batches:
            for part, conv, path, sizes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                walk = walk or Walk(part, *open_to[part])
                walk.add(conv, path, sizes)
                if len(walk.rows) >= AT_ONCE:
                    yield walk.flushed()
        if walk:
            walk.finish()
            yield walk.flushed()

    return ranges.select("part", "conv_id", "path", "sizes").mapInArrow(run, SCHEMA)


def streamed_ends(parts: DataFrame) -> DataFrame:
    """``(key, ends_sha256)`` from the parts ``(key, part, ends)``, ranges in order; a part is read, hashed and forgotten."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([h.hexdigest()])], ["key", "ends_sha256"])

        for batch in batches:
            for k, ends in zip(batch.column(0), batch.column(1), strict=True):
                if k.as_py() != key:
                    if h:
                        yield done()
                    key, h = k.as_py(), hashlib.sha256(ends.as_py())
                else:
                    h.update(b"," + ends.as_py())
        if h:
            yield done()

    return parts.repartition("key").sortWithinPartitions("key", "part").select("key", "ends").mapInArrow(run, "key binary, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """``conversations(conv_id, turn, role, text)`` to one row of ``RESULT`` for each node."""
    made = stored(nodes(in_ranges(rebuilt(conversations))))
    parts = made.where("key IS NOT NULL")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    whole = parts.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent_key").alias("parent_key"), *sums)
    ends = streamed_ends(parts.where("ends IS NOT NULL").select("key", "part", "ends"))
    cut = stored(whole.join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS))))
    rest = made.where("key IS NULL")
    asking = rest.where("parent_key IS NOT NULL").drop("parent_conv_id").unionByName(cut.where("parent_key IS NOT NULL").withColumns({"part": F.lit(0), "ends": F.lit(None).cast("binary")}))
    held = asking.groupBy("parent_key").agg(F.count("*").alias("held"))
    parents = pin(held.join(cut.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id")), "parent_key"))
    root = cut.where("parent_key IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return rest.where("parent_key IS NULL").select(*RESULT).unionByName(join_spread(asking, parents, ["parent_key"], "held").select(*RESULT)).unionByName(root.select(*RESULT))
