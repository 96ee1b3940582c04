"""Line dedup with DataFrame functions only: exact lines, then a deletion-neighbourhood join.

The unit of an edit is a word: two lines are near if one insertion, deletion or
substitution of a word makes them equal and both have ``min_words`` or more words
(one edit in eight words keeps them over 0.8 alike); shorter lines match
exactly. A line is dropped if an earlier line (by doc_id, then position) is equal
or near; the earliest always stays. Lines are compared trimmed, with inner white
space as one space.

Equal lines meet by a 128-bit hash in a partial aggregation, so a line that fills
a third of all rows costs one row per task. A near line shares its first or last
words with its partner, and all but one of ``CUTS`` sections; only distinct lines that share
such a half, then such sections, with another distinct line emit variants. Each of them emits every one-word deletion and itself
as hashed keys, a rolling exclusive-or of position-bound word hashes, so
a line of n words costs n rows however long it is. Equal variants meet their earliest
holder, never each other, and the words decide.

Defined results: null texts stay null; blank lines stay; rows with equal doc_id and text are one document
and get the same result; a null doc_id sorts first; an empty table gives an empty result. Other columns pass
through, but names beginning with ``_ld_`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm.common import broadcast_if, stored

MIN_WORDS = 8
#: Sections of a line; an edit lies in one of them and leaves the words before and after it.
CUTS = 8
#: Documents with candidate lines (some 64 bytes each) and their places (4 bytes each) that may be broadcast to fetch the words.
BROADCAST_ROWS, BROADCAST_PLACES = 1_000_000, 4_000_000


def words(line: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")


def half_keys(w: Column, n: Column, k: Column) -> list[Column]:
    """Hashes of the first and the last ``k`` of ``n`` words."""
    return [F.xxhash64(F.lit(side), k, F.slice(w, at, k)) for side, at in (("first", F.lit(1)), ("last", n - k + 1))]


def marked_lines(docs: DataFrame, min_words: int) -> DataFrame:
    """A row for each line that isn't blank: where it is, its hash, and its half keys.

    A half is the largest power of two of words that fits twice. Lines of 2^j
    words also carry the smaller half that lines of one word less have.
    """
    lines = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"), F.posexplode(F.split("text", "\n")).alias("p", "line"))
    w = words(F.col("line"))
    n = F.size(w)
    k = F.pow(F.lit(2), F.floor(F.log2(n / 2.0 + 1e-9))).cast("int")
    low, power = F.greatest(F.lit(1), F.shiftright(k, 1)), k * 2 == n
    near = n >= min_words
    keys = [F.when(near, x) for x in half_keys(w, n, k)] + [F.when(near & power, x) for x in half_keys(w, n, low)]
    return lines.where(~F.col("line").rlike(r"^\s*$")).select("d", "t", "p", F.xxhash64(w).alias("h1"), F.xxhash64(F.lit(7), w).alias("h2"), *(x.alias(f"k{i}") for i, x in enumerate(keys)))


def section_keys(w: Column, n: Column) -> Column:
    """For the shorter of a pair having n or n - 1 words: hashes of what stands around each section."""

    def around(m: Column) -> Column:
        def key(j: Column) -> Column:
            before, after = F.floor(j * m / CUTS).cast("int"), m - F.floor((j + 1) * m / CUTS).cast("int")
            return F.xxhash64(m, j, F.slice(w, F.lit(1), before), F.slice(w, n - after + 1, after))

        return F.transform(F.sequence(F.lit(0), F.lit(CUTS - 1)), key)

    return F.concat(around(n), around(n - 1))


def lead(*names: str) -> Column:
    return F.struct(*names)


def near_lines(first: DataFrame, docs: DataFrame, min_words: int) -> DataFrame:
    """Of the distinct lines in ``first``, the places ``(d, t, p)`` of those near an earlier one."""
    keys = first.select("d", "t", "p", F.explode(F.array("k0", "k1", "k2", "k3")).alias("key")).where("key IS NOT NULL")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    asked = stored(keys.join(shared, "key").groupBy(F.col("d").alias("ad"), F.col("t").alias("at")).agg(F.collect_set("p").alias("places")))
    places = asked.agg(F.sum(F.size("places"))).first()[0] or 0  # arrays: their lengths count too
    wanted = broadcast_if(asked, BROADCAST_ROWS) if places <= BROADCAST_PLACES else asked
    text = docs.select("doc_id", F.xxhash64("text").alias("t"), F.split("text", "\n").alias("lines")).join(wanted, F.col("doc_id").eqNullSafe(F.col("ad")) & (F.col("t") == F.col("at")))
    spots = F.transform("places", lambda p: F.struct(p.alias("p"), F.col("lines")[p].alias("line")))  # each place with its own line, not with all
    found = text.select(F.col("doc_id").alias("d"), "t", F.explode(spots).alias("s")).select("d", "t", "s.p", words(F.col("s.line")).alias("w")).dropDuplicates(["d", "t", "p"])
    found = stored(found.select(lead("d", "t", "p").alias("at"), "w", F.size("w").alias("n"), F.monotonically_increasing_id().alias("k")))
    around = found.select("k", F.explode(section_keys(F.col("w"), F.col("n"))).alias("key"))  # a line's keys differ: they hold its section
    close = around.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1").select("key")
    found = found.join(around.join(close, "key").select("k").distinct(), "k").select("at", "w", "n")
    held = stored(found.orderBy("at").withColumn("id", F.monotonically_increasing_id()))  # ids in the order of places
    bound = held.select("id", "n", F.posexplode("w").alias("i", "word")).select("id", "n", "i", F.xxhash64("word", "i").alias("here"), F.xxhash64("word", F.col("i") - 1).alias("moved"))
    line = Window.partitionBy("id").orderBy("i")
    zero = F.lit(0).cast("long")
    before = F.coalesce(F.bit_xor("here").over(line.rowsBetween(Window.unboundedPreceding, -1)), zero)
    after = F.coalesce(F.bit_xor("moved").over(line.rowsBetween(1, Window.unboundedFollowing)), zero)
    changed, longer, shorter = range(3)

    def variant(role: int, n: Column, i: Column, key: Column) -> Column:
        """Who emits it in which role, the words and position it is bound to, and its hash."""
        spot = F.shiftleft(n.cast("long"), 32) + i + 1
        return F.struct((F.shiftleft("id", 2) + role).alias("who"), spot.alias("spot"), key.alias("key"))

    n, i, nowhere = F.col("n"), F.col("i"), F.lit(-1)
    without = F.array(variant(changed, n, i, F.col("less")), variant(longer, n - 1, nowhere, F.col("less")))
    whole = F.array(variant(shorter, n, nowhere, F.col("before").bitwiseXOR(F.col("here"))))
    walked = bound.select("id", "n", "i", "here", before.alias("before"), after.alias("after")).withColumn("less", F.col("before").bitwiseXOR(F.col("after")))
    variants = stored(walked.select(F.explode(F.when(i == n - 1, F.concat(without, whole)).otherwise(without)).alias("v")).select("v.*"))
    bucket = ["spot", "key"]
    role, ident = F.col("who").bitwiseAND(F.lit(3).cast("long")), F.shiftright("who", 2)
    named = [(changed, "changed"), (longer, "longer"), (shorter, "shorter")]
    leads = variants.groupBy(*bucket).agg(F.count("*").alias("rows"), *(F.min(F.when(role == r, ident)).alias(name) for r, name in named)).where("rows > 1").drop("rows")
    other = F.when(role == changed, F.col("changed")).when(role == longer, F.col("shorter")).otherwise(F.col("longer"))
    pairs = variants.join(leads, bucket).select(ident.alias("id"), other.alias("earlier")).where("earlier < id").distinct()
    a, b = held.select("id", "at", F.col("w").alias("a")), held.select(F.col("id").alias("earlier"), F.col("w").alias("b"))
    least = F.least(F.size("a"), F.size("b"))

    def agree(x: Column, y: Column) -> Column:
        differs = F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), False)
        return F.when(differs == 0, least).otherwise(differs - 1)

    edits_fit = agree(F.col("a"), F.col("b")) + agree(F.reverse("a"), F.reverse("b")) >= F.greatest(F.size("a"), F.size("b")) - 1
    sized = (F.size("a") >= min_words) & (F.size("b") >= min_words)
    return pairs.join(a, "id").join(b, "earlier").where(edits_fit & sized).select("at.*").distinct()


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with ``text`` less its repeated lines, plus ``n_lines`` and ``n_kept``."""
    marked = marked_lines(docs, min_words)
    first = stored(marked.groupBy("h1", "h2").agg(F.min(lead("d", "t", "p")).alias("at"), *(F.min(f"k{i}").alias(f"k{i}") for i in range(4))).select("at.*", "k0", "k1", "k2", "k3"))
    near = near_lines(first, docs, min_words)
    place = ["d", "t", "p"]
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in place]
    kept = first.select(*place).alias("x").join(near.alias("y"), same[0] & same[1] & same[2], "left_anti")
    kept = kept.groupBy(F.col("d").alias("_ld_d"), F.col("t").alias("_ld_t")).agg(F.collect_list("p").alias("_ld_p"))
    lines = docs.withColumn("_ld_h", F.xxhash64("text")).withColumn("_ld_lines", F.split("text", "\n")).drop("text")
    joined = lines.join(kept, F.col("doc_id").eqNullSafe(F.col("_ld_d")) & (F.col("_ld_h") == F.col("_ld_t")), "left")
    blank = F.filter(F.transform("_ld_lines", lambda x, i: F.when(x.rlike(r"^\s*$"), i)), lambda i: i.isNotNull())
    places = F.array_sort(F.concat(F.coalesce("_ld_p", F.array().cast("array<int>")), blank))
    done = joined.withColumn("_ld_kept", F.transform(places, lambda i: F.col("_ld_lines")[i]))
    names = [F.array_join("_ld_kept", "\n").alias("text") if c == "text" else F.col(c) for c in docs.columns]
    clash = {"n_lines", "n_kept"}
    return done.select(*(x for x, c in zip(names, docs.columns, strict=True) if c not in clash), F.coalesce(F.size("_ld_lines"), F.lit(0)).alias("n_lines"), F.coalesce(F.size("_ld_kept"), F.lit(0)).alias("n_kept"))
