"""Personal data in whole texts, and words nearby that give it away, with DataFrame functions only.

Base kinds are patterns with a check (``KINDS``). Their values are the protected entities.
Information-theoretic sanitisation then asks the corpus how much a word tells about an
entity. A mention's context is the ``AROUND`` words on either side of it, up to the next
mention of its kind. With ``n`` counted over the corpus in different texts (and for
words beside an entity in different contexts, so copies of a passage are one witness),

    tells(word, entity) = log(n(word, entity) N / (n(word) n(entity))) / log(N / n(entity))

is the pointwise mutual information as a part of the entity's information: 1 if the word
stands with that entity alone, 0 if it is independent. A word that was seen in ``SUPPORT`` contexts and
tells ``THRESHOLD`` or more is generalised to its first ``STEM`` letters, if they, counted the same way
over all words that begin so, tell less; else it is removed. Both concern the word wherever it stands in a text that
mentions the entity: contexts are what is learnt from, and whole texts are what is searched.

Patterns are tried only on texts that hold a digit or an at sign. They are written so that no
match is tried twice in a run: possessive runs, entered only at their start or where the last match
ended, find the same matches as the plain ones in linear time and without deep recursion.
Words of the corpus meet only the candidate words, which were
seen often enough beside one entity; entities and words of a third of all rows are summed before they are shuffled.

Defined results: null and empty texts have no spans; repeated rows each have their own result and are one witness;
null ids stay; ties of a start go by kind as listed; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm.common import broadcast_if, join_spread, pin, stored

AROUND, SUPPORT, THRESHOLD, STEM, LEAST = 8, 3, 0.9, 3, 3
#: Candidate words (one string of some 20 bytes each) that may be broadcast to the corpus's words.
BROADCAST_WORDS = 200_000
#: Rows with their words (some 50 bytes a word, a few words each) that may be broadcast to the texts.
BROADCAST_ROWS = 100_000
ADDED = ("general", "removed")
LOCAL = "[A-Za-z0-9._%+-]"
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
WORD = r"^[^\p{L}\p{N}@+]*\p{L}{%d,}[^\p{L}\p{N}@+]*$" % LEAST


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Every second digit from the right doubled, their digit sums add up to a multiple of ten."""
    figure = F.transform(F.split(F.reverse(number), ""), lambda c, i: c.cast("int") * (1 + i % 2))
    return F.aggregate(figure, F.lit(0), lambda a, x: a + x - F.when(x > 9, 9).otherwise(0)) % 10 == 0


def card(match: Column) -> Column:
    n = digits(match)
    return F.length(n).between(12, 19) & F.when(F.length(n).between(12, 19), luhn(n)).otherwise(False)


#: Kind: what a text must hold, its pattern, the check, and the value by which mentions are one entity.
KINDS = {
    "email": ("@", rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda m: F.lit(True), F.lower),
    "ip": (".", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda m: m.rlike(rf"^(?:{BYTE}\.){{3}}{BYTE}$"), lambda m: m),
    "card": ("", r"[0-9](?:[ -]?[0-9])++", card, digits),
    "phone": ("+", r"\+[0-9][ ().0-9-]+[0-9]", lambda m: F.length(digits(m)).between(9, 15), digits),
}
NAMES = [*KINDS, *ADDED]


def matches(text: Column, number: int) -> Column:
    """Of one kind: every match's text between it and the one before, its length, and if it passes its value and the words around."""
    needs, pattern, passes, value = KINDS[NAMES[number]]
    between = F.split(text, pattern, -1)
    rows = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"), between.alias("left"), F.slice(between, 2, 1 << 30).alias("right"))

    def row(z: Column, i: Column) -> Column:
        tokens = lambda piece: F.regexp_extract_all(piece, F.lit(r"\S+|\s+"), F.lit(0))
        last = lambda t: F.reverse(F.slice(F.reverse(t), 1, 2 * AROUND))
        good = passes(z["match"])
        return F.struct(
            F.lit(number).alias("kind"), i.alias("i"), F.length(z["left"]).alias("gap"), F.length(z["match"]).alias("n"), F.when(good, value(z["match"])).alias("value"),
            F.when(good, last(tokens(z["left"]))).alias("left"), F.when(good, F.slice(tokens(z["right"]), 1, 2 * AROUND)).alias("right"),
        )

    found = F.transform(F.filter(rows, lambda z: z["match"].isNotNull()), row)
    return F.when(text.contains(needs), found) if needs else found


def scanned(docs: DataFrame) -> DataFrame:
    """``(row, doc_id, mark, there, text, found)``: a row for each document; equal texts have equal marks, texts without a mention are left out."""
    text = F.col("text").cast("string")
    kinds = [F.coalesce(matches(F.col("text"), k), F.array()) for k in range(len(KINDS))]
    found = F.when(F.col("text").rlike("[0-9@]"), F.concat(*kinds))
    told = docs.select("doc_id", text.alias("text")).select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("mark"), F.col("text").isNotNull().alias("there"), "text", found.alias("found"))
    holds = F.exists("found", lambda f: f["value"].isNotNull())
    return stored(told.withColumn("text", F.when(holds, F.col("text"))))


def mentions(scan: DataFrame) -> DataFrame:
    """``(row, mark, kind, value, start, end, left, right)``: base spans in code points, with the words and gaps around."""
    one = scan.select("row", "mark", F.explode("found").alias("f")).select("row", "mark", "f.*").repartition("row")
    order = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("n")).over(order)
    return one.withColumn("end", end).where("value IS NOT NULL").select("row", "mark", "kind", "value", (F.col("end") - F.col("n")).alias("start"), "end", "left", "right")


def context_words(spans: DataFrame) -> DataFrame:
    """``(row, mark, kind, value, context, term, s, e)``: the words of letters alone around each mention, where they are."""

    def place(side: str, base: Column, sign: int) -> Column:
        def size(part: Column) -> Column:
            return F.aggregate(part, F.lit(0).cast("long"), lambda a, t: a + F.length(t))

        def at(t: Column, k: Column) -> Column:
            start = base + size(F.slice(F.col(side), F.lit(1), k)) if sign > 0 else base - size(F.slice(F.col(side), k + 1, F.size(F.col(side))))
            return F.struct(t.alias("t"), start.alias("at"))

        return F.transform(F.col(side), at)

    around = F.concat(place("left", F.col("start"), -1), place("right", F.col("end"), 1))
    words = spans.select("row", "mark", "kind", "value", F.xxhash64("left", "right").alias("context"), F.explode(around).alias("w")).where(F.col("w.t").rlike(WORD))
    core = F.regexp_extract(F.col("w.t"), r"\p{L}+", 0)
    start = F.col("w.at") + F.length(F.regexp_extract(F.col("w.t"), r"^[^\p{L}]*", 0))
    return words.select("row", "mark", "kind", "value", "context", F.lower(core).alias("term"), start.alias("s"), (start + F.length(core)).alias("e"))


def stem(word: Column) -> Column:
    """What a word is generalised to."""
    return F.concat(F.substring(word, 1, STEM), F.lit("*"))


def corpus_counts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(term, n_term)``: in how many different texts the wanted words and stems are, over all documents."""
    words = F.filter(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+")), lambda w: F.length(w) >= LEAST)
    held = docs.select(F.xxhash64("text").alias("mark"), F.col("text")).select("mark", words.alias("words"))
    wanted = pin(wanted)
    terms = held.select("mark", F.explode(F.concat("words", F.array_distinct(F.transform("words", stem)))).alias("term"))
    return terms.join(broadcast_if(wanted, BROADCAST_WORDS), "term", "left_semi").distinct().groupBy("term").agg(F.count("*").alias("n_term"))


def told(docs: DataFrame, scan: DataFrame, spans: DataFrame, words: DataFrame) -> DataFrame:
    """``(kind, value, term, how, held)``: words that tell too much of an entity, what becomes of them, and how often they stand beside it.

    The different texts in whose contexts a word stands, beside whatever entity, are some of those that hold it. A word that tells too
    little even if these were all needn't be counted in the corpus; so ordinary words never meet it.
    """
    entity = ["kind", "value"]
    both = words.select(*entity, "context", "mark", F.explode(F.array("term", stem(F.col("term")))).alias("term"))
    beside = both.groupBy(*entity, "term").agg(F.count_distinct("context").alias("n_both"), F.count("*").alias("held")).where(F.col("n_both") >= SUPPORT)
    texts = float(scan.where("there").agg(F.count_distinct("mark")).first()[0])
    entities = spans.groupBy(*entity).agg(F.count_distinct("mark").alias("n_entity"))
    least = both.groupBy("term").agg(F.count_distinct("mark").alias("n_least"))

    def tells(n_term: str) -> Column:
        n_both = F.least("n_both", n_term, "n_entity")
        information = F.log(F.lit(texts) / F.col("n_entity"))
        return F.log(n_both * texts / (F.col(n_term).cast("double") * F.col("n_entity"))) / F.when(information > 0, information)

    likely = pin(beside.join(entities, entity).join(least, "term").where(tells("n_least") >= THRESHOLD))
    counts = corpus_counts(docs.select(F.col("text").cast("string")).where("text IS NOT NULL"), likely.select("term").distinct())
    much = pin(likely.join(counts, "term").where(tells("n_term") >= THRESHOLD).select(*entity, "term", "held"))
    stems = much.where(F.col("term").endswith("*")).select(*entity, F.col("term").alias("stem"), F.lit(1).alias("told"))
    words_told = much.where(~F.col("term").endswith("*")).withColumn("stem", stem(F.col("term")))
    return words_told.join(stems, [*entity, "stem"], "left").select(*entity, "term", F.when(F.col("told").isNull(), NAMES.index("general")).otherwise(NAMES.index("removed")).alias("how"), "held")


def placed(scan: DataFrame, spans: DataFrame, much: DataFrame) -> DataFrame:
    """``(row, s, e, how)``: everywhere in its whole text the words that tell too much of an entity mentioned there."""
    lists = pin(much.groupBy("kind", "value").agg(F.collect_list(F.struct("term", "how")).alias("terms"), F.sum("held").alias("held")))
    mentioned = join_spread(spans.select("row", "kind", "value").distinct(), lists, ["kind", "value"], "held")
    asked = pin(mentioned.groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms")))
    rows = scan.select("row", "text").join(broadcast_if(asked, BROADCAST_ROWS), "row")
    tokens = rows.select("row", "terms", F.regexp_extract_all("text", F.lit(r"\S+|\s+"), F.lit(0)).alias("tokens"))
    core = lambda t: F.regexp_extract(t, r"\p{L}+", 0)
    term = lambda t: F.when(t.rlike(WORD), F.lower(core(t)))
    known = tokens.withColumn("words", F.transform("terms", lambda x: x["term"]))
    hits = F.filter(F.transform("tokens", lambda t, i: F.when(F.array_contains("words", term(t)), F.struct(t.alias("t"), i.alias("i")))), lambda x: x.isNotNull())
    before = lambda x: F.length(F.array_join(F.slice("tokens", F.lit(1), x["i"]), "")) + F.length(F.regexp_extract(x["t"], r"^[^\p{L}]*", 0))
    how = lambda x: F.array_max(F.transform(F.filter("terms", lambda m: m["term"] == term(x["t"])), lambda m: m["how"]))
    at = known.select("row", F.explode(F.transform(hits, lambda x: F.struct(before(x).cast("long").alias("s"), F.length(core(x["t"])).alias("n"), how(x).alias("how")))).alias("w"))
    return at.select("row", "w.s", (F.col("w.s") + F.col("w.n")).alias("e"), "w.how")


def spans_of(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``scan`` and ``(row, kind, start, end)``: all spans of all documents, kinds as numbers in ``NAMES``."""
    scan = scanned(docs)
    spans = stored(mentions(scan))
    words = stored(context_words(spans))
    much = pin(told(docs, scan, spans, words))
    near = join_spread(words, much, ["kind", "value", "term"], "held").select("row", "s", "e", "how")  # also words that stand against a value without a blank
    added = near.unionByName(placed(scan, spans, much)).groupBy("row", "s", "e").agg(F.max("how").alias("kind"))
    return scan, spans.select("row", "kind", "start", "end").unionByName(added.select("row", "kind", F.col("s").alias("start"), F.col("e").alias("end")))


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, NAMES))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)``."""
    scan, spans = spans_of(docs)
    held = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("all"))
    every = scan.select("row", "doc_id").join(held, "row", "left").withColumn("all", F.coalesce("all", F.array()))
    base = F.filter("all", lambda s: s["kind"] < len(KINDS))

    def count(k: int) -> Column:
        return F.size(F.filter("all", lambda s: s["kind"] == k)).cast("long")

    return every.select("doc_id", *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("all")).alias("spans"))


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with every base span in ``text`` as its kind in brackets, generalised words as their stem, removed ones as dots.

    Spans that overlap are one, named by the first. Rows of equal doc_id and text are as one.
    """
    scan, spans = spans_of(docs)
    keys = scan.select("row", F.col("doc_id").alias("_s_id"), F.col("mark").alias("_s_mark"))
    order = Window.partitionBy("row").orderBy("start", "kind")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") < F.col("reach"), 0).otherwise(1)).over(order)
    covers = spans.withColumn("reach", reach).withColumn("island", island).groupBy("row", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "kind")).alias("kind"))
    lists = covers.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("_s_spans"))
    wanted = keys.join(lists, "row").dropDuplicates(["_s_id", "_s_mark"]).drop("row")
    joined = docs.withColumn("_s_own", F.xxhash64(F.col("text").cast("string"))).join(wanted, F.col("doc_id").eqNullSafe(F.col("_s_id")) & (F.col("_s_own") == F.col("_s_mark")), "left")
    text, names = F.col("text").cast("string"), F.array(*map(F.lit, NAMES))
    said = lambda s: F.when(s["kind"] < len(KINDS), F.concat(F.lit("["), names[s["kind"]], F.lit("]"))).when(s["kind"] == NAMES.index("removed"), F.lit("...")).otherwise(stem(text.substr(s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int"))))
    before = lambda i: F.when(i > 0, F.col("_s_spans")[F.greatest(i - 1, F.lit(0))]["end"]).otherwise(0)
    parts = F.transform("_s_spans", lambda s, i: F.concat(text.substr(before(i).cast("int") + 1, (s["start"] - before(i)).cast("int")), said(s)))
    tail = text.substr(F.element_at("_s_spans", -1)["end"].cast("int") + 1, F.length(text))
    done = F.when(F.col("_s_spans").isNull(), text).otherwise(F.concat(F.array_join(parts, ""), tail))
    return joined.select(*(done.alias(c) if c == "text" else F.col(c) for c in docs.columns))
