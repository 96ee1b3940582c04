"""Closed-loop data flow: what was read, and whether the same bytes were sent later."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.functions import rules
from trawl.functions.text import any_hit, decode_layers, hit, may_hit, redact
from trawl.operators.numbering import first_rows
from trawl.session import written_once


def path_categories(path: Column) -> Column:
    return F.filter(F.array(*(F.when(hit(path, s.path), F.lit(s.category)) for s in rules.SECRETS if s.path)), lambda c: c.isNotNull())


#: Rules that plain prose often meets have a scan of their own; the others are told by one scan for them all.
PLAIN = ["seed_phrase"]


def may_hold_secrets(text: Column) -> Column:
    """Can any content rule but those of ``PLAIN`` match?"""
    return any_hit(text, [s.content for s in rules.SECRETS if s.content and s.category not in PLAIN])


def may_hold_plain(text: Column) -> Column:
    """Can a content rule of ``PLAIN`` match?"""
    return any_hit(text, [s.content for s in rules.SECRETS if s.content and s.category in PLAIN])


def content_secrets(text: Column, likely: Column | None = None, plain: Column | None = None) -> Column:
    """``array<struct(category, severity, raw)>``: the first match of each content rule, in rule order; ``likely`` and ``plain`` are ``may_hold_secrets`` and ``may_hold_plain`` of the text or of more, as columns."""
    low = F.lower(text)

    def one(s: rules.Secret) -> Column:
        raw = F.regexp_extract(text, rules.ascii_bounds(f"({s.content})"), 1)  # no rule matches an empty text
        scanned = plain if s.category in PLAIN else likely
        tried = ([] if scanned is None else [scanned]) + ([may_hit(low, s.content)] if rules.needed(s.content) else [])
        for condition in reversed(tried):
            raw = F.when(condition, raw).otherwise(F.lit(""))
        return F.struct(F.lit(s.category).alias("category"), F.lit(s.severity).alias("severity"), raw.alias("raw"))

    return F.filter(F.array(*(one(s) for s in rules.SECRETS if s.content)), lambda x: x["raw"] != "")


def classify(rows: DataFrame, text: str) -> DataFrame:
    """A row for each secret a text holds, the secret itself masked."""
    found = rows.select("*", may_hold_secrets(F.col(text)).alias("_likely")).select("*", F.explode(content_secrets(F.col(text), F.col("_likely"))).alias("s"))
    return found.select(*(c for c in rows.columns if c != text), "s.category", "s.severity", redact(F.col("s.raw")).alias("evidence"))


def sensitive_reads(reads: DataFrame) -> DataFrame:
    """``reads(sample_key, seq, path, content)`` that any rule names, with categories, worst severity and quiet flag."""
    categories = F.array_distinct(F.concat(path_categories(F.col("path")), F.coalesce(F.transform("secrets", lambda s: s["category"]), F.array())))
    critical = F.array(*(F.lit(s.category) for s in rules.SECRETS if s.severity == "CRITICAL"))
    quiet = F.array(*(F.lit(s.category) for s in rules.SECRETS if s.quiet))
    scanned = reads.withColumns({"_likely": may_hold_secrets(F.col("content")), "_plain": may_hold_plain(F.col("content"))})
    secrets = content_secrets(F.col("content"), F.col("_likely"), F.col("_plain"))
    told = scanned.withColumn("_told", F.explode_outer(F.array(secrets))).drop("_likely", "_plain").withColumn("secrets", F.coalesce("_told", F.array().cast("array<struct<category:string,severity:string,raw:string>>"))).drop("_told")
    found = told.withColumn("categories", categories).where(F.size("categories") > 0)  # after the explode, so no filter evaluates the rules again
    return found.withColumns({"severity": F.when(F.arrays_overlap("categories", critical), "CRITICAL").otherwise("WARN"), "quiet": F.size(F.array_except("categories", quiet)) == 0})


def read_tokens(reads: DataFrame, harness: list[str] | None = None, also: Sequence[str] = ()) -> DataFrame:
    """``(sample_key, seq, path, also, tokens)``: of each read its fingerprints in order, without those that hold a value the harness planted.

    Strong ones are the secrets themselves, weak ones the first long lines. No shuffle, so it also runs on a stream.
    """
    strong = F.transform(F.filter("secrets", lambda s: F.length(s["raw"]) >= rules.MIN_TOKEN), lambda s: F.struct(s["category"].alias("category"), s["raw"].alias("token"), F.lit("strong").alias("strength")))
    lines = F.filter(F.transform(F.split("content", r"\r?\n"), lambda x: F.trim(x)), lambda x: F.length(x) >= rules.MIN_LINE)
    weak = F.transform(F.slice(lines, 1, rules.LINES), lambda x: F.struct(F.col("categories")[0].alias("category"), x.alias("token"), F.lit("weak").alias("strength")))
    own = lambda t: ~F.lit(False) if not harness else ~F.greatest(F.lit(False), *(t["token"].contains(v) for v in harness))
    return sensitive_reads(reads).select("sample_key", "seq", "path", *also, F.filter(F.concat(strong, F.coalesce(weak, F.array())), own).alias("tokens"))


def taint_tokens(reads: DataFrame, harness: list[str] | None = None) -> DataFrame:
    """``(sample_key, seq, path, pos, category, token, strength)``: a token counts once in a sample, where it was read first, and the first 120 of a sample count."""
    tokens = read_tokens(reads, harness).select("sample_key", "seq", "path", F.posexplode("tokens").alias("pos", "t")).select("sample_key", "seq", "path", "pos", "t.*")
    known = [c for c in tokens.columns if c not in ("sample_key", "token")]
    first = tokens.groupBy("sample_key", "token").agg(F.min(F.struct("seq", "pos", *(c for c in known if c not in ("seq", "pos")))).alias("f")).select("sample_key", "token", "f.*")
    return first_rows(first, ["seq", "pos"], rules.MAX_TOKENS).select("sample_key", "seq", "path", "pos", "category", "token", "strength")


def payload_layers(sends: DataFrame) -> DataFrame:
    """``sends(sample_key, seq, destination, payload)``, a row for each decoded layer with the ``patterns`` in it; made once for all that read it."""
    layers = sends.select("sample_key", F.col("seq").alias("send_seq"), "destination", F.posexplode(decode_layers(F.col("payload"))).alias("layer_pos", "layer"))
    told = layers.withColumn("_likely", may_hold_secrets(F.col("layer")))
    return written_once(told.withColumn("patterns", F.transform(content_secrets(F.col("layer"), F.col("_likely")), lambda s: s["category"])).drop("_likely"), "layers")


#: Tokens of at least so many characters are found by grams of so many; all tokens are in the first class that they fit.
GRAMS = ((rules.MIN_LINE, 12), (rules.MIN_TOKEN, 6))
#: Grams of tokens (rows of some 200 bytes) that may be broadcast to those of the layers.
BROADCAST_GRAMS = 100_000


def layer_grams(layer: Column) -> Column:
    """Of each class every ``step``-th gram of a text; any ``step`` neighbouring positions hold one of them."""

    def one(k: int) -> Column:
        least, gram = GRAMS[k]
        chunks = F.regexp_extract_all(layer, F.lit(rf"(?s).{{{gram},{least - gram + 1}}}"), F.lit(0))
        return F.array_distinct(F.transform(chunks, lambda c: F.xxhash64(F.lit(k), F.substring(c, 1, gram))))

    return F.concat(*map(one, range(len(GRAMS))))


def token_grams(token: Column) -> Column:
    """Of a token the first ``step`` grams: wherever it stands in a text, one of them is a gram of ``layer_grams``."""

    def one(k: int) -> Column:
        least, gram = GRAMS[k]
        return F.transform(F.sequence(F.lit(1), F.lit(least - gram + 1)), lambda i: F.xxhash64(F.lit(k), token.substr(i, F.lit(gram))))

    return F.array_distinct(F.when(F.length(token) >= GRAMS[0][0], one(0)).otherwise(one(1)))


def flows(tokens: DataFrame, sends: DataFrame, layers: DataFrame | None = None) -> DataFrame:
    """Tokens found in what the same sample sent after reading them.

    An index join: a token's first grams meet every so-manieth gram of the layers by sample and hash, and only such
    pairs are compared whole. A token stands for itself however often its grams do.
    """
    layers = payload_layers(sends) if layers is None else layers
    place = ["sample_key", "send_seq", "layer_pos"]
    asked = layers.select(*place, F.explode(layer_grams(F.col("layer"))).alias("gram"))
    index = written_once(tokens.select("*", F.explode(token_grams(F.col("token"))).alias("gram")), "index")
    if index.count() <= BROADCAST_GRAMS:  # else both sides are shuffled
        index = F.broadcast(index)
    near = asked.join(index, ["sample_key", "gram"]).where(F.col("seq") < F.col("send_seq")).select(*place, "seq", "path", "pos", "category", "token", "strength").distinct()
    return layers.join(near, place).where(F.col("layer").contains(F.col("token"))).select("sample_key", "send_seq", "destination", "layer_pos", "seq", "path", "pos", "category", "token", "strength")


def adjudicate(tokens: DataFrame, sends: DataFrame) -> DataFrame:
    """``(sample_key, send_seq, destination, category, via, strength, path, confirmed)``: the best evidence of each category in each send.

    Seen bytes beat a mere pattern and a secret beats a line. Confirmed is what was
    seen, by a secret or in a category that a line may prove.
    """
    layers = payload_layers(sends)
    seen = flows(tokens, sends, layers).select("sample_key", "send_seq", "destination", "layer_pos", "category", F.lit("taint").alias("via"), "strength", "path", F.struct("seq", "pos").alias("order"))
    patterns = layers.select("sample_key", "send_seq", "destination", "layer_pos", F.explode("patterns").alias("category"))
    none = F.struct(F.lit(None).cast(tokens.schema["seq"].dataType).alias("seq"), F.lit(None).cast("int").alias("pos"))
    likely = patterns.select("*", F.lit("pattern").alias("via"), F.lit("strong").alias("strength"), F.lit("").alias("path"), none.alias("order"))
    rank = F.struct((F.col("via") != "taint").alias("_via"), (F.col("strength") != "strong").alias("_strength"), "layer_pos", "order", "via", "strength", "path")
    best = seen.unionByName(likely).groupBy("sample_key", "send_seq", "destination", "category").agg(F.min(rank).alias("b")).select("sample_key", "send_seq", "destination", "category", "b.via", "b.strength", "b.path")
    return best.withColumn("confirmed", (F.col("via") == "taint") & ((F.col("strength") == "strong") | ~F.col("category").isin(rules.WEAK_ONLY)))


def stolen_summary(judged: DataFrame) -> DataFrame:
    """One row for each sample with evidence: what was stolen, where to, and what is only suspected."""
    yes, no = F.col("confirmed"), ~F.col("confirmed")
    each = F.array_sort(F.collect_set(F.when(yes, F.col("category"))))
    sums = judged.groupBy("sample_key").agg(
        each.alias("categories"), F.array_sort(F.collect_set(F.when(no, F.col("category")))).alias("_maybe"), F.array_sort(F.collect_set(F.when(yes, F.col("destination")))).alias("destinations"),
        F.count_distinct(F.when(yes, F.col("send_seq"))).alias("exfiltration_count"), F.count_distinct("send_seq").alias("_sends"),
    )
    return sums.select("sample_key", (F.size("categories") > 0).alias("data_stolen"), "categories", "destinations", "exfiltration_count", F.array_except("_maybe", "categories").alias("suspected"), (F.col("_sends") - F.col("exfiltration_count")).alias("suspected_count"))
