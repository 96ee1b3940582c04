"""Scalar functions over text, as column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from trawl.functions import rules

#: A quoted string; possessive throughout, so that long ones need no stack.
STRING = r"""'[^'\\]*+(?:\\.[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+"|`[^`\\]*+(?:\\.[^`\\]*+)*+`"""


def hit(text: Column, pattern: str) -> Column:
    """Does the pattern match? False for null."""
    return F.coalesce(text.rlike(rules.ascii_bounds(pattern)), F.lit(False))


def may_hit(low: Column, pattern: str) -> Column:
    """Can the pattern match a text whose lower case is ``low``? Looks for its literals only, which is far cheaper than the pattern."""
    found = F.lit(not rules.needed(pattern))
    for literal in rules.needed(pattern):
        found = found | low.contains(literal)
    return found


def gated_hit(text: Column, low: Column, pattern: str) -> Column:
    """``hit``, with the pattern tried only on texts that hold one of its literals."""
    return F.when(may_hit(low, pattern), hit(text, pattern)).otherwise(F.lit(False))


def any_hit(text: Column, patterns: Sequence[str]) -> Column:
    """Can any of the patterns match? One scan of the text for them all; true wherever ``hit`` is, null for null."""
    every = "|".join(f"(?:{rules.widened(p)})" for p in patterns)

    @F.arrow_udf(BooleanType())
    def scan(texts: pa.Array) -> pa.Array:
        return pc.match_substring_regex(texts, every)

    return scan(text)


def clip(text: Column, n: int) -> Column:
    """White space as one space, trimmed and cut."""
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, n)


def redact(secret: Column) -> Column:
    """The ends of a secret and its length, enough to prove it."""
    s = F.trim(F.regexp_replace(secret, r"\s+", " "))
    short = F.concat(F.substring(s, 1, 2), F.lit("***"), F.right(s, F.lit(2)))
    return F.when(F.length(s) <= 12, short).otherwise(F.concat(F.substring(s, 1, 4), F.lit("…["), F.length(s).cast("string"), F.lit("B]…"), F.right(s, F.lit(4))))


def safe_name(name: Column) -> Column:
    return F.substring(F.regexp_replace(name, r"[^A-Za-z0-9._-]", "_"), 1, 120)


def is_printable(text: Column) -> Column:
    """Over 85 % of the first 2000 characters are tab, line ends, ASCII, or above U+00A0."""
    head = F.substring(text, 1, 2000)
    odd = F.length(F.regexp_replace(head, "[\\t\\n\\r\\x20-\\x7e\\x{a1}-\\x{10ffff}]", ""))
    n = F.length(head)
    return F.coalesce((n > 0) & ((n - odd) / F.greatest(n, F.lit(1)) > 0.85), F.lit(False))


# The least lengths of what may be encoded text, and how many runs are decoded.
WHOLE_BASE64, RUN_BASE64, RUN_HEX, MOST_RUNS = 16, 24, 32, 16


def from_base64(text: Column) -> Column:
    """Base64 as text, lenient about padding and white space; null if it isn't any."""
    bare = F.regexp_replace(text, r"[\s=]", "")
    whole = F.substring(bare, F.lit(1), F.length(bare) - F.when(F.length(bare) % 4 == 1, 1).otherwise(0))
    padded = F.rpad(whole, (F.ceil(F.length(whole) / 4) * 4).cast("int"), "=")
    return F.make_valid_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string"))


def decode_layers(text: Column) -> Column:
    """The text and what it may hide: whole base64, embedded base64 runs, URL encoding, a hexadecimal run; distinct, in this order.

    One scan tells the texts that hold none of these.
    """
    t = F.coalesce(text, F.lit(""))
    encoded = any_hit(t, [rf"^[A-Za-z0-9+/=\s]{{{WHOLE_BASE64},}}$", rf"[A-Za-z0-9+/]{{{RUN_BASE64}}}", "[%+]", rf"[0-9a-fA-F]{{{RUN_HEX}}}"])
    trimmed = F.trim(t)
    whole = F.when(trimmed.rlike(rf"^[A-Za-z0-9+/=\s]{{{WHOLE_BASE64},}}\z"), from_base64(trimmed))
    runs = F.transform(F.slice(F.regexp_extract_all(t, F.lit(rf"(?<![A-Za-z0-9+/])([A-Za-z0-9+/]{{{RUN_BASE64},}}+={{0,2}})")), 1, MOST_RUNS), from_base64)
    runs = F.filter(runs, lambda x: is_printable(x) & (F.length(x) > 8))
    url = F.when(t.rlike("[%+]"), F.try_url_decode(t))  # else it is the text
    run = F.regexp_extract(t, rf"(?<!\w)([0-9a-fA-F]{{{RUN_HEX},}}+)(?!\w)", 1)
    even = F.substring(run, F.lit(1), F.length(run) - F.length(run) % 2)
    hexed = F.when(F.length(run) > 0, F.make_valid_utf8(F.try_to_binary(even, F.lit("hex")).cast("string")))
    first = F.when(is_printable(whole), whole)
    last = F.when(is_printable(hexed), hexed)
    every = F.concat(F.array(t, first), runs, F.array(url, last))
    return F.when(encoded, F.array_distinct(F.filter(every, lambda x: x.isNotNull() & ((x != "") | (x == t))))).otherwise(F.array(t))


#: Runs of what nobody sees: tags and variation selectors.
INVISIBLE = r"[\x{E0000}-\x{E007F}\x{E0100}-\x{E01EF}]{4,}"


def invisible_count(text: Column) -> Column:
    """Code points of tag and variation-selector runs of four or more; emoji tag sequences don't count."""
    runs = F.regexp_extract_all(text, F.lit(rf"([\x{{1F3F4}}]?{INVISIBLE})"))
    flag = "\U0001f3f4"
    payload = F.filter(runs, lambda r: ~r.startswith(flag) & ~(r.contains("\U000e007f") & (F.length(r) <= 8)))
    return F.coalesce(F.aggregate(payload, F.lit(0), lambda a, r: a + F.length(r)), F.lit(0))


_ESCAPE = re.compile(r"\\x([0-9a-fA-F]{2})|\\u([0-9a-fA-F]{4})")


@F.pandas_udf(StringType())
def unescape(texts: pd.Series) -> pd.Series:
    """Text with ``\\xNN`` and ``\\uNNNN`` as characters; SQL has no replacement by a function. Paired surrogates join, lone ones become U+FFFD."""

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        plain = _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)), text)
        return plain.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")

    return texts.map(one)


# What a text holds that ``deobfuscate`` adds anything to.
ESCAPED, ENCODED = r"\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}", r"[A-Za-z0-9+/]{40}"


def deobfuscate(text: Column) -> Column:
    """The text, if it has escapes the same with them decoded, and up to 60 readable base64 runs, one under the other."""
    escaped = unescape(F.when(text.rlike(ESCAPED), text))
    runs = F.transform(F.slice(F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9+/])([A-Za-z0-9+/]{40,}+={0,2})")), 1, 60), from_base64)  # a run is tried from its start alone
    readable = F.filter(runs, lambda d: d.rlike("[a-zA-Z]{4}") & (F.length(F.regexp_replace(d, r"[^\x20-\x7e]", "")) > F.length(d) * 0.7))
    return F.array_join(F.concat(F.array(text, escaped), readable), "\n")  # what is null is left out


# How scripts assign and use variables.
_BATCH = re.compile(r'^\s*set\s+"?([A-Za-z_]\w*)=([^"\r\n]*)"?\s*$', re.I | re.M)
_PWSH = re.compile(r"""^\s*\$([A-Za-z_]\w*)\s*=\s*["']([^"'\r\n]*)["']""", re.I | re.M)
_SHELL = re.compile(r"""^\s*(?:export\s+)?([A-Za-z_]\w*)=["']?([^"'\s\r\n]*)["']?\s*$""", re.I | re.M)
_USE = re.compile(r"%([A-Za-z_]\w*)%|\$\{?([A-Za-z_]\w*)\}?")


def expand_script(text: str, most: int = 200, passes: int = 3) -> str:
    """A script with its own assignments filled in, so that a command split over variables shows."""
    values: dict[str, str] = {}
    for pattern in (_BATCH, _PWSH, _SHELL):
        for m in pattern.finditer(text):
            if len(values) >= most:
                break
            values[m[1].upper()] = m[2]
    for _ in range(passes if values else 0):
        filled = _USE.sub(lambda m: values.get((m[1] or m[2]).upper(), m[0]), text)
        if filled == text:
            break
        text = filled
    return text


@F.pandas_udf(StringType())
def expand_script_vars(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in parts:
        yield texts.map(lambda t: None if t is None else expand_script(t))


def is_cradle(command: Column) -> Column:
    """One command that names a downloader, names a remote payload, and runs what it fetched."""
    stripped = F.regexp_replace(command, rules.ascii_bounds(rules.TOOL_IMAGES), "")
    return (F.length(command) <= 4000) & hit(command, rules.LOLBIN) & hit(command, rules.EXEC_CHAIN) & hit(stripped, rules.PAYLOAD)


def has_untrusted_binary(text: Column, low: Column | None = None) -> Column:
    """A URL of an executable on a host that distributes none."""
    hosts = F.regexp_extract_all(text, F.lit(rules.ascii_bounds(rules.REMOTE_BINARY)), F.lit(1))
    if low is not None:
        hosts = F.when(may_hit(low, rules.REMOTE_BINARY), hosts)
    return F.coalesce(F.exists(hosts, lambda h: ~h.rlike(rules.TRUSTED_HOST)), F.lit(False))


def host_port(raw: Column) -> Column:
    """``struct(domain, ip, port)`` of a URL or ``host:port``; lower case, default ports left out."""
    scheme = F.lower(F.regexp_extract(raw, r"(?i)^([a-z][a-z0-9+.-]*)://", 1))
    rest = F.regexp_replace(raw, r"(?i)^[a-z][a-z0-9+.-]*://", "")
    authority = F.regexp_replace(F.regexp_extract(rest, r"^([^/?#\s]*)", 1), r"^.*@", "")
    domain = F.lower(F.regexp_extract(authority, r"^(\[[^\]]*\]|[^:]*)", 1))
    port = F.regexp_extract(authority, r":(\d+)$", 1)
    default = F.when(scheme == "https", "443").when(scheme.isin("http", ""), "80").otherwise("")
    return F.struct(domain.alias("domain"), F.when(domain.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), domain).otherwise("").alias("ip"), F.when(port == default, "").otherwise(port).alias("port"))


def families(reasons: Column) -> Column:
    """The indicator families of an array of reasons, in the order they first appear."""
    one = lambda r: F.filter(F.array(*(F.when(r.rlike(p), F.lit(name)) for name, p in rules.FAMILIES)), lambda x: x.isNotNull())
    return F.array_distinct(F.flatten(F.transform(reasons, one)))
