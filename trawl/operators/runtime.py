"""From raw hook calls to the tables that the analyses read: numbered events, outbound messages, taint sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.functions.text import decode_layers
from trawl.operators.numbering import running

# How long a logged string, message body and decoded preview may be.
ARGUMENT, BODY, DECODED, HEADER = 600, 2000, 800, 200
CUT_MARK = "…[truncated]"
LEAST_VALUE = 12


def cut(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(CUT_MARK))).otherwise(text)


def numbered(rows: DataFrame, order: Sequence[str], name: str = "id") -> DataFrame:
    """Rows with a running number in each sample, from 1, in the given order."""
    return running(rows, order, {name: F.lit(1)}).withColumn(name, F.col(name).cast("int"))


def sanitized(arguments: Column) -> Column:
    """A map of logged arguments with long strings cut."""
    return F.transform_values(arguments, lambda _, v: cut(v, ARGUMENT))


def sanitized_list(values: Column, most: int = 20, each: int = 200) -> Column:
    """A logged list: its first values, each cut."""
    return F.transform(F.slice(values, 1, most), lambda v: F.substring(v, 1, each))


def beacons(calls: DataFrame) -> DataFrame:
    """``calls(sample_key, elapsed_ms, call_id, transport, destination, host, method, headers, body)`` to outbound messages.

    ``seq`` runs in each sample by time, then ``call_id``. A missing host is read from the destination; ``body_bytes`` is the
    whole body's length in characters; ``decoded`` is the first layer that isn't the body itself.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    body = blank("body")
    layers = F.filter(decode_layers(body), lambda x: (x != body) & (x != ""))
    authority = F.regexp_extract("destination", r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)
    shown = calls.withColumns({
        "transport": F.coalesce("transport", F.lit("unknown")), "host": F.coalesce(F.nullif("host", F.lit("")), F.lower(authority), F.lit("")), "destination": F.coalesce(F.nullif("destination", F.lit("")), F.nullif("host", F.lit("")), F.lit("unknown")),
        "method": blank("method"), "headers": F.transform_values("headers", lambda _, v: F.substring(v, 1, HEADER)), "body_bytes": F.length(body), "decoded": F.substring(F.coalesce(F.try_element_at(layers, F.lit(1)), F.lit("")), 1, DECODED), "body": cut(body, BODY),
    })
    return numbered(shown, ["elapsed_ms", "call_id"], "seq").select("sample_key", "seq", "elapsed_ms", "transport", "destination", "host", "method", "headers", "body", "body_bytes", "decoded")


def sinks(events: DataFrame) -> DataFrame:
    """Logged calls that carry data out, as ``(sample_key, seq, destination, payload)`` for the taint join.

    Requests send their address and body, sockets what is written, resolvers the names asked for, processes
    their command, arguments and longer environment values.
    """
    a, module, call = (lambda k: F.try_element_at("arguments", F.lit(k))), F.col("module"), F.col("function_hooked")
    text = lambda *keys: F.concat_ws("\n", *(a(k) for k in keys))
    environment = F.filter(F.transform(F.filter(F.map_entries("arguments"), lambda e: e["key"].startswith("env.")), lambda e: e["value"]), lambda v: F.length(v) >= LEAST_VALUE)
    address = F.coalesce(a("url"), a("host"), F.lit("unknown"))
    sent = (
        F.when(module.isin("http", "https", "fetch", "axios"), F.struct(address.alias("destination"), text("url", "body").alias("payload")))
        .when(module.isin("net", "tls") & call.isin("write", "end", "connect"), F.struct(F.concat_ws(":", a("host"), a("port")).alias("destination"), text("data").alias("payload")))
        .when(module == "dns", F.struct(F.concat(F.lit("dns:"), F.coalesce(a("hostname"), F.lit(""))).alias("destination"), text("hostname").alias("payload")))
        .when(module == "child_process", F.struct(F.concat(F.lit("process:"), F.substring(F.coalesce(a("command"), F.lit("")), 1, 80)).alias("destination"), F.concat_ws("\n", a("command"), a("args"), environment).alias("payload")))
    )
    return events.select("sample_key", F.col("id").alias("seq"), sent.alias("s")).where("s.payload <> ''").select("sample_key", "seq", "s.destination", "s.payload")
