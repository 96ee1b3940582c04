"""Shapes of calls in scripts: what is evaluated, executed, decrypted or written, told from the calls' arguments.

A script is cut into tokens by one alternation: comments (as empty tokens), strings, regular expressions, names, gaps and
single marks. Its brackets and commas are then rows of a relation: a running sum gives each its depth, and those of
one depth between an opening bracket and the next are that bracket's own. So a group of rows is a bracket, with where it opens
and closes, its commas, and the words before it: calls and their arguments, however deep. Comments are gaps, so
nothing in them counts; what stands in strings isn't code. All repetitions are possessive, so
matching needs no stack however long a token is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.functions import rules
from trawl.functions.text import STRING, gated_hit, hit, is_cradle
from trawl.session import written_once

COMMENT = r"//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+(?:\*/)?"
#: A slash opens a regular expression only where no value can stand before it.
REGEX = r"(?<=[(,=:\[!&|?{};]\s{0,4})/(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[a-z]*+"
#: One that isn't closed ends with its line, or, a template, with the text; so none is looked for twice.
ANY_STRING = r"""'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'?|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"?|`[^`\\]*+(?:\\.[^`\\]*+)*+`?"""
#: The token is the group; comments are outside it, so nothing of their text is kept.
TOKEN = rf"(?s){COMMENT}|(\s++|{ANY_STRING}|{REGEX}|[\w$]++|.)"

# Functions that run processes, write files or decode, places that are written to, and what is said of them.
PROCESS = "exec|execSync|spawn|spawnSync|execFile|execFileSync|fork"
WRITE = "writeFile|writeFileSync|appendFile|appendFileSync|createWriteStream|copyFile|copyFileSync"
EVALS, CIPHERS = "eval|Function", "createDecipheriv|createDecipher"
CALLED = f"eval|{CIPHERS}|on|{PROCESS}|{WRITE}"
REASONS = {
    "loader": "AST: eval()/new Function() over DECODED data (base64/decipher/inflate) — multi-stage loader",
    "dependency": "AST: dependency eval()/new Function() over decoded data",
    "built": "AST: dynamic eval()/new Function() on a constructed (non-static) value",
    "packed": "runtime-decrypts an embedded payload with a hard-coded key (packed second stage)",
    "shell": "AST: reverse shell — a socket data handler executes received input as a process",
    "command": "AST: child_process executing a DECODED command string",
    "tainted": "AST: child_process invoked with a non-static/tainted command argument",
    "autostart": "AST: writes into an autostart/persistence location",
    "drops": "AST: writes an executable/script payload to disk",
    "drops safely": "AST: writes an executable payload into a temp/extension directory",
}
DECODER = r"\b(?:atob|inflate|inflateSync|inflateRaw|inflateRawSync|gunzip|gunzipSync|brotliDecompress|brotliDecompressSync|createDecipheriv|createDecipher|decrypt|decipher)\s*\("
BUFFER_DECODE = r"""(?i)\bBuffer\.from\s*\(.{0,400}?,\s*['"](?:base64|base64url|hex)['"]\s*\)"""
EXECUTABLE = r"""(?i)\.(?:exe|dll|scr|msi|bat|cmd|ps1|vbs|jar|lnk)(?:["'`]|\z)"""
AUTOSTART = r"(?i)(?:Start(?:up)?[\\/]+Menu|[\\/]Startup[\\/]|LaunchAgents|\.config[\\/]autostart|init\.d|systemd[\\/]user)"
SAFE_PLACE = r"(?i)(?:tmpdir\(\)|os\.tmpdir|globalStorage|storageUri|storagePath|logPath|logUri|extensionPath|extensionUri|__dirname|context\.(?:global|workspace)State|\.vscode[\\/]|node_modules[\\/]|\.cache[\\/])"

LITERAL = rf"(?:{STRING}|[\d.]+|true|false|null)"


def is_gap(token: Column) -> Column:
    return token.rlike(r"^(?:\s|\z)")


def is_string(token: Column) -> Column:
    return token.rlike(r"""^['"`]""")


def marks(tokens: Column) -> Column:
    """Of the brackets and commas: their place, the two tokens before and the one behind, gaps aside."""
    code = F.filter(F.transform(tokens, lambda t, i: F.struct(i.alias("i"), t.alias("t"))), lambda x: ~is_gap(x["t"]))
    return F.transform(F.array(code), lambda c: F.filter(  # bound once
        F.transform(c, lambda x, k: F.when(x["t"].isin(*"()[]{},"), F.struct(x["i"].alias("i"), x["t"].alias("t"), F.try_element_at(c, F.when(k > 0, k)).getField("t").alias("before"), F.try_element_at(c, F.when(k > 1, k - 1)).getField("t").alias("second"), F.try_element_at(c, k + 2).getField("t").alias("behind")))),
        lambda x: x.isNotNull(),
    ))[0]


def is_call(name: Column, lead: Column) -> Column:
    """Is it a call of ``CALLED`` if a bracket stands behind the name?"""
    return name.rlike(rf"^(?:{CALLED})$") | ((name == "Function") & (lead == "new"))


def call_places(scripts: DataFrame) -> DataFrame:
    """``scripts(file, marks)`` to ``(file, calls)``: of each bracket behind a name of ``CALLED`` the name, and where its arguments begin and end.

    A definition isn't a call: ``function f(...)`` or, as in classes, ``f(...) {``.
    """
    rows = scripts.select("file", F.explode("marks").alias("m")).select("file", "m.*")
    whole = Window.partitionBy("file").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    opens, closes = F.col("t").isin(*"([{"), F.col("t").isin(*")]}")
    deep = rows.withColumn("depth", F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(whole))
    level = deep.withColumn("level", F.col("depth") + F.when(closes, 1).otherwise(0))
    own = Window.partitionBy("file", "level").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    told = level.withColumn("nth", F.sum(F.when(opens, 1).otherwise(0)).over(own))
    of = lambda name, c: F.max(F.when(opens, F.col(c))).alias(name)
    groups = told.groupBy("file", "level", "nth").agg(
        F.min(F.when(F.col("t") == "(", F.col("i"))).alias("open"), F.min(F.when(F.col("t") == ")", F.col("i"))).alias("close"), of("name", "before"), of("lead", "second"),
        F.max(F.when(closes, F.col("behind"))).alias("behind"), F.array_sort(F.collect_list(F.when(F.col("t") == ",", F.col("i")))).alias("commas"),
    )
    call = groups.where("open IS NOT NULL AND close > open").where(is_call(F.col("name"), F.col("lead")) & ~F.coalesce(F.col("lead") == "function", F.lit(False)) & ~F.coalesce(F.col("behind") == "{", F.lit(False)))
    return call.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("open", "close", "name", "commas"))).alias("calls"))


def arguments(tokens: Column, call: Column) -> Column:
    """The texts of a call's arguments: comments as blanks, and strings as they are."""
    edges = F.concat(F.array(call["open"]), call["commas"], F.array(call["close"]))
    shown = lambda a, b: F.trim(F.array_join(F.transform(F.slice(tokens, a + 2, b - a - 1), lambda t: F.when(t == "", F.lit(" ")).otherwise(t)), ""))
    each = F.zip_with(F.slice(edges, F.lit(1), F.size(edges) - 1), F.slice(edges, F.lit(2), F.size(edges) - 1), shown)
    return F.when((F.size(edges) == 2) & (F.element_at(each, 1) == ""), F.slice(each, 1, 0)).otherwise(each)


#: What a string is in code that is searched for names: empty, but for the encodings.
BLANK = rf"""(?s)(['"](?i:base64|base64url|hex)['"])|{STRING}"""


def code(argument: Column) -> Column:
    return F.regexp_replace(argument, BLANK, "$1")


def is_decoded(argument: Column) -> Column:
    return F.coalesce(code(argument).rlike(f"{DECODER}|{BUFFER_DECODE}"), F.lit(False))


def is_static(argument: Column) -> Column:
    """Nothing, or literals put together; a template that fills in values isn't one."""
    return F.coalesce(argument.rlike(rf"^(?:{LITERAL}(?:\s*\+\s*{LITERAL})*+)?\z") & ~argument.rlike(r"`[^`]*\$\{"), F.lit(True))


def is_json_eval(argument: Column) -> Column:
    """Parentheses as the outer ends of the evaluated text, as old JSON readers put them."""
    return argument.rlike(r"""^['"`]\s*\((?:\s*['"`]|\s*[\[{])""") & argument.rlike(r"""\)\s*['"`]\z""")


def shape_findings(files: DataFrame) -> DataFrame:
    """``files(sample_key, path, content)`` to findings like those of ``static.findings``; each reason once a file."""
    path, text = F.col("path"), F.col("content")
    js = files.where(path.rlike(r"(?i)\.(?:js|cjs|mjs|jsx|ts|tsx)$"))
    cut = js.select("sample_key", "path", F.when(F.length(text) <= rules.MAX_FILE_BYTES, F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1))).alias("tokens"))  # no filter by length, which would have the content made twice
    read = cut.select("*", marks(F.col("tokens")).alias("marks"), F.filter("tokens", is_string).alias("strings"))
    calls_any = F.exists("marks", lambda m: (m["t"] == "(") & F.coalesce(is_call(m["before"], m["second"]), F.lit(False)))
    told_by = {"cradle": F.exists("strings", is_cradle), "encoded": F.exists("strings", lambda s: hit(s, rules.ENCODED_COMMAND)), "calls_any": calls_any}
    # the numbers come last, so the filter isn't evaluated below them a second time
    seen = read.select(F.monotonically_increasing_id().alias("file"), "sample_key", "path", "tokens", "marks", *(c.alias(k) for k, c in told_by.items()))
    scripts = written_once(seen.where("cradle OR encoded OR calls_any"), "scripts")
    calls = call_places(scripts.where("calls_any").select("file", "marks"))
    named = lambda c, names: c["name"].rlike(rf"^(?:{names})$")
    arg = lambda c, k: F.try_element_at(c["a"], F.lit(k))
    decoded = lambda c: named(c, f"{EVALS}|{PROCESS}") & (is_decoded(arg(c, 1)) | (named(c, EVALS) & is_decoded(arg(c, -1))))
    given = scripts.join(calls, "file", "left").select("sample_key", "path", "cradle", "encoded", F.transform("calls", lambda c: F.struct(c["name"].alias("name"), arguments(F.col("tokens"), c).alias("a"))).alias("calls"))
    given = given.withColumn("calls", F.transform("calls", lambda c: F.struct(c["name"].alias("name"), c["a"].alias("a"), decoded(c).alias("decoded"))))  # told once, for the tests that ask for it
    app = ~path.rlike(r"(^|/)node_modules/")
    any_of = lambda names, test: F.coalesce(F.exists("calls", lambda c: named(c, names) & test(c)), F.lit(False))
    loads = lambda c: c["decoded"]
    whole_string = lambda a: F.coalesce(a.rlike(rf"^(?:{STRING})\z"), F.lit(False))
    key = lambda c: (whole_string(arg(c, 2)) & (F.length(arg(c, 2)) >= 18)) | F.coalesce(arg(c, 2).rlike(BUFFER_DECODE), F.lit(False))
    runs = lambda a: a.rlike(r"(?s)^(?:async\b\s*)?(?:function\b|\(.*\)\s*=>|[\w$]+\s*=>)") & code(a).rlike(rf"(?<![\w$])(?:{PROCESS})\s*\(")
    executable, autostart, safe = (lambda c, p=p: hit(arg(c, 1), p) for p in (EXECUTABLE, AUTOSTART, SAFE_PLACE))
    tests = [
        (F.col("cradle"), 55, rules.CRADLE_REASON, "primary"),
        (F.col("encoded"), 50, rules.ENCODED_REASON, "primary"),
        (app & any_of(EVALS, loads), 45, REASONS["loader"], "primary"),
        (~app & any_of(EVALS, loads), 15, REASONS["dependency"], "supporting"),
        (app & any_of(EVALS, lambda c: ~loads(c) & ~is_static(arg(c, 1)) & ~F.coalesce(is_json_eval(arg(c, 1)), F.lit(False))), 12, REASONS["built"], "supporting"),
        (any_of(CIPHERS, lambda c: whole_string(arg(c, 1)) & key(c)), 45, REASONS["packed"], "primary"),
        (app & any_of("on", lambda c: F.coalesce(arg(c, 1).rlike(r"""^['"](?:data|message)['"]\z""") & runs(arg(c, 2)), F.lit(False))), 55, REASONS["shell"], "primary"),
        (app & any_of(PROCESS, loads), 50, REASONS["command"], "primary"),
        (app & any_of(PROCESS, lambda c: ~loads(c) & ~is_static(arg(c, 1))), 12, REASONS["tainted"], "supporting"),
        (app & any_of(WRITE, lambda c: autostart(c)), 45, REASONS["autostart"], "primary"),
        (app & any_of(WRITE, lambda c: executable(c) & ~autostart(c) & ~safe(c)), 35, REASONS["drops"], "primary"),
        (app & any_of(WRITE, lambda c: executable(c) & ~autostart(c) & safe(c)), 15, REASONS["drops safely"], "supporting"),
    ]
    found = F.filter(F.array(*(F.when(c, F.struct(F.lit(p).alias("points"), F.lit(r).alias("reason"), F.lit(t).alias("tier"))) for c, p, r, t in tests)), lambda f: f.isNotNull())
    each = given.select("sample_key", "path", F.explode_outer(found).alias("f")).where("f IS NOT NULL")
    return each.select("sample_key", "f.points", "f.reason", F.col("path").alias("file"), F.lit(None).cast("string").alias("detail"), "f.tier")


# How modules import and export.
MODULE = (r"(^|\n)\s*import[\s*{'\"]", r"(^|\n)\s*export\s*[\{*]", r"(^|\n)\s*export\s+(default|const|function|class|let|var)\b")


def is_module_source(text: Column) -> Column:
    """Does a script import or export as modules do?"""
    low = F.lower(text)
    found = F.lit(False)
    for p in MODULE:
        found = found | gated_hit(text, low, p)
    return found


# Comparisons in which a script's trigger words stand, and words to pad them with.
COMPARED = r"""(?:\.includes|\.startsWith|\.endsWith|\.indexOf|\.match|===?|case)\s*\(?\s*['"]([a-zA-Z][a-zA-Z0-9 _-]{1,20})['"]"""
USUAL_WORDS = ["help", "test", "run", "start", "debug", "scan", "login", "password", "token", "admin"]


def trigger_keywords(text: Column, most: int = 14, matches: int = 60) -> Column:
    """Words that a script compares its input with, its own first; the usual ones fill up to ``most``."""
    own = F.array_distinct(F.transform(F.slice(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(COMPARED), F.lit(1)), 1, matches), F.lower))
    return F.slice(F.array_distinct(F.concat(F.slice(own, 1, most), F.array_except(F.array(*map(F.lit, USUAL_WORDS)), own))), 1, most)
