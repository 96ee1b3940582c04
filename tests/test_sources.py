import io
import zipfile
from pathlib import Path

from trawl.schemas import RESULTS
from trawl.sources import packages, tables


def packed(entries):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in entries.items():
            z.writestr(name, content)
    return raw.getvalue()


def put(root, files):
    for name, content in files.items():
        p = Path(root) / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(content if isinstance(content, bytes) else content.encode())


def test_archives_and_folders(spark, tmp_path):
    put(tmp_path, {"a/x.vsix": b"1", "a/node_modules/y.vsix": b"1", "b/Z.VSIX": b"22", "c.txt": "n", "/".join("d" * 12) + "/deep.vsix": b"1"})
    put(tmp_path, {"p/package.json": "{}", "p/sub/package.json": "{}", "q/r/package.json": "{}", "q/.git/package.json": "{}"})
    found = packages.find_archives(spark, str(tmp_path)).collect()
    assert {(Path(r.target).name, r.is_dir, r.size) for r in found} == {("x.vsix", False, 1), ("Z.VSIX", False, 2)}
    assert {r.target.rpartition(str(tmp_path))[2] for r in packages.find_folders(spark, str(tmp_path)).collect()} == {"/p", "/q/r"}


def test_entries_of_archives(spark, tmp_path):
    put(tmp_path, {"good.vsix": packed({"extension/package.json": "{}", "extension/node_modules/m/package.json": "{}", "../../up\\x.js": "evil", "extension/a.js": "1" * 50}), "bad.vsix": b"no archive"})
    rows = packages.archive_entries(spark, str(tmp_path), contents=r"\.js$")
    held = {(Path(r.target).name, r.path): r for r in rows.collect()}
    assert held["good.vsix", "extension/a.js"].content == b"1" * 50 and held["good.vsix", "up/x.js"].content == b"evil" and held["good.vsix", "extension/package.json"].content is None
    assert held["bad.vsix", ""].error.startswith("not an archive") and len(held) == 5
    assert [r.root for r in packages.package_root(rows).collect()] == ["extension"]


def test_corpus_root_and_kind():
    wrapped = ["/d/Set/Set/extensions/a.vsix", "/d/Set/Set/metadata/m.csv", "/d/Set/.git/x"]
    assert packages.corpus_root(wrapped, "/d/Set") == "/d/Set/Set" and packages.corpus_kind(wrapped, "/d/Set/Set") == "vsmex"
    assert packages.corpus_root(["/d/one/vsmex-main/extensions/p/q.txt"], "/d/one") == "/d/one/vsmex-main/extensions"
    assert packages.corpus_root(["/d/one/a.vsix", "/d/one/one/b.vsix"], "/d/one") == "/d/one" == packages.corpus_root(["/d/one/other/b.vsix"], "/d/one")
    assert [packages.corpus_kind([], f"/d/{n}") for n in ("My_Malicious", "benign-2", "rest")] == ["datadog-malicious", "datadog-benign", "generic"]
    corpora = [("a", "/x"), ("b", "/y"), ("a", "/gone")]
    assert packages.chosen_corpora(corpora, "All", lambda d: d != "/gone") == corpora[:2] and packages.chosen_corpora(corpora, "A", lambda d: d != "/gone") == corpora[:1]


def test_entry_file(spark):
    files = [("m", "lib/start.js", 5), ("m", "big.js", 900), ("u", "dist/extension.js", 3), ("u", "big.js", 9), ("l", "a.js", 1), ("l", "b.mjs", 7), ("l", "test/c.js", 99), ("n", "x.css", 4)]
    manifests = [("m", "./lib/start", None), ("u", None, None), ("l", "", None), ("n", None, None)]
    got = packages.entry_file(spark.createDataFrame(files, "sample_key string, path string, size long"), spark.createDataFrame(manifests, "sample_key string, main string, browser string"))
    assert dict(map(tuple, got.collect())) == {"m": "lib/start.js", "u": "dist/extension.js", "l": "b.mjs"}


def test_csv(spark, tmp_path):
    put(tmp_path, {"t.csv": 'b,a,c\n9,,\n1,"x ""q"", y",\nonly\n,"line\nend",3\n"","",""\n\n'})
    rows = tables.read_csv(spark, f"{tmp_path}/t.csv", "a string, b string, d string")
    assert sorted(map(tuple, rows.collect())) == [("", "", ""), ("", "9", ""), ("line\nend", "", ""), ('x "q", y', "1", "")]
    assert tables.read_csv(spark, f"{tmp_path}/none.csv", "a string").collect() == []
    tables.write_csv(rows, f"{tmp_path}/out")
    tables.write_csv(rows, f"{tmp_path}/out", append=True)
    assert sorted(map(tuple, tables.read_csv(spark, f"{tmp_path}/out", "a string, b string, d string").collect())) == sorted([*map(tuple, rows.collect())] * 2)


def test_results_and_reports(spark, tmp_path):
    names = [x.split(" ")[0] for x in RESULTS.split(", ")]
    put(tmp_path, {"r.csv": ",".join(names) + "\n" + ",".join("7" if n == "score" else "" if n == "label" else "x" for n in names) + "\n"})
    row = tables.read_results(spark, f"{tmp_path}/r.csv").first()
    assert row.score == 7 and row.label is None and row.final_verdict == "x" and row.total_events is None
    put(tmp_path, {"j/1.json": '{"a": 1, "b": {"c": "x"}}', "j/2.json": "{broken"})
    assert {(r.a, r.b.c if r.b else None) for r in tables.read_reports(spark, f"{tmp_path}/j", "a int, b struct<c string>").collect()} == {(1, "x"), (None, None)}
    tables.write_reports(spark.createDataFrame([("p/q@1", 1)], "key string, n int"), f"{tmp_path}/reports", "key")
    assert [p.name for p in (tmp_path / "reports").iterdir() if p.is_dir()] == ["sample_folder=p_q_1"]
    tables.write_json(spark.createDataFrame([(1,)], "n int"), f"{tmp_path}/lines")
    assert [r.n for r in spark.read.json(f"{tmp_path}/lines").collect()] == [1]
