import re

import corpus_pipeline
from tests.llm.test_nearcopies import components


def test_stages_take_effect(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    columns, held = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, held[-1], sf).write.parquet(str(tmp_path / name))
        held.append(spark.read.parquet(str(tmp_path / name)))
    raw, good, lines, near, clean, packed = held
    assert all(d.columns == columns for d in held[:-1])
    rows = [{r.doc_id: r for r in d.collect()} for d in held[:-1]]
    # quality: a filter that keeps the trusted and rejects most of the rest
    assert all(rows[0][k] == r for k, r in rows[1].items())
    share = lambda q: sum(k in rows[1] for k, v in labels.items() if v == q) / sum(v == q for v in labels.values())
    assert share(1) > 0.98 and share(0) < 0.5
    # lines: every document stays, no line twice
    assert rows[2].keys() == rows[1].keys()
    kept = [" ".join(x.split()) for r in rows[2].values() for x in r.text.split("\n") if x.strip()]
    assert len(kept) == len(set(kept)) and set(kept) <= {" ".join(x.split()) for r in rows[1].values() for x in r.text.split("\n")}
    assert all(r.n_chars == len(r.text) for r in rows[2].values())
    # near copies: components of true shingle sets keep their smallest id
    low = components({k: r.text for k, r in rows[2].items()})
    assert rows[3].keys() == {k for k, v in low.items() if k == v} and all(rows[2][k] == r for k, r in rows[3].items())
    # benchmark: nothing left holds a whole item
    flat = lambda t: f" {' '.join(re.findall(r'\w+', t.lower()))} "
    items = [flat(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert rows[4].keys() <= rows[3].keys() and not any(i in flat(r.text) for r in rows[4].values() for i in items)
    # packing: all documents of the last stage, whole
    total = {}
    for r in packed.collect():
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
        assert total[r.doc_id] <= r.doc_tokens
    assert total.keys() == rows[4].keys()


def test_run_equals_the_stages(spark, sf):
    rows = corpus_pipeline.run(spark, sf)
    assert rows.count() > 0 and rows.columns[:4] == ["doc_id", "start", "length", "ids_crc32"]


def test_nulls_repeats_and_empty_tables(spark, tmp_path):
    """Rows without an id or a text pass all stages; a contaminated one goes, named or not."""
    item = "the answer to this long benchmark question stands in its last seven words here"
    text = lambda k: " ".join(f"wort{(k * 7 + i * i) % 97}" for i in range(60))
    rows = [(i, text(i), "en", "s", 1) for i in range(20)] + [(None, text(50), "en", "s", 1), (None, f"{text(51)} {item}", None, None, None), (30, None, None, None, None), (31, "", "en", "s", 0), (3, text(3), "en", "s", 1), (40, f"{text(52)}\n{item}", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, item), (2, None)], "item_id long, text string")
    for name, df in (("full", docs), ("none", docs.limit(0))):
        for table, data in (("documents", df), ("labels", labels), ("benchmark", bench)):
            data.coalesce(1).write.parquet(f"{tmp_path}/{name}/{table}.parquet")
    held = spark.read.parquet(f"{tmp_path}/full/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[1:4]:  # the first needs more text than this to judge by
        held = stage(spark, held, f"{tmp_path}/full")
        assert held.columns == docs.columns
    left = [r.doc_id for r in held.collect()]
    assert left.count(None) == 1 and 40 not in left and 30 in left and set(range(20)) <= set(left)
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
