import random

from pyspark.sql import functions as F

from trawl.operators.numbering import first_rows, running


def table(spark):
    rng = random.Random(7)
    rows = [(1 if rng.random() < 0.9 else rng.choice([2, 3, None]), k, rng.randrange(100)) for k in range(3000)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "sample_key long, id long, size long").repartition(5)


def test_equals_row_number_with_one_sample_of_most_rows(spark):
    rows = table(spark)
    got = running(rows, ["id"], {"n": F.lit(1), "bytes": F.col("size")})
    assert got.columns == ["sample_key", "id", "size", "n", "bytes"]
    rows.createOrReplaceTempView("numbering_rows")
    want = spark.sql("SELECT *, row_number() OVER w AS n, sum(size) OVER w AS bytes FROM numbering_rows WINDOW w AS (PARTITION BY sample_key ORDER BY id)")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert running(rows.limit(0), ["id"], {"n": F.lit(1)}).count() == 0


def test_ties_and_repeated_rows_are_numbered_apart(spark):
    rows = spark.createDataFrame([(1, 5, "a")] * 40, "sample_key long, id long, x string").repartition(4)
    assert sorted(r.n for r in running(rows, ["id"], {"n": F.lit(1)}).collect()) == list(range(1, 41))


def test_first_rows_of_each_sample(spark):
    rows = table(spark)
    got = first_rows(rows, ["id"], 10)
    want = {}
    for r in sorted(rows.collect(), key=lambda r: r.id):
        want.setdefault(r.sample_key, []).append(r.id)
    kept = {}
    for r in got.collect():
        kept.setdefault(r.sample_key, []).append(r.id)
    assert {k: sorted(v) for k, v in kept.items()} == {k: v[:10] for k, v in want.items()}
