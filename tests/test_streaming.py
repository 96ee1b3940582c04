import time

from trawl.streaming.ingest import Progress, append_new, append_results, first_seen, keep_current, read_current, read_new, read_stream, running_counts

SCHEMA = "k string, at timestamp_ntz"


def feed(spark, folder, rows):
    spark.createDataFrame(rows, "k string, at string").selectExpr("k", "cast(at AS timestamp_ntz) AS at").coalesce(1).write.mode("append").parquet(folder)


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    source, sink, progress = (f"{tmp_path}/{n}" for n in ("in", "out", "progress"))
    for rows in ([("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 01:00:00")], [("a", "2024-01-02 00:00:00"), ("c", "2024-01-02 01:00:00")]):
        feed(spark, source, rows)
        append_results(first_seen(read_stream(spark, source, SCHEMA), "k", "at", "10 days").select("k"), lambda b: b, sink, progress).awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(sink).collect()) == ["a", "b", "c"]


def test_counts_stand_as_of_the_last_batch(spark, tmp_path):
    source, sink, progress = (f"{tmp_path}/{n}" for n in ("in", "out", "progress"))
    told = []
    listener = Progress(lambda *x: told.append(x))
    spark.streams.addListener(listener)
    try:
        for rows in ([("a", "2024-01-01 05:00:00")] * 2, [("a", "2024-01-01 06:00:00"), ("b", "2024-01-03 06:00:00")]):
            feed(spark, source, rows)
            keep_current(running_counts(read_stream(spark, source, SCHEMA), "at", "1 day", "5 days", "k"), sink, progress).awaitTermination()
        for _ in range(50):
            if sum(t[0] == "done" for t in told) == 2:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert {(str(r.window_start)[:10], r.k, r.n) for r in read_current(spark, sink, ["window_start", "k"]).collect()} == {("2024-01-01", "a", 3), ("2024-01-03", "b", 1)}
    assert [t[0] for t in told].count("done") == 2 and any(t[0] == "progress" and t[2] == 2 for t in told)


def test_late_rows_change_nothing(spark, tmp_path):
    source, sink, progress = (f"{tmp_path}/{n}" for n in ("in", "out", "progress"))
    days = ([("a", "2024-01-10 05:00:00"), ("a", "2024-01-09 05:00:00")], [("a", "2024-01-09 06:00:00")], [("a", "2024-01-20 05:00:00")], [("a", "2024-01-09 07:00:00"), ("a", "2024-01-20 06:00:00")])
    for rows in days:
        feed(spark, source, rows)
        keep_current(running_counts(read_stream(spark, source, SCHEMA), "at", "1 day", "2 days", "k"), sink, progress).awaitTermination()
    now = {(str(r.window_start)[:10], r.n) for r in read_current(spark, sink, ["window_start", "k"]).collect()}
    assert now == {("2024-01-09", 2), ("2024-01-10", 1), ("2024-01-20", 2)}
    last = max(p.name for p in (tmp_path / "out").glob("batch=*") if any(p.glob("*.parquet")))
    assert spark.read.parquet(f"{sink}/{last}").where("window_start < '2024-01-15'").isEmpty()  # a batch holds what it changed


def test_a_key_is_never_passed_on_again(spark, tmp_path):
    source, sink = f"{tmp_path}/in", f"{tmp_path}/out"
    feed(spark, source, [("a", "2022-01-01 00:00:00"), ("b", "2022-01-02 00:00:00"), ("a", "2021-12-31 00:00:00"), (None, "2022-01-01 00:00:00")])
    run = lambda progress: append_new(read_stream(spark, source, SCHEMA), ["k"], ["at"], sink, f"{tmp_path}/{progress}").awaitTermination()
    run("one")
    feed(spark, source, [("a", "2024-01-01 00:00:00"), ("c", "2024-01-02 00:00:00"), (None, "2024-01-01 00:00:00")])
    run("one")
    run("two")  # another stream over all the files
    rows = {(r.k, str(r.at)[:10]) for r in read_new(spark, sink, read_stream(spark, source, SCHEMA).schema).collect()}
    assert rows == {("a", "2021-12-31"), ("b", "2022-01-02"), (None, "2022-01-01"), ("c", "2024-01-02")}


def test_an_unfinished_batch_counts_for_nothing(spark, tmp_path):
    source, sink = f"{tmp_path}/in", f"{tmp_path}/out"
    schema = read_stream(spark, f"{tmp_path}", SCHEMA).schema
    assert read_new(spark, sink, schema).count() == 0
    feed(spark, source, [("a", "2022-01-01 00:00:00")])
    append_new(read_stream(spark, source, SCHEMA), ["k"], ["at"], sink, f"{tmp_path}/p").awaitTermination()
    left = spark.createDataFrame([("z", "2022-01-01 00:00:00")], "k string, at string").selectExpr("k", "cast(at AS timestamp_ntz) AS at")
    left.write.parquet(f"{sink}/rows/batch=dead-000000000000")
    left.select("k").write.parquet(f"{sink}/keys/batch=dead-000000000000")  # no entry in the manifest
    feed(spark, source, [("z", "2023-01-01 00:00:00")])
    append_new(read_stream(spark, source, SCHEMA), ["k"], ["at"], sink, f"{tmp_path}/p").awaitTermination()
    assert sorted((r.k, r.at.year) for r in read_new(spark, sink, schema).collect()) == [("a", 2022), ("z", 2023)]
