import datetime as dt

from trellis.operators.sessions import checkpoints, repeated_searches
from trellis.streaming import every_nth, first_per_session, skip_repeats, watch

T0 = dt.datetime(2025, 1, 1)
ROWS = [(i, i % 3, "ab"[i % 2], T0 + dt.timedelta(seconds=70 * i)) for i in range(60)]
SCHEMA = "event_id long, session long, terms string, ts timestamp"


def _run(spark, df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_streams_equal_batches(spark, tmp_path):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    for k in range(2):
        rows.filter(f"event_id div 30 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {(r.event_id, r.skipped) for r in _run(spark, skip_repeats(stream(), 430), "skips")}
    assert got == {(r.event_id, r.skipped) for r in repeated_searches(rows, 430).collect()}
    got = {(r.event_id, r.turn) for r in _run(spark, every_nth(stream(), 10), "turns")}
    assert got == {(r.event_id, r.turn) for r in checkpoints(rows, 10).collect()}
    assert sorted(r.session for r in _run(spark, first_per_session(stream()), "firsts")) == [0, 1, 2]


def test_watch(spark, tmp_path):
    spark.createDataFrame([("a.py",), ("a.py",), ("vendor/b.py",), ("c.txt",), ("d/e.ts",), (None,)], "path string").coalesce(1).write.parquet(str(tmp_path / "changes"))
    built = []
    changes = spark.readStream.schema("path string").parquet(str(tmp_path / "changes"))
    watch(changes, built.append, str(tmp_path / "cp"), once=True).awaitTermination(120)
    assert built == [["a.py", "d/e.ts"]]


def test_upkeep_runs_a_day_after_the_last_run(spark):
    import datetime as dt

    from trellis.operators.sessions import daily_runs

    at = lambda *x: dt.datetime(2025, 1, *x)
    times = [at(1, 23, 59), at(2, 0, 1), at(2, 23, 58, 59), at(3, 0, 10), at(4, 0, 5), at(4, 0, 10), None, at(9, 1)]
    df = spark.createDataFrame([(t,) for t in times], "ts timestamp_ntz")
    assert [dt.datetime.fromtimestamp(r["at"], dt.UTC).replace(tzinfo=None) for r in daily_runs(df).collect()] == [at(1, 23, 59), at(3, 0, 10), at(4, 0, 10), at(9, 1)]
    assert daily_runs(df.limit(0)).count() == 0
