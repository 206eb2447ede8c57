"""Streaming jobs by value: late rows, repeats, replays, and buckets that a batch leaves alone."""

import datetime

from pyspark.sql import functions as F

from fairground.streaming import jobs


def _land(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_upserts_touch_their_buckets_alone(spark, tmp_path):
    source, target, state = (str(tmp_path / p) for p in ("in", "out", "state"))
    schema = "id long, title string, origin_priority int"
    run = lambda: jobs.stream_upsert(spark, source, target, state, ["title"], buckets=8).awaitTermination(120)
    _land(spark, source, [(k, f"old {k}", 10) for k in range(100)], schema)
    run()
    _land(spark, source, [(1, "new", 5), (2, "weak", 20), (1, "newer", 4), (500, "first", 1)], schema)
    run()
    run()
    got = {r.id: r.title for r in jobs.current(spark, target).collect()}
    assert got == {k: f"old {k}" for k in range(100)} | {1: "newer", 500: "first"}
    versions = spark.read.parquet(target).where("version > 0").select("bucket").distinct()
    touched = spark.createDataFrame([(1,), (2,), (500,)], "id long").select(F.pmod(F.xxhash64("id"), F.lit(8)).cast("int").alias("bucket")).distinct()
    assert {r.bucket for r in versions.collect()} == {r.bucket for r in touched.collect()}


def test_days_are_appended_once_closed(spark, tmp_path):
    source, target, state = (str(tmp_path / p) for p in ("in", "out", "state"))
    schema = "observation_id long, reason string, ts timestamp"
    at = lambda d, h: datetime.datetime(2026, 9, d, h)
    run = lambda: jobs.daily_counts(spark, source, target, state).awaitTermination(120)
    _land(spark, source, [(1, "time", at(1, 9)), (2, "time", at(1, 10)), (3, "place", at(1, 11)), (4, "time", at(2, 1))], schema)
    run()
    _land(spark, source, [(5, "time", at(1, 23)), (6, "time", at(9, 1))], schema)
    run()
    _land(spark, source, [(7, "time", at(1, 1))], schema)
    run()
    got = sorted((str(r.day), r.reason, r.n) for r in spark.read.parquet(target).collect())
    assert got == [("2026-09-01", "place", 1), ("2026-09-01", "time", 3), ("2026-09-02", "time", 1)]
