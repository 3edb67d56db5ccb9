"""Streams in two runs against the same rows as one table."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tessera.streaming import jobs

SCHEMA = "id long, user long, ts timestamp"
START = datetime(2024, 1, 1)


def _rows(n, begin=0):
    return [(k, k % 5, START + timedelta(minutes=7 * k)) for k in range(begin, begin + n)]


def _run(spark, tmp_path, make):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for part in (_rows(60), _rows(60, 60), [(10_000, 1, START + timedelta(days=9))]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        jobs.write(make(spark.readStream.schema(SCHEMA).parquet(source)), out, state).awaitTermination()
    return spark.read.parquet(out)


def test_first_seen_across_runs(spark, tmp_path):
    got = _run(spark, tmp_path, lambda s: jobs.first_seen(s.withColumn("key", F.col("id") % 80), ["key"], "ts", "2 days"))
    assert sorted(r["key"] for r in got.where("id < 10000").collect()) == list(range(80))


def test_windows(spark, tmp_path):
    got = _run(spark, tmp_path, lambda s: jobs.windowed(s, "ts", "1 hour", "2 hours", ["user"], last=F.max("id")))
    table = jobs.windowed(spark.createDataFrame(_rows(120), SCHEMA), "ts", "1 hour", "2 hours", ["user"], last=F.max("id"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, table.collect()))


def test_sessions(spark, tmp_path):
    got = _run(spark, tmp_path, lambda s: jobs.sessions(s, "user", "ts", "36 minutes", "1 hour"))
    table = jobs.sessions(spark.createDataFrame(_rows(120), SCHEMA), "user", "ts", "36 minutes", "1 hour")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, table.collect()))
