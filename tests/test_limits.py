"""Windows that begin with a hit, over tables and streams, against a walk through each key's hits."""

import random
from datetime import datetime, timedelta

import pytest

from tessera.operators.limits import first_hit_limit
from tessera.streaming import jobs
from tessera.streaming import limits as stream

DAY = datetime(2024, 1, 1)
SCHEMA = "id long, user string, ts timestamp, allowed string"


def walked(rows, seconds, most):
    out, state = {}, {}
    for i, user, ts, _ in sorted((r for r in rows if r[1] is not None and r[2] is not None), key=lambda r: (r[2], r[0])):
        began, taken = state.get(user, (None, 0))
        if began is None or ts - began > timedelta(seconds=seconds):
            began, taken = ts, 0
        state[user] = began, taken + 1
        out[i] = taken + 1 <= most
    return out


def _rows(n, seed):
    r = random.Random(seed)
    users = ["a"] * 6 + list("bcdefg")
    return [(i, r.choice(users), DAY + timedelta(seconds=r.randrange(0, 400_000)), "x") for i in range(n)]


def test_midnight(spark):
    at = [datetime(2024, 1, 1, 23, 59), datetime(2024, 1, 1, 23, 59, 30), datetime(2024, 1, 2, 0, 0, 10)]
    rows = spark.createDataFrame([(i, "a", t, "") for i, t in enumerate(at)], SCHEMA).drop("allowed")
    assert [r["allowed"] for r in first_hit_limit(rows, "user", "ts", "id", 86_400, 2).orderBy("id").collect()] == [True, True, False]


@pytest.mark.parametrize(("seconds", "most"), [(3600, 2), (60, 1), (500_000, 3)])
def test_table(spark, seconds, most):
    rows = _rows(900, seconds)
    rows += [(2000 + i, "tie", DAY + timedelta(hours=i // 5), "") for i in range(40)]  # ties, and hits exactly an hour apart
    rows += [(3000, None, DAY, ""), (3001, "a", None, ""), (3002, None, None, "")]
    got = first_hit_limit(spark.createDataFrame(rows, SCHEMA).drop("allowed"), "user", "ts", "id", seconds, most)
    found = {r["id"]: r["allowed"] for r in got.collect()}
    assert found == walked(rows, seconds, most) | {3000: None, 3001: None, 3002: None}
    assert "Cartesian" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()


def test_empty(spark):
    assert first_hit_limit(spark.createDataFrame([], SCHEMA).drop("allowed"), "user", "ts", "id", 60, 1).collect() == []


def test_stream(spark, tmp_path):
    """Three runs over rows in order: the state goes on from one to the next, and gives what the table gives."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = sorted(_rows(300, 9), key=lambda r: r[2])
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    try:
        for part in (rows[:100], rows[100:200], rows[200:]):
            spark.createDataFrame(part, SCHEMA).drop("allowed").coalesce(1).write.mode("append").parquet(source)
            read = spark.readStream.schema("id long, user string, ts timestamp").parquet(source)
            jobs.write(stream.first_hit_limit(read, "user", "ts", "id", 3600, 2, "1 minute"), out, state).awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert {r["id"]: r["allowed"] for r in spark.read.parquet(out).collect()} == walked(rows, 3600, 2)
