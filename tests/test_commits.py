"""Guarded commits, deliveries, rows apart by time and resumable batches: writers that die at each step, and rows out of order."""

from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.operators import sinks
from tessera.streaming import apart, jobs
from tessera.streaming.commits import Ledger, Marks, deliver, inserted, keep_up

SCHEMA = "id long, value string"


class Killed(Exception):
    pass


@pytest.fixture
def ledger(spark, tmp_path):
    return Ledger(spark, str(tmp_path / "ledger"), SCHEMA, ["id"], 4)


def _frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema).coalesce(1)


def _all(frame):
    return sorted(map(tuple, frame.collect()))


def _upsert(stored, incoming):
    return sinks.upserted(stored, incoming, ["id"])


def test_two_writers(spark, ledger):
    """The one that comes second merges anew, so both changes stay."""
    ledger.change(_frame(spark, [(1, "a"), (2, "a")]), _upsert)
    calls = []

    def slow(stored, incoming):
        calls.append(1)
        if len(calls) == 1:
            ledger.change(_frame(spark, [(2, "other"), (3, "other")]), _upsert)
        return stored.unionByName(incoming.join(stored.select("id"), "id", "left_anti"))

    assert ledger.change(_frame(spark, [(2, "late"), (3, "late"), (4, "late")]), slow)
    assert len(calls) == 2
    assert _all(ledger.read()) == [(1, "a"), (2, "other"), (3, "other"), (4, "late")]
    before = ledger.read().count()
    ledger.clean()
    assert ledger.read().count() == before
    assert not Marks(spark, f"{ledger.path}/commits").put(0, {})


def test_changes_nothing(spark, ledger):
    assert ledger.read().collect() == []
    ledger.change(_frame(spark, []), _upsert)
    ledger.change(_frame(spark, [(1, "a"), (None, "n")]), _upsert)
    ledger.change(_frame(spark, [(1, "b")]), lambda stored, incoming: stored.join(incoming, "id", "left_anti"))
    assert _all(ledger.read()) == [(None, "n")]


@pytest.mark.parametrize("when", ["before the rows", "before the marker", "after the marker"])
def test_stream_killed(spark, ledger, tmp_path, monkeypatch, when):
    """A run that dies around a commit brings each batch in once, when it goes on."""
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    # counts rows instead of replacing them, so that a batch that is merged twice shows
    def add(stored, incoming):
        if when == "before the rows" and armed and incoming.where("id = 3").count():
            armed.clear()
            raise Killed
        both = stored.unionByName(incoming).groupBy("id").agg(F.sum(F.col("value").cast("int")).cast("string").alias("value"))
        return both.select("id", "value")

    armed, put = [1], Marks.put

    def failing(self, n, said):
        if armed and when != "before the rows" and "streams" in said and n == 1:
            armed.clear()
            if when == "after the marker":
                put(self, n, said)
            raise Killed
        return put(self, n, said)

    monkeypatch.setattr(Marks, "put", failing)
    for part in ([(1, "1"), (2, "1")], [(2, "1"), (3, "1")], [(3, "1"), (4, "1")]):
        _frame(spark, part).write.mode("append").parquet(source)
        for _ in range(2):
            read = spark.readStream.schema(SCHEMA).parquet(source)
            try:
                keep_up(read, ledger, "s", add, state).awaitTermination()
            except Exception:
                assert not armed
    assert _all(ledger.read()) == [(1, "1"), (2, "2"), (3, "2"), (4, "1")]


def test_known_keys_across_runs(spark, ledger, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    for part in ([(1, "first"), (1, "first"), (None, "none")], [(1, "again"), (2, "new")]):
        _frame(spark, part).write.mode("append").parquet(source)
        keep_up(spark.readStream.schema(SCHEMA).parquet(source), ledger, "s", lambda s, i: inserted(s, i, ["id"]), state).awaitTermination()
    assert [r for r in _all(ledger.read().where("id IS NOT NULL"))] == [(1, "first"), (2, "new")]


def _outbox(spark, tmp_path, n=6):
    box = Ledger(spark, str(tmp_path / "outbox"), "id long, state string, leased timestamp, worker string", ["id"], 4)
    rows = spark.range(n).select("id", F.lit("queued").alias("state"), F.lit(None).cast("timestamp").alias("leased"), F.lit(None).cast("string").alias("worker"))
    box.change(rows, lambda s, i: inserted(s, i, ["id"]))
    return box


def test_delivery(spark, tmp_path):
    """A run dies with its claims, another one goes on: nothing is sent twice, and what may have been sent is left alone."""
    box, log = _outbox(spark, tmp_path), str(tmp_path / "log")

    def send(rows):
        rows.select("id").write.mode("append").json(log)
        return rows.select("id", (F.col("id") != 1).alias("ok"))

    def dies(rows):
        rows.select("id").write.mode("append").json(log)
        raise Killed

    with pytest.raises(Killed):
        deliver(box, "a", "2024-01-01 00:00:00", 120, dies, 2)
    deliver(box, "b", "2024-01-01 00:01:00", 120, send, 3)
    state = {r["id"]: r["state"] for r in box.read().collect()}
    assert state == {0: "publishing", 1: "publishing", 2: "sent", 3: "sent", 4: "sent", 5: "queued"}
    deliver(box, "c", "2024-01-01 00:05:00", 120, send, 10)
    state = {r["id"]: r["state"] for r in box.read().collect()}
    assert state == {0: "uncertain", 1: "uncertain", 2: "sent", 3: "sent", 4: "sent", 5: "sent"}
    sent = [r["id"] for r in spark.read.json(log).collect()]
    assert sorted(sent) == [0, 1, 2, 3, 4, 5]
    deliver(box, "d", "2024-01-01 00:06:00", 120, send, 10)
    assert spark.read.json(log).count() == 6


def test_failed_delivery_is_tried_again(spark, tmp_path):
    box = _outbox(spark, tmp_path, 2)
    for ok, state in ((False, "failed"), (True, "sent")):
        deliver(box, "a", "2024-01-01 00:00:00", 120, lambda rows, ok=ok: rows.select("id", F.lit(ok).alias("ok")), 10)
        assert {r["state"] for r in box.read().collect()} == {state}


def test_apart(spark, tmp_path, monkeypatch):
    """Late, old, future and undated rows, in a run that dies between rows and marker: each in its table, once."""
    start = datetime(2024, 1, 10, tzinfo=UTC)
    schema, clock = "id long, ts timestamp", lambda: start + timedelta(hours=1)
    hours = lambda *h: [start + timedelta(hours=x) if x is not None else None for x in h]
    parts = [hours(0, -5, 1, 9, None), hours(-1, 0.5, -3, -24 * 31), hours(1, None, -2.5, 4, -0.5)]
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    armed, put = [1], Marks.put

    def failing(self, n, said):
        if armed and n == 1:
            armed.clear()
            raise Killed
        return put(self, n, said)

    monkeypatch.setattr(Marks, "put", failing)
    wanted, newest, k = {s: set() for s in apart.SIDES}, None, 0
    for part in parts:
        rows = [(k + i, t) for i, t in enumerate(part)]
        k += len(rows)
        _frame(spark, rows, schema).write.mode("append").parquet(source)
        seen = newest
        for i, t in rows:
            if t is None:
                side = "undated"
            elif t > clock() + timedelta(hours=2):
                side = "future"
            elif t < clock() - timedelta(days=30):
                side = "too_old"
            elif seen is not None and t < seen - timedelta(hours=2):
                side = "late"
            else:
                side = "in_time"
                newest = max(t, newest or t)
            wanted[side].add(i)
        for _ in range(2):
            try:
                apart.split(spark.readStream.schema(schema).parquet(source), "ts", out, state, "2 hours", "2 hours", "30 days", clock).awaitTermination()
            except Exception:
                assert not armed
    assert all(wanted.values())
    assert {s: {r["id"] for r in apart.table(spark, out, s, schema).collect()} for s in apart.SIDES} == wanted
    assert apart.counted(spark, out) == {s: len(x) for s, x in wanted.items()}


def test_batches_resume(spark, ledger, tmp_path):
    """One file a batch; a run dies in its third batch, the next one goes on with it."""
    source, state, seen = str(tmp_path / "in"), str(tmp_path / "state"), []
    for i in range(5):
        _frame(spark, [(i, "x")]).write.mode("append").parquet(source)

    def apply(batch, number):
        if len(seen) == 2:
            seen.append(-1)
            raise Killed
        ledger.change(batch, lambda s, i: s.unionByName(i), "intake", number)
        seen.append(number)

    read = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    with pytest.raises(Exception, match="Killed"):
        jobs.in_batches(read(), apply, state, 100)
    assert ledger.read().count() == 2
    assert jobs.in_batches(read(), apply, state, 100)
    assert seen == [0, 1, -1, 2, 3, 4]
    assert _all(ledger.read()) == [(i, "x") for i in range(5)]
