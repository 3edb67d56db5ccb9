"""Sinks that write files."""

from tessera.operators import sinks


def test_csv_round_trip(spark, tmp_path):
    rows = [(1, 'a "quoted", b'), (2, "two\nlines"), (3, None)]
    path = str(tmp_path / "out")
    sinks.save(spark.createDataFrame(rows, "k int, v string").coalesce(1), path, "csv")
    sinks.save(spark.createDataFrame([(4, "x")], "k int, v string"), path, "csv")
    back = spark.read.csv(path, header=True, schema="k int, v string", quote='"', escape='"', multiLine=True)
    assert sorted((r["k"], r["v"]) for r in back.collect()) == [*rows, (4, "x")]


def test_upsert_and_delete(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    assert sorted(map(tuple, sinks.upserted(stored, new, ["k"]).collect()), key=str) == sorted([(1, "a"), (2, "B"), (None, "c"), (3, "C")], key=str)
    assert sorted(map(tuple, sinks.changed(stored, stored.union(new), "k", ["v"]).collect()), key=str) == sorted([(2, "B"), (3, "C"), (None, "c")], key=str)
