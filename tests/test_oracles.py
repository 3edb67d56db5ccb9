"""Every query that has SQL against DuckDB over the small tables, and the driver's contract."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from tessera import plans

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if value is None or value is pd.NaT or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, float):
        return float(f"{value:.9g}")
    return value.isoformat() if hasattr(value, "isoformat") else value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(([_plain(r[i]) for i in order] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query(spark, duck, name):
    found = plans.QUERIES[name](spark, FOLDER)
    asked = duck.execute(plans.SQL[name])
    columns = [c[0] for c in asked.description]
    assert sorted(found.columns) == sorted(columns)
    assert _rows(found.columns, found.collect()) == _rows(columns, asked.fetchall())


def test_contract(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns
