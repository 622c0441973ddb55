"""Every query against its SQL in DuckDB, over the smallest given tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points
from fillwright.plans import catalogue

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(row[i] for i in order) for row in rows]
    return sorted(columns), sorted(picked, key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, db, name):
    df = catalogue.QUERIES[name](spark, SF_DIR)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = db.execute(catalogue.ORACLES[name])
    want = _rows([c[0] for c in cursor.description], cursor.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1]) > 0
    assert got[1] == want[1]
    plan = df._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert unwanted not in plan


def test_entry(spark):
    row = entry_points.entry(spark).first()
    # 200 documents from id 0 on, and every third prediction is wrong
    assert (row.n, row.correct) == (200, 134)
