"""Each query of the catalogue against its SQL in DuckDB, over the smallest tables."""

import datetime
import math

import duckdb
import pytest

from foliant.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return ""
    if isinstance(value, (datetime.date, str, bool)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return f"{float(value):.7g}"


@pytest.mark.parametrize("name", list(catalogue.SQL))
def test_query_equals_sql(spark, sf_dir, con, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    cur = con.execute(catalogue.SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    expected = sorted(tuple(plain(v) for v in row) for row in cur.fetchall())
    found = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert found == expected


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_runs(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())


def test_plans(spark, sf_dir):
    """What a query reads and filters reaches the scan."""
    plan = catalogue.QUERIES["oversized_docs"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    plan = catalogue.QUERIES["cascade_delete"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(toxic,1)" in plan
    plan = catalogue.QUERIES["image_topk"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
