"""Every query that has SQL, against DuckDB on the smallest tables."""

from __future__ import annotations

import math
from datetime import date

import duckdb
import pytest

from tripweave import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

KINDS = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return f"{float(value):.8g}"
    return str(value) if isinstance(value, (str, date)) else repr(value)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_agrees_with_its_sql(spark, sf_dir, con, name):
    found = con.execute(plans.SQL[name])
    columns = [c[0] for c in found.description]
    described = con.execute(f"describe {plans.SQL[name]}").fetchall()
    found = con.execute(plans.SQL[name])
    expected = sorted(tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in found.fetchall())
    df = plans.QUERIES[name](spark, sf_dir)
    kinds = {c[0]: KINDS[c[1]] for c in described}
    assert {f.name: f.dataType.simpleString() for f in df.schema} == kinds
    assert sorted(tuple(plain(r[c]) for c in sorted(columns)) for r in df.collect()) == expected


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_other_queries_give_rows(spark, sf_dir, name):
    assert plans.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(plans.QUERIES) <= set(__spark_entry__.queries())


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    from tripweave.sources import records

    df = records.filtered(spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_linenumber as YEAR", "l_tax as CANCELLED", "l_returnflag as OP_UNIQUE_CARRIER", "l_quantity"), 3, False, ("R",)).select("l_quantity")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_linenumber,3)" in plan and "l_extendedprice" not in plan
