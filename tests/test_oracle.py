"""Every registered query against the same query in DuckDB."""

from __future__ import annotations

import os

import pytest
from oracle_check import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

SF_DIR = f"/root/testdata/{os.environ.get('ORACLE_SF', 'sf0.001')}"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_an_oracle():
    assert {n for n in queries() if not n.startswith(("op", "pipeline"))} <= set(oracle_sql())


def test_entry(spark):
    rows = {r["outcome"]: r["n"] for r in entry(spark).collect()}
    assert rows == {"ok": 200}


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, duck, name):
    df = queries()[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert compare(df, duck, oracle_sql()[name]) is None
