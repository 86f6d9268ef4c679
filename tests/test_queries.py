"""Every registered query against its SQL, and what their plans must not contain."""

import pytest

import __spark_entry__ as entry_module
from compare import differences

from caselake.checks.oracle import ORACLE_SQL as SQL
from caselake.checks.queries import QUERIES


def test_every_query_has_sql_and_is_registered():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry_module.queries()) and set(SQL) <= set(entry_module.oracle_sql())


NOT_IN_A_PLAN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas",
                 "FlatMapGroups")


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_sql(spark, con, sf_dir, name):
    """Same columns, types and values; no cross join and no Python in the plan."""
    df = QUERIES[name](spark, sf_dir)
    assert differences(df, con, SQL[name]) is None
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert [word for word in NOT_IN_A_PLAN if word in plan] == []


def test_comparison_sees_a_difference(spark, con, sf_dir):
    changed = SQL["daily_totals"].replace("sum(new_cases)", "sum(new_cases) + 1")
    assert "rows" in differences(QUERIES["daily_totals"](spark, sf_dir), con, changed)


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns[0] == "country_name" and df.count() == 10
