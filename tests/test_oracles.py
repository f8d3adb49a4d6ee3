"""Every registered query against its SQL on the smallest data set, and the shape of its plan."""

import pytest

import __spark_entry__ as entry
from compare import compare, duck
from promptledger.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SQL = ORACLES
# Python runs in these only: NFC, the user's scorer, and the ordered parts of limit replay.
PYTHON_ALLOWED = ("f1_", "f2_", "f3_", "h1_", "e2_", "e7_", "b4_", "b11_", "c11_", "c12_", "f21_")
STARTS_JOBS = ("g", "a17_", "e4_", "e7_")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_sql(spark, con, name):
    ok, message = compare(spark, con, SF, name, QUERIES[name], SQL[name])
    assert ok, message


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith(STARTS_JOBS)])
def test_plan_has_no_cross_join_and_no_stray_python(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    if not name.startswith(PYTHON_ALLOWED):
        assert "Python" not in plan and "MapInPandas" not in plan


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() == 6
