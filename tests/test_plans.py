"""Plan guards for every registered query: no cartesian products or
nested-loop joins, no Python evaluation in the plan, and pruned scans for
the flagship."""

import pytest

import __spark_entry__ as E
from clusterlens.plans.catalog import REGISTRY
from tests.conftest import SF_SMALL

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "MapInPandas", "FlatMapGroupsInPandas", "PythonUDF")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_plan_has_no_cross_join_or_python(spark, name):
    plan = _plan(REGISTRY[name](spark, SF_SMALL))
    assert not [op for op in FORBIDDEN if op in plan], plan[:2000]


def test_flagship_plan_shape(spark):
    df = E.entry(spark)
    plan = _plan(df)
    assert "TakeOrderedAndProject" in plan and "partial_count" in plan
    # only the text column (and the key used to spread a one-file table) is read
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in df._jdf.queryExecution().executedPlan().toString() \
        or "struct<doc_id:bigint,text:string>" in plan
