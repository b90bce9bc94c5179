"""Plan checks over every registered query: no Cartesian products, nested-loop joins or Python UDFs."""

import __spark_entry__ as E
from tidewell.plans.catalog import QUERIES

from .conftest import SF_SMALL


def test_no_cartesian_nested_loop_or_python(spark):
    bad = []
    for name, fn in QUERIES.items():
        plan = fn(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        for pat in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
            if pat in plan:
                bad.append((name, pat))
    assert bad == []


def test_scans_are_pruned_and_filtered(spark):
    df = E.queries()["g3_lineitem_by_status_year"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,R)]" in plan
    assert "ReadSchema: struct<l_extendedprice:double,l_returnflag:string,l_linestatus:string" in plan
