"""Edges are dealt to tasks before they are told apart."""

import pytest

from cartulary import plans


@pytest.mark.parametrize("name, exchanges", [("mat_relationship_edges", 2), ("mat_merge", 1), ("mat_mappings", 1)])
def test_no_split_is_held(spark, name, exchanges):
    df = plans.queries()[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("Aggregate(") < plan.rindex("Exchange hashpartitioning"), plan
    assert plan.count("REPARTITION_BY_NUM") >= exchanges, plan
