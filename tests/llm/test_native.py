"""The operators marked native run no Python on executors, and none crosses tables."""

import pytest

from recollect.llm import queries


@pytest.mark.parametrize("name", ["op1_mix_sources", "op5_surrogates", "op10_license_scan"])
def test_native(spark, sf, name):
    text = queries.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in text for x in ("Python", "Pandas", "InArrow", "CartesianProduct", "BroadcastNestedLoopJoin"))
