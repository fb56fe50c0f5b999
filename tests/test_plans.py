"""Plan shape: no cross products or row-at-a-time Python in any registered
query, column pruning and one shuffle for the fused checks."""

import pytest

from assay.plans import registry
from paths import SF_SMALL

registry.load_all()
BATCH = sorted(n for n in registry.QUERIES if not n.startswith(("stream_", "io_", "prof_output", "prof_schema")))


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_cross_product_or_row_python(spark, name):
    plan = _plan(registry.QUERIES[name](spark, SF_SMALL))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in plan, (name, bad)


def test_range_check_prunes_and_fuses(spark):
    df = registry.QUERIES["chk_range"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "l_returnflag" in plan and "l_quantity" in plan
    assert "l_extendedprice" not in plan and "l_orderkey" not in plan
    assert plan.count("Exchange") <= 1


def test_uniqueness_one_shuffle_for_all_columns(spark):
    df = registry.QUERIES["chk_unique_groups"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [pos") == 2  # one per table, all columns of a table together
