from __future__ import annotations

import pytest
from conftest import SF, same

from civicspark.plans.entries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    same(QUERIES[name](spark, SF), duck, SQL[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_reach_the_scan(spark):
    plan = QUERIES["region_rollup"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "c_mktsegment" not in plan
