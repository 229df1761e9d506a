import __spark_entry__ as entry
import pytest
from compare import differences, duck
from sensorloom.plans import agent_queries, fusion_queries, learning_queries, score_queries, stream_queries  # noqa: F401
from sensorloom.plans import queries as plans

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_sql(spark, con, name):
    assert differences(plans.QUERIES[name](spark, SMALL), con, plans.ORACLES[name]) == ""


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_have_no_python_or_single_window(spark):
    for name in ("sampling_rate_by_stream", "asof_nearest", "rolling_median_smooth", "combine_first_merge"):
        plan = plans.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "Python" not in plan and "SinglePartition" not in plan, name
