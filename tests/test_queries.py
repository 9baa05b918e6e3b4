import pytest
from oracle import compare, connect

import __spark_entry__ as entry_module

SF_DIR = "/root/testdata/sf0.001"
SQL = entry_module.oracle_sql()
QUERIES = entry_module.queries()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    """Same rows as the SQL, bit by bit, and no plan that multiplies two tables."""
    result = QUERIES[name](spark, SF_DIR)
    assert compare(result, duck, SQL[name]) is None
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    assert entry_module.entry(spark).columns == ["user_id", "date_time", "y", "y_lag1", "y_lag2", "y_lag24", "lag_avg_1_5"]


def test_whole_domain_queries_take_every_cell_and_series(spark, duck):
    """The queries over one batch or five series have a counterpart over all customers and users."""
    n_cells, n_users = duck.execute("SELECT (SELECT count(*) FROM customer), (SELECT count(DISTINCT user_id) FROM events)").fetchone()
    assert QUERIES["retrieval_report_all"](spark, SF_DIR).collect()[0]["n_coords"] == n_cells > 50
    for name in ("retrieve_grid_all", "retrieve_grid_sim_all"):
        cells = QUERIES[name](spark, SF_DIR).select("x", "y").distinct().collect()
        assert {r["y"] * 16 + r["x"] for r in cells} - set(range(50, 100))
    assert QUERIES["prefill_forecast_users"](spark, SF_DIR).select("station_id").distinct().count() == n_users > 5
