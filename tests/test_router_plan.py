"""The router looks a league's metrics up once for each league, not once for each use in each row."""

from touchline import catalog


def test_rows_hold_no_lookups_of_metrics(spark, sf_dir):
    found = catalog.queries()["d07_market_router"](spark, sf_dir)
    assert "element_at(metrics" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.limit(5).count() == 5
