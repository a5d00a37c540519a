"""Registered queries against their SQL on the smallest given tables."""

import duckdb
import pytest

from suite.check import TABLES, canonical
from suite.registry import all_queries
from tests.conftest import SMALL

QUERIES = all_queries()
CHOSEN = [
    "stg_quarantine", "dim_product", "dim_product_snapshot", "dim_date", "fct_order", "fct_inventory_movement", "fct_availability_hour",
    "fct_price_history", "agg_intraday_arrival_curve", "agg_store_sku_day", "mart_customer_360", "mart_cohort_retention", "dq_source_coverage",
    "q01_running_inventory_balance", "q02_fefo_allocation", "q04_browse_bursts", "q05_stockout_runs", "q06_market_basket", "q12_point_in_time_margin",
    "q15_inventory_reconciliation", "metric_gm_awm", "n02_backtest", "n04_feature_frame", "n10_expiry_risk", "n12_elasticity_panel",
    "n35_event_panel", "n42_qini", "n45_did_estimate", "g_raw_gate_figures", "n52_velocity",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.filterwarnings("ignore")
@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_its_sql(spark, con, name):
    query = QUERIES[name]
    got, want = canonical(query.run(spark, SMALL).toPandas()), canonical(con.execute(query.sql).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    assert got.equals(want)


def test_every_query_has_a_unique_shape():
    assert len(QUERIES) > 150
    for name, query in QUERIES.items():
        assert query.cols and len({c for c, _ in query.cols}) == len(query.cols), name
