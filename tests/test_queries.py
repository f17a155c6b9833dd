"""Registered queries against their comparison SQL. All of them with TALLYSPARK_ALL=1, else one per family."""

import os
import re

import pytest

import __spark_entry__ as contract
from tools.compare import connect, table

SF = "/root/testdata/sf0.001"
# The corpus queries have tests of their own.
QUERIES, ORACLES = (
    {k: v for k, v in found.items() if not re.match(r"op\d+_|pipeline$", k)} for found in (contract.queries(), contract.oracle_sql()))
SAMPLE = ("g1_monthly_bill", "g19_spend_by_tag_key_month", "g21_spend_forecast_month", "g31_waste_summary_month",
          "g38_backing_storage_month", "g45_ai_endpoint_base", "m3_map_focus_to_bronze", "t8_efficiency_job", "t23_cluster_activity",
          "t29_table_workload_share", "a20_warehouse_cost_efficiency", "d19_cross_provider_movers", "k1_write_bill_window", "q1_query_view",
          "a14_idle_warehouses", "a16_hidden_waste_storage_all", "a18_hidden_waste_summary", "a34_warehouse_load_profile", "a37_leaderboard_snapshot",
          "d35_recoverable_by_provider_with_account", "d36_home_movers", "k3_write_efficiency", "k10_publish_gold", "m14_map_databricks_usage",
          "q3_run_select", "t25_query_patterns", "t30_table_inventory_rows")
NAMES = sorted(QUERIES) if os.environ.get("TALLYSPARK_ALL") else SAMPLE


def test_every_query_has_comparison_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", NAMES)
def test_matches(spark, name):
    df = QUERIES[name](spark, SF)
    con = connect(SF)
    rel = con.execute(ORACLES[name])
    want = table([d[0] for d in rel.description], rel.fetchall())
    assert table(df.columns, [tuple(r) for r in df.collect()]) == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_entry_runs(spark):
    assert contract.entry(spark).count() > 0
