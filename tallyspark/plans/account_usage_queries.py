"""Account-usage analytics over the derived source views."""

from __future__ import annotations

import datetime as dt

from tallyspark.operators import account_usage as au
from tallyspark.plans.registry import query
from tallyspark.sources import account_usage_tables as src
from tallyspark.sources import driver_tables

# Newest day of the derived metering history at every scale factor.
DAY = dt.date(2024, 1, 30)
START, END = "2023-08-01", "2023-12-31"


def _register(name, fn, needs_day=False, **params):
    def run(spark, sf):
        t = src.tables(spark, sf)
        return fn(t, DAY, **params) if needs_day else fn(t, **params)

    query(name)(run)


_register("a1_as_of", au.as_of)
_register("a2_kpi_summary", au.kpi_summary, True)
_register("a3_cost_breakdown", au.cost_breakdown, True)
_register("a4_ai_cost_breakdown", au.ai_cost_breakdown, True)
_register("a5_serverless_cost_breakdown", au.serverless_cost_breakdown, True)
_register("a6_top_tables_storage", au.top_tables_storage, n=25)
_register("a7_top_users_hidden_waste", au.top_users_hidden_waste, True, n=5)
_register("a6_top_tables_storage_all", au.top_tables_storage)
_register("a7_top_users_hidden_waste_all", au.top_users_hidden_waste, True)
_register("a8_tco_monthly_trend_and_forecast", au.tco_monthly_trend_and_forecast, True)
_register("a9_tco_by_month", au.tco_by_month, True)
_register("a10_top_users_daily_credits", au.top_users_daily_credits, True, n=10)
_register("a10_top_users_daily_credits_service", au.top_users_daily_credits, True, user_type="service", n=10)
_register("a10_top_users_daily_credits_adhoc", au.top_users_daily_credits, True, user_type="adhoc", n=10)
_register("a11_warehouse_daily_credits", au.warehouse_daily_credits, True, n=10)
for _grain in ("day", "week", "month", "year"):
    _register(f"a12_warehouse_spend_{_grain}", au.warehouse_spend_filtered, start=START, end=END, rollup=_grain)
_register("a13_warehouse_summary_filtered", au.warehouse_summary_filtered, start=START, end=END)
_register("a14_idle_warehouses", au.idle_warehouses)
_register("a14_idle_warehouses_filtered", au.idle_warehouses, start=START, end=END)
_register("a15_hidden_waste_compute", au.hidden_waste_compute, True)
_register("a16_hidden_waste_storage", au.hidden_waste_storage, n=50)
_register("a16_hidden_waste_storage_all", au.hidden_waste_storage)
_register("a17_hidden_waste_ai", au.hidden_waste_ai)
_register("a18_hidden_waste_summary", au.hidden_waste_summary, True)
_register("a19_queue_pressure", au.queue_pressure)
_register("a19_queue_pressure_filtered", au.queue_pressure, start=START, end=END)
_register("a20_warehouse_cost_efficiency", au.warehouse_cost_efficiency)
_register("a21_query_attributed_cost", au.query_attributed_cost, n=50)
_register("a21_query_attributed_cost_all", au.query_attributed_cost)
_register("a22_expensive_query_patterns", au.expensive_query_patterns, n=50)
_register("a23_cache_reuse_opportunity", au.cache_reuse_opportunity, n=50)
_register("a24_storage_trend", au.storage_trend)
_register("a25_top_tables", au.top_tables, n=30)
_register("a25_top_tables_all", au.top_tables)
_register("a26_unattributed_spend", au.unattributed_spend)
_register("a27_spend_by_warehouse", au.spend_by_warehouse)
_register("a27_spend_by_day", au.spend_by_day, start=START, end=END)
_register("a28_ai_spend_summary", au.ai_spend_summary, True)
_register("a28_ai_service_metering", au.ai_service_metering)
_register("a28_ai_spend_by_day", au.ai_spend_by_day)
_register("a29_ai_function_usage", au.ai_function_usage)
_register("a30_ai_search_daily", au.ai_search_daily)
_register("a31_serverless_optimization_spend", au.serverless_optimization_spend)
_register("a31_snowpipe_cost", au.snowpipe_cost)
_register("a31_serverless_task_costs", au.serverless_task_costs)
_register("a31_data_transfer_drivers", au.data_transfer_drivers)
_register("a32_executive_cost_trend", au.executive_cost_trend)
_register("a32_all_service_cost_profile", au.all_service_cost_profile)
_register("a32_cost_breakdown_monthly", au.cost_breakdown_monthly, True)
_register("a33_warehouse_cost_profile", au.warehouse_cost_profile)
_register("a34_warehouse_load_profile", au.warehouse_load_profile, True)
_register("a35_warehouse_heatmap", au.warehouse_heatmap, True, n=10)
_register("a36_top_warehouses_by_cost", au.top_warehouses_by_cost, n=10)


@query("a29_ai_function_usage_flat")
def _a29(spark, sf):
    flat = driver_tables.plane(spark, sf, "au_cortex_ai_functions_flat")
    return au.ai_function_usage({"cortex_ai_functions_usage_history": flat})


@query("a26_unattributed_spend_without_tags")
def _a26(spark, sf):
    return au.unattributed_spend(src.tables(spark, sf, "warehouse_metering_history"))


@query("a37_leaderboard_snapshot")
def _a37(spark, sf):
    from pyspark.sql import functions as F

    board = au.leaderboard_snapshot(src.tables(spark, sf))
    parts = [df.agg(F.lit(name).alias("frame"), F.count("*").alias("n")) for name, df in board.items()]
    return au.union_all(parts)
