"""Source-telemetry operators over the raw telemetry planes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import databricks as db
from tallyspark.operators import redshift as rs
from tallyspark.operators import rules
from tallyspark.plans.registry import query
from tallyspark.sources import driver_tables as dt
from tallyspark.sources import telemetry_tables as tt

WINDOW = (tt.START, tt.END)
MONTH = "1997-03-01"


def _plane(name):
    return lambda spark, sf: dt.plane(spark, sf, name)


def priced(spark, sf):
    return db.priced_usage(tt.nested_usage(spark, sf), tt.nested_prices(spark, sf), *WINDOW)


def util(spark, sf):
    return db.node_utilization_month(tt.nested_nodes(spark, sf), *WINDOW)


def runs(spark, sf):
    return db.job_runs_month(dt.plane(spark, sf, "db_runs"), *WINDOW)


def stats(spark, sf):
    return db.warehouse_query_stats(tt.nested_history(spark, sf), *WINDOW)


def users(spark, sf):
    return db.warehouse_query_users(tt.nested_history(spark, sf), *WINDOW)


def entity_parts(spark, sf):
    p, jobs = db.usage_cube(priced(spark, sf)), dt.plane(spark, sf, "db_jobs")
    clusters, whs = tt.nested_clusters(spark, sf), tt.nested_warehouses(spark, sf)
    nodes = dt.plane(spark, sf, "db_node_types")
    u = util(spark, sf)
    return {
        "job": db.efficiency_job(p, u, runs(spark, sf), jobs, clusters, nodes),
        "interactive": db.efficiency_interactive(p, u, clusters, nodes, jobs),
        "sql_warehouse": db.efficiency_sql_warehouse(p, stats(spark, sf), whs),
        "sql_warehouse_user": db.efficiency_sql_warehouse_user(p, users(spark, sf), whs),
        "notebook": db.efficiency_notebook(p),
    }


@query("t1_price_window_join")
def _t1(spark, sf):
    keys = ["product", "sku_name", "charge_month"]
    return priced(spark, sf).groupBy(*keys).agg(
        F.count("*").alias("lines"), F.sum("cost").alias("cost"),
        F.sum("jobs_priced_cost").alias("jobs_priced_cost"), F.count("project").alias("tagged_lines"),
        F.count_if("photon").alias("photon_lines"))


query("t2_node_utilization_month")(util)
query("t3_job_runs_month")(runs)


@query("t4_latest_by_key_jobs")
def _t4a(spark, sf):
    return db.job_meta(dt.plane(spark, sf, "db_jobs"))


@query("t4_latest_by_key_clusters")
def _t4b(spark, sf):
    return db.cluster_meta(tt.nested_clusters(spark, sf))


@query("t4_latest_by_key_warehouses")
def _t4c(spark, sf):
    return db.warehouse_meta(tt.nested_warehouses(spark, sf))


@query("t5_interactive_job_slice")
def _t5(spark, sf):
    return db.interactive_job_slice(db.usage_cube(priced(spark, sf)))


query("t6_warehouse_query_stats")(stats)
query("t7_warehouse_query_users")(users)

for _n, _kind in enumerate(("job", "interactive", "sql_warehouse", "sql_warehouse_user", "notebook"), 8):
    query(f"t{_n}_efficiency_{_kind}")(lambda spark, sf, kind=_kind: entity_parts(spark, sf)[kind])


@query("t13_efficiency_union")
def _t13(spark, sf):
    records = db.efficiency_union(list(entity_parts(spark, sf).values()))
    return rules.unpack_cause_detail(records).select(
        "provider_name", "x_source_connector", "charge_month", "entity_type", "entity_id", "owner_user",
        F.round("billed_cost", 2).alias("billed_cost"), "native_unit", "activity_count", "photon",
        "query_count", "job_shaped_cost", "duration_share_pct", "warehouse_type",
        F.size(F.json_object_keys("cause_detail")).alias("cause_keys"))


def endpoint_cost(spark, sf):
    return db.endpoint_cost_month(tt.nested_usage(spark, sf), tt.nested_prices(spark, sf), *WINDOW)


def requests(spark, sf):
    return db.endpoint_requests_month(tt.nested_requests(spark, sf), *WINDOW)


def usage_rows(spark, sf):
    served = db.served_entities(tt.nested_served(spark, sf))
    return db.ai_usage_rows(requests(spark, sf), served, endpoint_cost(spark, sf))


query("t14_endpoint_cost_month")(endpoint_cost)
query("t15_endpoint_requests_month")(requests)
query("t16_ai_usage_rows")(usage_rows)


@query("t16_ai_usage_rows_without_entities")
def _t16(spark, sf):
    return db.ai_usage_rows(requests(spark, sf), None, endpoint_cost(spark, sf)).select(
        "endpoint_id", "serving_mode", "requester", "usage_context_project", "charge_month", "request_count",
        "input_tokens", "endpoint_billed_cost")


@query("t17_endpoint_efficiency")
def _t17(spark, sf):
    return db.endpoint_efficiency(usage_rows(spark, sf))


@query("t18_delta_table_inventory")
def _t18(spark, sf):
    return db.delta_table_inventory(dt.plane(spark, sf, "db_table_detail"), MONTH, 20)


@query("t19_compute_instance_month")
def _t19(spark, sf):
    return db.compute_instance_month(tt.nested_nodes(spark, sf), tt.nested_clusters(spark, sf),
                                     dt.plane(spark, sf, "db_jobs"), *WINDOW)


@query("t20_driver_health_databricks")
def _t20(spark, sf):
    return db.driver_health_month(tt.nested_history(spark, sf), *WINDOW)


@query("t21_driver_health_redshift")
def _t21(spark, sf):
    return rs.driver_health_month(dt.plane(spark, sf, "stl_connection_log"), *WINDOW)


@query("t22_driver_health_snowflake")
def _t22(spark, sf):
    return rs.snowflake_driver_health(dt.plane(spark, sf, "sf_queries"), dt.plane(spark, sf, "sf_sessions"), *WINDOW)


def activity(spark, sf, start=tt.START, end=tt.END):
    planes = [dt.plane(spark, sf, n) for n in
              ("stl_query", "svl_query_summary", "stl_wlm_query", "svcs_concurrency_scaling_usage")]
    return rs.cluster_activity(*planes, start, end)


@query("t23_cluster_activity")
def _t23(spark, sf):
    return activity(spark, sf).withColumn(
        "earliest_retained_query_ts", F.to_date("earliest_retained_query_ts"))


@query("t24_retention_ledger")
def _t24_ledger(spark, sf):
    logs = {"stl_query": "starttime", "stl_wlm_query": "queue_start_time", "svcs_concurrency_scaling_usage": "start_time"}
    return rs.retention_ledger({n: (dt.plane(spark, sf, n), c) for n, c in logs.items()}, "1997-03-01", "1997-03-31")


@query("t24_measurable_window")
def _t24(spark, sf):
    return rs.measurable_window(activity(spark, sf), *WINDOW)


def patterns(spark, sf):
    planes = [dt.plane(spark, sf, n) for n in ("stl_query", "stl_wlm_query", "svl_query_report", "pg_user")]
    return rs.query_patterns(
        *planes, *WINDOW, min_seconds=30, top_n=200, prefix=160, context_header=(102, "-- Looker Query Context", 144))


@query("t25_query_patterns")
def _t25(spark, sf):
    return patterns(spark, sf).withColumn("last_seen_at", F.to_date("last_seen_at"))


def user_activity(spark, sf, top_n=50):
    planes = [dt.plane(spark, sf, n) for n in
              ("stl_query", "svl_query_metrics_summary", "svl_query_report", "pg_user")]
    return rs.user_activity(*planes, *WINDOW, compute_cost=1000.0, top_n=top_n)


query("t26_user_activity")(user_activity)
query("t26_user_activity_all")(lambda spark, sf: user_activity(spark, sf, top_n=None))


def spectrum(spark, sf):
    return rs.spectrum_table_usage(dt.plane(spark, sf, "svl_s3query_summary"), *WINDOW)


query("t27_spectrum_table_usage")(spectrum)


@query("t28_allocate_spectrum_cost")
def _t28(spark, sf):
    return rs.allocate_spectrum_cost(spectrum(spark, sf), 500.0, True)


@query("t28_allocate_spectrum_cost_partial_window")
def _t28b(spark, sf):
    return rs.allocate_spectrum_cost(spectrum(spark, sf), 500.0, False)


def workload(spark, sf):
    return rs.table_workload_share(dt.plane(spark, sf, "stl_scan"), dt.plane(spark, sf, "stl_wlm_query"), *WINDOW)


@query("t29_table_workload_share", 2)
def _t29(spark, sf):
    return workload(spark, sf).withColumn("last_access_at", F.to_date("last_access_at"))


def inventory(spark, sf):
    return rs.table_inventory_rows(
        dt.plane(spark, sf, "svv_table_info"), workload(spark, sf), dt.plane(spark, sf, "pg_tables"),
        "2001-12-31", "main", MONTH)


query("t30_table_inventory_rows", {"table_weighted_exec_seconds": 2})(inventory)


def cost_breakdown(spark, sf):
    lines = dt.bill(spark, sf, ("service_name", "resource_id", "charge_month", "charge_period_start",
                                "x_cost_subcategory", "effective_cost"))
    return rs.cluster_cost_breakdown(lines, *WINDOW)


def reserved(spark, sf):
    return rs.reserved_coverage(dt.plane(spark, sf, "cluster_inventory"), dt.plane(spark, sf, "reserved_inventory"))


def capacity(spark, sf):
    return rs.capacity_metrics(dt.plane(spark, sf, "metric_points"), "1997-01-01", "1997-03-31")


query("t31_cluster_cost_breakdown")(cost_breakdown)
query("t32_reserved_coverage")(reserved)
query("t33_capacity_metrics")(capacity)


@query("t34_redshift_cluster_row")
def _t34(spark, sf):
    measured = rs.measurable_window(activity(spark, sf), *WINDOW)
    return rs.redshift_cluster_row(measured, cost_breakdown(spark, sf), reserved(spark, sf), capacity(spark, sf), MONTH)


@query("t35_table_usage_daily")
def _t35(spark, sf):
    daily = rs.table_usage_daily(dt.plane(spark, sf, "stl_scan"), *WINDOW)
    return daily.withColumn("first_scan_at", F.to_date("first_scan_at")).withColumn(
        "last_scan_at", F.to_date("last_scan_at"))


@query("t36_external_query_daily")
def _t36(spark, sf):
    return rs.external_query_daily(dt.plane(spark, sf, "sys_external_query_detail"), *WINDOW)


@query("t37_external_table_catalog")
def _t37(spark, sf):
    stamp = F.lit("2001-06-01").cast("date")
    return rs.external_table_catalog(dt.plane(spark, sf, "svv_external_tables"), stamp)


@query("t38_s3_tiering_signal")
def _t38(spark, sf):
    lines = dt.bill(spark, sf, ("service_name", "resource_id", "resource_name", "charge_month", "sku_id",
                                "charge_period_start", "charge_description", "billed_cost"))
    return rs.s3_tiering_signal(lines, *WINDOW)


@query("t39_policy_config_snapshot")
def _t39(spark, sf):
    return rs.policy_config_snapshot(
        dt.plane(spark, sf, "cluster_inventory"), dt.plane(spark, sf, "parameter_inventory"), "2001-06")
