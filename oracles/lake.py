"""Comparison SQL for scans, sinks and the catalog."""

from __future__ import annotations

import oracles.planes as planes
from oracles import spend, waste  # noqa: F401
from oracles.planes import fin
from tallyspark.operators.rules import BLOCKED_WASTE_RULES, WASTE_RULES
from tallyspark.sources import account_usage_tables, export_tables, telemetry_tables  # noqa: F401
from tallyspark.sources.driver_tables import PLANES

for _k, _v in PLANES.items():
    planes.CTES.setdefault(_k, _v)

_ID = ("invoice_id, resource_id, sku_id, charge_period_start, list_cost, billed_cost, consumed_quantity, pricing_category, charge_category, "
       "provider_name, service_name")
_UNIQ = f"(SELECT DISTINCT ON ({_ID}) * FROM bill)"


def totals(where: str) -> str:
    return fin(f"""SELECT x_source_connector, charge_month, count(*) AS n, sum(effective_cost) AS cost FROM {_UNIQ} WHERE {where} GROUP BY ALL""", "cost")


def n(keys: str, src: str, where: str = "true") -> str:
    return f"SELECT {keys}, count(*) AS n FROM {src} WHERE {where} GROUP BY ALL"


_EFF = "provider_name, x_source_connector, charge_month"
_RULES = ", ".join(
    [f"('{r.category}', '{r.lens}', true, '{dict(underutilized='underutilized_pct=20').get(r.category) or ('low_traffic_endpoint_requests=100' if r.category.startswith('endpoint_') else '')}')"
     for r in WASTE_RULES] + [f"('{r.category}', '{r.lens}', false, '')" for r in BLOCKED_WASTE_RULES])
_URLS = """SELECT DISTINCT CASE o_orderkey % 5 WHEN 0 THEN 's3://other/f' || k || '.parquet' WHEN 1 THEN 's3://bkt/exp/data/k' || k || '.parquet'
  WHEN 2 THEN 's3://bkt/exp/data/BILLING_PERIOD=' || m || '/r' || k || '.parquet' ELSE 's3://bkt/exp/x' || k || '.parquet' END AS url
FROM (SELECT o_orderkey, o_orderkey % 100 AS k, strftime(o_orderdate, '%Y-%m') AS m FROM orders) WHERE o_orderkey % 5 < 4 AND m BETWEEN '1996-02' AND '1997-05'"""
_COLS = ([("provider_name", "dimension", None, False, False), ("service_category", "dimension", None, False, False),
          ("service_name", "dimension", None, False, False), ("charge_month", "dimension", None, True, False)]
         + [(m, "measure", "currency", False, True) for m in ("net_cost", "gross_cost", "credit_cost", "list_cost", "savings")])
_CAT = ", ".join(f"('spend_by_service_month', '{c}', '{r}', {'NULL' if u is None else repr(u)}, {str(p).lower()}, {str(a).lower()})" for c, r, u, p, a in _COLS)

ORACLES = {
    "b1_scan_bill_export": fin("""SELECT ProviderName, ServiceName, CASE WHEN ServiceName = 'SQL' THEN 1 END AS Extra, count(*) AS n,
  sum(EffectiveCost::DECIMAL(20,6)) AS cost FROM focus_export WHERE ServiceName IN ('SQL', 'Amazon Redshift')
  AND ChargePeriodStart[1:4] IN ('1996', '1997', '1998') GROUP BY ALL""", "cost"),
    "b2_resolve_manifest_files": fin(_URLS),
    "b3_scan_csv_chunks": fin("SELECT sku_name, cloud, count(*) AS n, sum(usage_quantity) AS quantity FROM db_usage GROUP BY ALL", r="quantity"),
    "b4_scan_bronze_bill": totals("true"),
    "b5_scan_plane": fin("""SELECT provider_name, charge_month, serving_mode, count(*) AS n, 0 AS sized, sum(input_tokens) AS input_tokens
FROM ai_usage GROUP BY ALL""", big="sized input_tokens"),
    "b6_scan_driver_health": fin("""SELECT provider_name, charge_month, count(*) AS n, sum(query_count) AS query_count FROM driver_health GROUP BY ALL""", big="query_count"),
    "b7_scan_account_usage": fin("""SELECT service_type, entity_type, count(*) AS n, sum(credits_used) AS credits FROM au_metering_history GROUP BY ALL""", r="credits"),
    "b8_scan_turn_log": fin("""SELECT model, CASE WHEN total_tokens % 2 = 0 THEN route END AS route, count(*) AS n, sum(total_tokens) AS total_tokens,
  count(CASE WHEN total_tokens % 2 = 0 THEN execute_ms END) AS timed FROM turn_log GROUP BY ALL""", big="total_tokens"),
    "b9_scan_gold": fin("""SELECT provider_name, charge_month, sum(cost) AS net_cost, sum(cost) FILTER (WHERE NOT is_credit) AS gross_cost,
  sum(cost) FILTER (WHERE is_credit) AS credit_cost, bool_or(is_partial_period) AS is_partial_period FROM pbill WHERE provider_name = 'Databricks' GROUP BY ALL""",
        "net_cost gross_cost credit_cost"),
    "k1_write_bill_window": totals("NOT (provider_name = 'AWS' AND charge_month = '1997-06')"),
    "k2_purge_connector": totals("provider_name <> 'Snowflake'"),
    "k3_write_efficiency": fin(n(_EFF, "efficiency_flat", "NOT (provider_name = 'AWS' AND charge_month = '1997-06')")),
    "k4_repartition_legacy_metrics": fin(n(_EFF, "efficiency_flat")),
    "k5_write_monthly_planes": fin(n("provider_name, charge_month", "compute_instance")),
    "k6_write_storage_locations": fin(n("provider_name, snapshot_month, location_kind", "storage_location")),
    "k7_write_table_observability": fin("""SELECT cluster_id, observation_date, 'table_usage' AS record_kind, count(*) AS n, sum(c) AS query_count FROM (
  SELECT 'cl-' || (tbl % 3) AS cluster_id, strftime(starttime, '%Y-%m') AS observation_date, tbl, count(*) AS c FROM stl_scan GROUP BY ALL) GROUP BY ALL""", big="query_count"),
    "k8_write_policy_config": fin(n("provider_name, snapshot_month, encrypted", "policy_config")),
    "k9_write_account_usage": fin("""SELECT 'Snowflake' AS provider_name, strftime(start_time, '%Y-%m') AS charge_month, count(*) AS n, sum(credits_used) AS credits
FROM au_metering_history GROUP BY ALL""", r="credits"),
    "k10_publish_gold": fin("""
SELECT lower(provider_name) || '/monthly_bill' AS relation, count(DISTINCT charge_month) AS n FROM pbill GROUP BY provider_name
UNION ALL SELECT lower(provider_name) || '/spend_by_service_month', count(*) FROM (SELECT DISTINCT provider_name, service_category, service_name, charge_month FROM pbill) GROUP BY provider_name
UNION ALL SELECT 'efficiency/waste_summary_month', count(*) FROM (SELECT DISTINCT charge_month, waste_category, lens, confidence FROM findings)"""),
    "k11_discover_providers": fin("SELECT DISTINCT provider_name FROM bill"),
    "k12_provider_group": fin(n("trim(regexp_replace(lower(provider_name || '_' || service_name), '[^a-z0-9]+', '_', 'g'), '_') AS provider_group", "bill")),
    "k13_run_history": fin("SELECT run_id, connector, status, rows_written AS rows FROM run_log ORDER BY finished_at DESC, run_id, connector LIMIT 50"),
    "k13_run_groups": fin("""SELECT run_id, min(started_at)::DATE AS started_at, max(finished_at)::DATE AS finished_at, sum(rows_written) AS rows, count(*) AS connectors,
  CASE WHEN bool_or(status = 'failed') THEN 'failed' ELSE 'success' END AS status FROM run_log GROUP BY run_id ORDER BY max(run_log.finished_at) DESC, run_id LIMIT 20""", big="rows"),
    "q1_query_view": fin("""SELECT provider_name, service_category, service_name, charge_month, sum(cost) AS net_cost, sum(list_cost) AS list_cost
FROM pbill WHERE service_category = 'Analytics' AND provider_name IN ('AWS', 'Databricks') GROUP BY ALL""", "net_cost list_cost"),
    "q2_distinct_values": fin("SELECT DISTINCT service_name FROM pbill"),
    "q3_run_select": fin("SELECT provider_name, sum(cost) AS net FROM pbill GROUP BY 1", "net"),
    "q4_catalog": fin(f"""SELECT t.*, (SELECT count(*) FROM (SELECT DISTINCT provider_name, service_category, service_name, charge_month FROM pbill)) AS view_rows
FROM (VALUES {_CAT}) AS t(view, column_name, role, unit, is_period, is_additive)"""),
    "q5_list_rules": fin(f"""SELECT 'waste' AS pool, r.*, findings FROM (VALUES {_RULES}) AS r(category, lens, active, thresholds)
LEFT JOIN (SELECT waste_category AS category, count(*) AS findings FROM findings GROUP BY 1) USING (category)"""),
    "q6_load_thresholds": fin("SELECT charge_month, count(*) AS n FROM ent WHERE util <= 10 GROUP BY 1"),
}

# Every spend view read back from its publication equals the view itself.
from oracles.spend import ORACLES as _SPEND  # noqa: E402

ORACLES.update({f"b9_gold_{name.split('_', 1)[1]}": sql for name, sql in _SPEND.items()})
