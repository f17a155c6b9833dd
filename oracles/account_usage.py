"""Comparison SQL for account-usage analytics."""

from __future__ import annotations

import oracles.planes as planes
from oracles.planes import add, fin
from tallyspark.operators import account_usage as au
from tallyspark.sources import account_usage_tables  # noqa: F401  (adds its planes)
from tallyspark.sources.driver_tables import PLANES

for _k, _v in PLANES.items():
    planes.CTES.setdefault(_k, _v)


def names(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


AIW, AIS = names(au.AI_WAREHOUSES), names(au.AI_SERVICES)
KPIS, SVL, STO = names(au.KPI_SERVERLESS), names(au.SERVERLESS_SERVICES), names(au.STORAGE_SERVICES)
WMH, MH, QH, QA = "au_warehouse_metering_history", "au_metering_history", "au_query_history", "au_query_attribution_history"
M0 = "start_time >= TIMESTAMP '2024-01-01'"
D30 = "start_time >= TIMESTAMP '2023-12-31'"
D21 = "start_time >= TIMESTAMP '2024-01-09'"
RANGE = "start_time >= TIMESTAMP '2023-08-01' AND start_time < TIMESTAMP '2024-01-01'"
CC = "round(c::DOUBLE, 2) AS credits, round(c::DOUBLE * 4, 2) AS cost_usd"
LAST = "(SELECT {0} FROM au_storage_usage ORDER BY usage_date DESC LIMIT 1)"
TB = "1099511627776.0::DOUBLE"
GB = "1073741824.0::DOUBLE"
CAT = (f"CASE WHEN service_type = 'DATA_TRANSFER' THEN 'Data Transfer' WHEN service_type IN {STO} THEN 'Storage' "
       f"WHEN service_type IN {SVL} THEN 'Serverless Compute' WHEN service_type IN {AIS} THEN 'AI & ML' ELSE 'Other' END")
WCAT = f"CASE WHEN warehouse_name IN {AIW} THEN 'AI & ML' ELSE 'Managed Compute' END"


def total(table: str, where: str) -> str:
    return f"(SELECT coalesce(sum(credits_used), 0)::DOUBLE FROM {table} WHERE {where})"


def title(c: str) -> str:
    return (f"list_aggregate(list_transform(string_split(lower({c}), '_'), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ')")


add("hwc", f"""
SELECT warehouse_name, CASE WHEN ifnull(r, 0) < 0.10 THEN 'idle_running' ELSE 'oversized' END AS waste_type,
  round(c * (1 - ifnull(r, 0)), 1) AS idle_hours, round(c * 4, 2) AS actual_cost_usd, round(c * ifnull(1 - r, 0.5), 2) AS wasted_credits,
  round(c * ifnull(1 - r, 0.5) * 4, 2) AS wasted_cost_usd,
  CASE WHEN ifnull(r, 0) < 0.10 THEN 'Enable auto-suspend (60s); consider X-Small for dev'
    ELSE 'Scale down warehouse size; review concurrent usage' END AS recommendation, ifnull(sz, 'UNKNOWN') AS size
FROM (SELECT warehouse_name, sum(credits_used)::DOUBLE AS c FROM {WMH} WHERE {D30} GROUP BY 1 HAVING sum(credits_used) >= 10)
LEFT JOIN (SELECT warehouse_name, sum(avg_running::DECIMAL(18, 6))::DOUBLE / count(avg_running) AS r FROM au_warehouse_load_history WHERE {D30} GROUP BY 1) USING (warehouse_name)
LEFT JOIN (SELECT warehouse_name, (array_agg(warehouse_size ORDER BY start_time DESC, warehouse_size DESC))[1] AS sz FROM {QH}
  WHERE {D30} AND warehouse_size IS NOT NULL GROUP BY 1) USING (warehouse_name) WHERE ifnull(r, 0) < 0.5""")
add("hws", f"""
SELECT concat_ws('.', table_catalog, table_schema, table_name) AS object_name,
  CASE WHEN failsafe_bytes > active_bytes THEN 'failsafe_excess' WHEN time_travel_bytes > active_bytes THEN 'time_travel_excess' ELSE 'stale_data' END AS waste_type,
  round((time_travel_bytes + failsafe_bytes) / {GB}, 2) AS size_gb, NULL::BIGINT AS days_since_access,
  round((time_travel_bytes + failsafe_bytes) / {TB} * 23, 2) AS monthly_cost_usd, round((time_travel_bytes + failsafe_bytes) / {TB} * 23, 2) AS actual_cost_usd,
  'Review data retention policy; shorten time-travel window' AS recommendation
FROM au_table_storage_metrics WHERE table_name IS NOT NULL AND time_travel_bytes + failsafe_bytes > 1073741824
""")
add("uwh", f"""SELECT user_name, warehouse_name, sum(credits_attributed_compute)::DOUBLE AS c FROM {QH} q
  JOIN (SELECT query_id, credits_attributed_compute FROM {QA}) a USING (query_id) WHERE {D30} GROUP BY ALL""")
add("tco", f"""
WITH m AS (SELECT date_trunc('month', start_time)::DATE AS month, sum(credits_used)::DOUBLE AS c FROM
   (SELECT start_time, credits_used FROM {WMH} UNION ALL SELECT start_time, credits_used FROM {MH})
   WHERE start_time >= TIMESTAMP '2023-07-01' AND start_time < TIMESTAMP '2024-01-01' GROUP BY 1),
 a AS (SELECT month, c AS total_credits, (c * 4 + 23 * {LAST.format(f'round((storage_bytes + stage_bytes + failsafe_bytes) / {TB}, 2)')})
   * (30.0::DOUBLE / day(last_day(month))) AS tco, row_number() OVER (ORDER BY month) - 1 AS x FROM m),
 l AS (SELECT regr_slope(tco, x) AS b, regr_intercept(tco, x) AS a0, max(month) AS mm, count(*) AS n FROM a)
SELECT month, total_credits, tco, 'Actual' AS type FROM a
UNION ALL SELECT (mm + to_months(i::INT))::DATE, 0, greatest(a0 + b * (n - 1 + i), 0), 'Forecast' FROM l, range(1, 7) AS g(i)""")


def daily_users(cond: str) -> str:
    return f"""
WITH d AS (SELECT user_name, start_time::DATE AS usage_date, sum(credits_attributed_compute)::DOUBLE AS daily_credits
  FROM {QH} JOIN (SELECT query_id, credits_attributed_compute FROM {QA}) USING (query_id)
  WHERE {D21} AND credits_attributed_compute > 0 AND {cond} GROUP BY ALL)
SELECT * FROM d WHERE user_name IN (SELECT user_name FROM d GROUP BY 1 ORDER BY sum(daily_credits) DESC, user_name LIMIT 10)"""


def spend(key: str, table: str = WMH, where: str = "warehouse_id > 0") -> str:
    return f"SELECT * EXCLUDE (c), {CC} FROM (SELECT {key}, sum(credits_used) AS c FROM {table} WHERE {where} GROUP BY ALL)"


def idle(where: str) -> str:
    return f"""
SELECT warehouse_name AS object_name, {CC}, round(ifnull(r, 0), 3) AS avg_running, round(ifnull(q, 0), 3) AS avg_queued_load,
  CASE WHEN c >= 100 AND ifnull(r, 0) < 0.15 THEN 'BLOCKER' WHEN c >= 25 AND ifnull(r, 0) < 0.3 THEN 'WARN' ELSE 'INFO' END AS severity
FROM (SELECT warehouse_name, sum(credits_used) AS c FROM {WMH} WHERE warehouse_id > 0 AND {where} GROUP BY 1)
LEFT JOIN (SELECT warehouse_name, sum(avg_running::DECIMAL(18, 6))::DOUBLE / count(avg_running) AS r, sum(avg_queued_load::DECIMAL(18, 6))::DOUBLE / count(avg_queued_load) AS q FROM au_warehouse_load_history WHERE {where} GROUP BY 1)
  USING (warehouse_name) WHERE c >= 10"""


def queue(where: str) -> str:
    return f"""SELECT warehouse_name AS object_name, round(sum(queued_overload_time)::DOUBLE / 1000, 1) AS queued_seconds, count(*) AS queries
FROM {QH} WHERE warehouse_name IS NOT NULL AND {where} GROUP BY 1 HAVING sum(queued_overload_time) > 0"""


def board() -> str:
    parts = []
    for frame, key in (("kpi_summary", "a2_kpi_summary"), ("cost_breakdown", "a3_cost_breakdown"),
                       ("ai_cost_breakdown", "a4_ai_cost_breakdown"), ("serverless_cost_breakdown", "a5_serverless_cost_breakdown"),
                       ("top_tables_storage", "a6_top_tables_storage_all"), ("top_users_hidden_waste", "a7_top_users_hidden_waste_all"),
                       ("tco_trend", "a8_tco_monthly_trend_and_forecast"), ("hidden_waste_compute", "a15_hidden_waste_compute"),
                       ("hidden_waste_storage", "a16_hidden_waste_storage_all"), ("hidden_waste_ai", "a17_hidden_waste_ai"),
                       ("hidden_waste_summary", "a18_hidden_waste_summary"), ("ai_spend_summary", "a28_ai_spend_summary"),
                       ("cost_breakdown_monthly", "a32_cost_breakdown_monthly")):
        parts.append(f"SELECT '{frame}' AS frame, count(*) AS n FROM ({ORACLES[key]})")
    return "\nUNION ALL\n".join(parts)


_TBL = "concat_ws('.', table_catalog, table_schema, table_name)"
ORACLES = {
    "a1_as_of": fin(f"SELECT max(start_time)::DATE AS as_of FROM {WMH}"),
    "a2_kpi_summary": fin(f"""
SELECT round(w + s, 0) AS total_credits, round((w + s) * 4 + round(tb * 23, 0), 0) AS total_cost, round((w - ai) * 4, 0) AS compute_cost,
  round(sv * 4, 0) AS serverless_compute_cost, 'January 2024' AS month_label,
  (SELECT count(DISTINCT warehouse_name) FROM {WMH}) AS warehouses, (SELECT count(*) FROM {QH} WHERE execution_status = 'SUCCESS') AS queries,
  round((SELECT avg(avg_running) FROM au_warehouse_load_history) * 100, 1) AS avg_utilization_pct, tb AS storage_tb,
  round(tb * 23, 0) AS storage_cost, round((w + s) * 4 + round(tb * 23, 0), 0) AS ytd_cost
FROM (SELECT {total(WMH, M0)} AS w, {total(MH, M0)} AS s, {total(WMH, M0 + ' AND warehouse_name IN ' + AIW)} AS ai,
  {total(MH, M0 + ' AND service_type IN ' + KPIS)} AS sv, {LAST.format(f'round((storage_bytes + stage_bytes) / {TB}, 2)')} AS tb)"""),
    "a3_cost_breakdown": fin(f"""
SELECT label, sum(cost) AS cost FROM (
 SELECT {WCAT} AS label, 4 * sum(credits_used)::DOUBLE AS cost FROM {WMH} WHERE {M0} GROUP BY 1
 UNION ALL SELECT {CAT}, 4 * sum(credits_used)::DOUBLE FROM {MH} WHERE {M0} GROUP BY 1
 UNION ALL SELECT 'Storage', {LAST.format(f'(storage_bytes + stage_bytes + failsafe_bytes) / {TB} * 23')}
 UNION ALL SELECT unnest(['Managed Compute', 'Serverless Compute', 'AI & ML', 'Storage', 'Data Transfer', 'Other']), 0) GROUP BY 1""", r="cost"),
    "a4_ai_cost_breakdown": fin(f"""
SELECT 'service' AS source, {title('service_type')} AS label, 4 * sum(credits_used)::DOUBLE AS cost FROM {MH} WHERE {M0} AND service_type IN {AIS} GROUP BY ALL
UNION ALL SELECT 'warehouse', {title('warehouse_name')}, 4 * sum(credits_used)::DOUBLE FROM {WMH} WHERE {M0} AND warehouse_name IN {AIW} GROUP BY ALL""", r="cost"),
    "a5_serverless_cost_breakdown": fin(f"""
SELECT {title('service_type')} AS label, 4 * sum(credits_used)::DOUBLE AS cost FROM {MH}
WHERE {M0} AND (service_type IN {KPIS} OR service_type = 'DATA_TRANSFER') GROUP BY ALL""", r="cost"),
    "a6_top_tables_storage": fin(f"""
SELECT {_TBL} AS table_name, round(active_bytes / {GB}, 2) AS active_gb, round(time_travel_bytes / {GB}, 2) AS time_travel_gb,
  round(failsafe_bytes / {GB}, 2) AS failsafe_gb, round((active_bytes + time_travel_bytes + failsafe_bytes) / {GB}, 2) AS total_gb
FROM au_table_storage_metrics WHERE au_table_storage_metrics.table_name IS NOT NULL
ORDER BY active_bytes + time_travel_bytes + failsafe_bytes DESC, {_TBL.replace(', table_name', ', au_table_storage_metrics.table_name')} LIMIT 25"""),
    "a7_top_users_hidden_waste": fin(f"""
WITH t AS (SELECT warehouse_name, sum(c) AS t FROM uwh GROUP BY 1),
 w AS (SELECT warehouse_name, sum(wasted_cost_usd) AS w FROM hwc GROUP BY 1),
 a AS (SELECT user_name, sum(c) AS c FROM uwh WHERE warehouse_name IN {names(au.AI_QUERY_WAREHOUSES)} GROUP BY 1),
 x AS (SELECT user_name, sum(c / t * w) AS z, 'Compute' AS service_type, 'High idle/spill on ' || (array_agg(warehouse_name ORDER BY c DESC, warehouse_name DESC))[1] AS comment
    FROM uwh JOIN t USING (warehouse_name) JOIN w USING (warehouse_name) GROUP BY 1
  UNION ALL SELECT user_name, c / (SELECT sum(c) FROM a) * (SELECT sum(wasted_cost_usd) FROM au_hidden_waste_ai), 'AI & ML', 'Oversized model usage on AI warehouses' FROM a),
 b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_name ORDER BY z DESC, service_type) AS i FROM x) WHERE i = 1 ORDER BY z DESC, user_name LIMIT 5)
SELECT user_name, round(4 * sum(c), 0) AS tco_by_user, round(any_value(z), 0) AS attributed_waste, any_value(service_type) AS service_type, any_value(comment) AS comment
FROM b JOIN uwh USING (user_name) GROUP BY user_name"""),
    "a8_tco_monthly_trend_and_forecast": fin("SELECT * FROM tco", r="total_credits tco"),
    "a9_tco_by_month": fin("SELECT month, tco FROM tco WHERE type = 'Actual'", r="tco"),
    "a10_top_users_daily_credits": fin(daily_users("true")),
    "a10_top_users_daily_credits_service": fin(daily_users("user_name IN ('ETL_SERVICE', 'LOAD_SVC')")),
    "a10_top_users_daily_credits_adhoc": fin(daily_users("user_name LIKE 'USER%'")),
    "a11_warehouse_daily_credits": fin(f"""
WITH d AS (SELECT warehouse_name, start_time::DATE AS usage_date, sum(credits_used)::DOUBLE AS daily_credits FROM {WMH}
  WHERE {D21} AND warehouse_id > 0 GROUP BY ALL)
SELECT * FROM d WHERE warehouse_name IN (SELECT warehouse_name FROM d GROUP BY 1 ORDER BY sum(daily_credits) DESC, 1 LIMIT 10)"""),
    "a13_warehouse_summary_filtered": fin(spend("warehouse_name", where=f"warehouse_id > 0 AND {RANGE}")),
    "a14_idle_warehouses": fin(idle("true")),
    "a14_idle_warehouses_filtered": fin(idle(RANGE)),
    "a15_hidden_waste_compute": fin("SELECT * FROM hwc"),
    "a16_hidden_waste_storage": fin("""SELECT * FROM hws WHERE object_name IN (
 SELECT concat_ws('.', table_catalog, table_schema, table_name) FROM au_table_storage_metrics
 WHERE table_name IS NOT NULL ORDER BY time_travel_bytes + failsafe_bytes DESC, 1 LIMIT 50)"""),
    "a16_hidden_waste_storage_all": fin("SELECT * FROM hws"),
    "a17_hidden_waste_ai": fin("SELECT * FROM au_hidden_waste_ai"),
    "a18_hidden_waste_summary": fin(f"""
SELECT round(c, 0) AS compute, round(s, 0) AS storage_annual, round(a, 0) AS ai, round(c + s + a, 0) AS total, round(p, 0) AS spend_30d,
  round(round(c + s + a, 0) / greatest(p, 1) * 100, 1) AS waste_pct
FROM (SELECT (SELECT sum(wasted_cost_usd) FROM hwc) AS c, (SELECT sum(monthly_cost_usd) * 12 FROM hws) AS s,
  (SELECT sum(wasted_cost_usd) FROM au_hidden_waste_ai) AS a, 4 * ({total(WMH, D30)} + {total(MH, D30)}) AS p)"""),
    "a19_queue_pressure": fin(queue("true")),
    "a19_queue_pressure_filtered": fin(queue(RANGE)),
    "a20_warehouse_cost_efficiency": fin(f"""
SELECT object_name, {CC}, queries, round(b / {TB}, 2) AS scanned_tb, round(c::DOUBLE / nullif(b / {TB}, 0), 2) AS credits_per_tb,
  round(1000 * c::DOUBLE / queries, 2) AS credits_per_1k_queries, round(k, 1) AS avg_cache_pct, round(sp / {GB}, 2) AS spilled_gb
FROM (SELECT q.warehouse_name AS object_name, count(DISTINCT q.query_id) AS queries, sum(ifnull(credits_attributed_compute, 0)) AS c,
   sum(bytes_scanned)::DOUBLE AS b, sum(ifnull(bytes_spilled_to_local_storage, 0) + bytes_spilled_to_remote_storage)::DOUBLE AS sp,
   avg(ifnull(percentage_scanned_from_cache, 0)) AS k
  FROM {QH} q LEFT JOIN {QA} a USING (query_id) WHERE execution_status = 'SUCCESS' AND q.warehouse_name IS NOT NULL GROUP BY 1) WHERE c > 0"""),
    "a21_query_attributed_cost": fin(f"""
SELECT object_name, queries, {CC}, round(z::DOUBLE, 2) AS qas_credits, warehouse FROM (
 SELECT query_parameterized_hash AS object_name, count(*) AS queries, sum(credits_attributed_compute) AS c,
  sum(ifnull(credits_used_query_acceleration, 0)) AS z, min(warehouse_name) AS warehouse FROM {QA}
 WHERE query_parameterized_hash IS NOT NULL GROUP BY 1 HAVING sum(credits_attributed_compute) >= 1 ORDER BY 3 DESC, 1 LIMIT 50)"""),
    "a21_query_attributed_cost_all": fin(f"""
SELECT object_name, queries, {CC}, round(z::DOUBLE, 2) AS qas_credits, warehouse FROM (
 SELECT query_parameterized_hash AS object_name, count(*) AS queries, sum(credits_attributed_compute) AS c,
  sum(ifnull(credits_used_query_acceleration, 0)) AS z, min(warehouse_name) AS warehouse FROM {QA}
 WHERE query_parameterized_hash IS NOT NULL GROUP BY 1 HAVING sum(credits_attributed_compute) >= 1)"""),
    "a22_expensive_query_patterns": fin(f"""
SELECT query_hash AS object_name, count(*) AS queries, round(sum(bytes_scanned)::DOUBLE / {TB}, 2) AS tb_scanned,
  round(sum(bytes_spilled_to_remote_storage)::DOUBLE / {GB}, 2) AS gb_remote_spill, round(max(total_elapsed_time)::DOUBLE / 1000, 1) AS max_elapsed_sec,
  min(warehouse_name) AS warehouse FROM {QH} WHERE execution_status = 'SUCCESS' AND query_hash IS NOT NULL GROUP BY 1
HAVING count(*) >= 3 AND (sum(bytes_scanned) > 1099511627776 OR sum(bytes_spilled_to_remote_storage) > 0 OR max(total_elapsed_time) > 300000)
ORDER BY sum(bytes_scanned) DESC, query_hash LIMIT 50"""),
    "a23_cache_reuse_opportunity": fin(f"""
SELECT coalesce(query_parameterized_hash, query_hash) AS object_name, count(*) AS queries, round(sum(bytes_scanned)::DOUBLE / {TB}, 2) AS tb_scanned,
  round(avg(ifnull(percentage_scanned_from_cache, 0)), 1) AS avg_cache_pct, count(DISTINCT warehouse_name) AS warehouses
FROM {QH} WHERE execution_status = 'SUCCESS' AND query_type = 'SELECT' AND coalesce(query_parameterized_hash, query_hash) IS NOT NULL GROUP BY 1
HAVING count(*) >= 5 AND avg(ifnull(percentage_scanned_from_cache, 0)) < 40 ORDER BY sum(bytes_scanned) DESC, 1 LIMIT 50"""),
    "a24_storage_trend": fin("SELECT usage_date AS date, " + ", ".join(
        f"round(ifnull({c}, 0) / {TB}, 3) AS {n}" for c, n in (
            ("storage_bytes", "table_tb"), ("stage_bytes", "stage_tb"), ("failsafe_bytes", "failsafe_tb"),
            ("hybrid_table_storage_bytes", "hybrid_tb"), ("archive_storage_cool_bytes", "archive_cool_tb"),
            ("archive_storage_cold_bytes", "archive_cold_tb"))) + " FROM au_storage_usage"),
    "a25_top_tables": fin(f"""
SELECT {_TBL} AS object_name, round(active_bytes / {GB}, 2) AS active_gb, round(time_travel_bytes / {GB}, 2) AS time_travel_gb,
  round(failsafe_bytes / {GB}, 2) AS failsafe_gb, round(retained_for_clone_bytes / {GB}, 2) AS clone_gb, is_transient AS transient
FROM au_table_storage_metrics WHERE table_name IS NOT NULL AND active_bytes + time_travel_bytes + failsafe_bytes > 0
ORDER BY active_bytes + time_travel_bytes + failsafe_bytes + retained_for_clone_bytes DESC, 1 LIMIT 30"""),
    "a25_top_tables_all": fin(f"""
SELECT {_TBL} AS object_name, round(active_bytes / {GB}, 2) AS active_gb, round(time_travel_bytes / {GB}, 2) AS time_travel_gb,
  round(failsafe_bytes / {GB}, 2) AS failsafe_gb, round(retained_for_clone_bytes / {GB}, 2) AS clone_gb, is_transient AS transient
FROM au_table_storage_metrics WHERE table_name IS NOT NULL AND active_bytes + time_travel_bytes + failsafe_bytes > 0"""),
    "a26_unattributed_spend": fin(f"""
SELECT warehouse_name AS object_name, {CC}, ifnull(o, '<missing>') AS owner, ifnull(k, '<missing>') AS cost_center
FROM (SELECT warehouse_name, sum(credits_used) AS c FROM {WMH} WHERE warehouse_id > 0 GROUP BY 1)
LEFT JOIN (SELECT object_name AS warehouse_name, max(tag_value) FILTER (WHERE tag_name IN ('owner', 'team')) AS o,
   max(tag_value) FILTER (WHERE tag_name = 'costcenter') AS k FROM au_tag_references WHERE domain = 'WAREHOUSE' GROUP BY 1) USING (warehouse_name)
WHERE o IS NULL OR k IS NULL"""),
    "a26_unattributed_spend_without_tags": fin(f"SELECT *, '<missing>' AS owner, '<missing>' AS cost_center FROM ({spend('warehouse_name AS object_name')})"),
    "a27_spend_by_warehouse": fin(spend("warehouse_name")),
    "a27_spend_by_day": fin(spend("start_time::DATE AS date", where=f"warehouse_id > 0 AND {RANGE}")),
    "a28_ai_spend_summary": fin(f"""SELECT w + s AS ai_credits, round((w + s) * 4, 0) AS ai_cost FROM (SELECT
  round({total(WMH, M0 + ' AND warehouse_name IN ' + AIW)}, 0) AS w, round({total(MH, M0 + ' AND service_type IN ' + AIS)}, 0) AS s)"""),
    "a28_ai_service_metering": fin(f"""SELECT service_type || ':' || name AS object_name, {CC}, entity_type FROM (
  SELECT service_type, name, sum(credits_used) AS c, min(entity_type) AS entity_type FROM {MH} GROUP BY 1, 2) WHERE c > 0"""),
    "a28_ai_spend_by_day": fin(spend("start_time::DATE AS date", MH, "true")),
    "a29_ai_function_usage": fin(f"""SELECT object_name, {CC}, calls, tokens_sent, tokens_received, users FROM (
  SELECT function_name || ':' || model_name AS object_name, sum(credits) AS c, count(*) AS calls,
   sum((metrics->>'$[0].value')::BIGINT + 5) AS tokens_sent, sum((metrics->>'$[1].value')::BIGINT) AS tokens_received, count(DISTINCT user_id) AS users
  FROM au_cortex_ai_functions_usage_history GROUP BY 1) WHERE c > 0""", big="tokens_sent tokens_received"),
    "a29_ai_function_usage_flat": fin(f"""SELECT object_name, {CC}, calls, tokens_sent, tokens_received, users FROM (
  SELECT function_name || ':' || model_name AS object_name, sum(credits) AS c, sum(calls) AS calls, sum(tokens_sent) AS tokens_sent,
   sum(tokens_received) AS tokens_received, count(DISTINCT user_id) AS users FROM au_cortex_ai_functions_flat GROUP BY 1) WHERE c > 0""",
        big="calls tokens_sent tokens_received"),
    "a30_ai_search_daily": fin(f"""SELECT object_name, consumption_type, {CC}, tokens FROM (
  SELECT database_name || '.' || schema_name || '.' || service_name AS object_name, consumption_type, sum(credits) AS c, sum(tokens) AS tokens
  FROM au_cortex_search_daily_usage_history GROUP BY 1, 2) WHERE c > 0""", big="tokens"),
    "a31_serverless_optimization_spend": fin(f"""SELECT object_name, 'AUTOMATIC_CLUSTERING' AS service_type, {CC} FROM (
  SELECT 'DB.PUBLIC.' || table_name AS object_name, sum(credits_used) AS c FROM au_automatic_clustering_history GROUP BY 1) WHERE c > 0"""),
    "a31_snowpipe_cost": fin(f"""SELECT object_name, {CC}, round(b / {GB}, 2) AS gb_inserted, files FROM (
  SELECT pipe_name AS object_name, sum(try_cast(credits_used AS DOUBLE)) AS c, sum(bytes_inserted::DOUBLE) AS b, sum(files_inserted::BIGINT) AS files
  FROM au_pipe_usage_history GROUP BY 1) WHERE c > 0""", big="files"),
    "a31_serverless_task_costs": fin(f"""SELECT object_name, {CC} FROM (
  SELECT 'DB.OPS.' || task_name AS object_name, sum(credits_used) AS c FROM au_serverless_task_history GROUP BY 1) WHERE c > 0"""),
    "a31_data_transfer_drivers": fin(f"""
SELECT 'COPY:AWS/' || source_region || '->GCP/' || target_region AS object_name, round(sum(bytes_transferred)::DOUBLE / {TB}, 3) AS tb_transferred
FROM au_data_transfer_history GROUP BY ALL HAVING sum(bytes_transferred) > 0"""),
    "a32_executive_cost_trend": fin(spend("service_type AS object_name, usage_date AS date", "au_metering_daily_history", "true")),
    "a32_all_service_cost_profile": fin(spend("service_type AS object_name", "au_metering_daily_history", "true")),
    "a32_cost_breakdown_monthly": fin(f"""
SELECT month, category, round(sum(v), 2) AS cost_usd FROM (
 SELECT strftime(start_time, '%Y-%m') AS month, {WCAT} AS category, 4 * sum(credits_used)::DOUBLE AS v FROM {WMH} GROUP BY ALL
 UNION ALL SELECT strftime(start_time, '%Y-%m'), {CAT}, 4 * sum(credits_used)::DOUBLE FROM {MH} GROUP BY ALL
 UNION ALL SELECT strftime(usage_date, '%Y-%m'), 'Storage', 23 * avg((storage_bytes + stage_bytes + failsafe_bytes)::DOUBLE / {TB}) FROM au_storage_usage GROUP BY ALL)
GROUP BY ALL"""),
    "a33_warehouse_cost_profile": fin(f"""
SELECT warehouse_name AS object_name, {CC}, round(ifnull(r, 0) * 100, 1) AS avg_running_pct, round(ifnull(q, 0), 3) AS avg_queued_load
FROM (SELECT warehouse_name, sum(credits_used) AS c FROM {WMH} WHERE warehouse_id > 0 GROUP BY 1)
LEFT JOIN (SELECT warehouse_name, sum(avg_running::DECIMAL(18, 6))::DOUBLE / count(avg_running) AS r, sum(avg_queued_load::DECIMAL(18, 6))::DOUBLE / count(avg_queued_load) AS q FROM au_warehouse_load_history GROUP BY 1) USING (warehouse_name) WHERE c > 0"""),
    "a34_warehouse_load_profile": fin("""
SELECT start_time::DATE AS date, warehouse_name AS object_name, round(sum(avg_running::DECIMAL(18, 6))::DOUBLE / count(avg_running), 3) AS avg_running, round(sum(avg_queued_load::DECIMAL(18, 6))::DOUBLE / count(avg_queued_load), 3) AS avg_queued_load
FROM au_warehouse_load_history WHERE start_time >= TIMESTAMP '2024-01-23' GROUP BY ALL"""),
    "a35_warehouse_heatmap": fin(f"""
WITH d AS (SELECT warehouse_name AS object_name, start_time::DATE AS date, sum(credits_used)::DOUBLE AS v FROM {WMH}
  WHERE {D21} AND warehouse_id > 0 GROUP BY ALL)
SELECT object_name, date, round(v * 4, 2) AS cost_usd FROM d
WHERE object_name IN (SELECT object_name FROM d GROUP BY 1 ORDER BY sum(v) DESC, 1 LIMIT 10)"""),
    "a36_top_warehouses_by_cost": fin(f"""SELECT object_name, {CC} FROM (SELECT warehouse_name AS object_name, sum(credits_used) AS c FROM {WMH}
  WHERE warehouse_id > 0 GROUP BY 1 ORDER BY c DESC, 1 LIMIT 10)"""),
}
for _g in ("day", "week", "month", "year"):
    ORACLES[f"a12_warehouse_spend_{_g}"] = fin(spend(
        f"date_trunc('{_g}', start_time)::DATE AS period, warehouse_name", where=f"warehouse_id > 0 AND {RANGE}"))
# Without a number the operators return every row.
for _name, _cut in (("a6_top_tables_storage", " LIMIT 25"), ("a7_top_users_hidden_waste", " LIMIT 5")):
    ORACLES[f"{_name}_all"] = ORACLES[_name].replace(_cut, "")
ORACLES["a37_leaderboard_snapshot"] = board()
