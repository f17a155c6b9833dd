"""Comparison SQL for source-telemetry operators, over the flat telemetry planes."""

from __future__ import annotations

import oracles.planes as planes
from oracles.planes import add, fin
from tallyspark.sources import telemetry_tables  # noqa: F401  (adds its planes)
from tallyspark.sources.driver_tables import PLANES

for _k, _v in PLANES.items():
    planes.CTES.setdefault(_k, _v)

MM = "date_trunc('month', {0})::DATE AS charge_month"

add("up", f"""
SELECT u.*, {MM.format('usage_date')}, ifnull(is_photon, false) AS photon, billing_origin_product AS product,
  usage_quantity * ifnull(p.price, 0) AS cost, usage_quantity * coalesce(j.price, p.price, 0) AS jcost
FROM db_usage u
LEFT JOIN db_prices p ON p.sku_name = u.sku_name AND p.cloud = u.cloud AND p.price_start_time <= usage_end_time
  AND (p.price_end_time IS NULL OR p.price_end_time > usage_end_time)
LEFT JOIN db_prices j ON j.sku_name = replace(replace(replace(u.sku_name, 'ALL_PURPOSE', 'JOBS'), 'INTERACTIVE', 'JOBS'),
  'NOTEBOOKS', 'JOBS') AND j.cloud = u.cloud AND j.price_start_time <= usage_end_time
  AND (j.price_end_time IS NULL OR j.price_end_time > usage_end_time)""")
add("ut", f"""
SELECT cluster_id, {MM.format('start_time')}, avg(cpu_user_percent + cpu_system_percent) AS avg_cpu,
  avg(mem_used_percent) AS avg_mem, max(cpu_user_percent + cpu_system_percent) AS max_cpu, max(mem_used_percent) AS max_mem,
  count(CASE WHEN cpu_wait_percent >= 20 THEN 1 END)::DOUBLE / count(*) AS pct_time_high_cpu_wait,
  count(CASE WHEN mem_swap_percent >= 25 THEN 1 END)::DOUBLE / count(*) AS pct_time_high_mem_swap,
  min(local_disk_free) AS min_local_disk_free_bytes, sum(network_sent_bytes + network_received_bytes) AS network_bytes
FROM db_nodes GROUP BY ALL""")
add("rn", f"""
SELECT job_id, {MM.format('period_start_time')}, count(*) AS run_count,
  count(CASE WHEN result_state <> 'SUCCEEDED' THEN 1 END) AS failed_runs,
  avg(date_diff('second', period_start_time, period_end_time)) AS avg_run_seconds FROM db_runs GROUP BY ALL""")


def latest(name: str, key: str, when: str = "change_time") -> str:
    return (f"SELECT * EXCLUDE (i) FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {when} DESC) AS i "
            f"FROM {name}) WHERE i = 1")


add("jm", latest("db_jobs", "job_id"))
add("cm", f"SELECT *, coalesce(availability_aws, availability_azure) AS availability, tag_total AS tag_count FROM ({latest('db_clusters', 'cluster_id')})")
add("wm", f"SELECT *, tag_total AS tag_count FROM ({latest('db_warehouses', 'warehouse_id')})")
add("sm", latest("db_served", "served_entity_id"))
_PICK = "(array_agg({0} ORDER BY cost DESC, {0} DESC NULLS LAST))[1]"
add("ij", f"""
SELECT cluster_id, charge_month, sum(cost) AS job_shaped_cost, sum(jcost) AS job_shaped_jobs_priced_cost,
  {_PICK.format('job_id')} AS top_job_id, {_PICK.format('job_name')} AS top_job_name, {_PICK.format('run_as')} AS top_job_owner
FROM up WHERE product = 'ALL_PURPOSE' AND job_id IS NOT NULL GROUP BY ALL""")
add("qs", f"""
SELECT warehouse_id, {MM.format('start_time')}, count(*) AS query_count,
  100.0::DOUBLE * (count(CASE WHEN from_result_cache THEN 1 END)::DOUBLE / count(*)) AS cache_hit_pct,
  count(CASE WHEN spilled_local_bytes > 0 THEN 1 END) AS spill_query_count, sum(spilled_local_bytes) AS spilled_bytes,
  sum(shuffle_read_bytes) AS shuffle_bytes FROM db_history WHERE warehouse_id IS NOT NULL GROUP BY ALL""")
add("qu", f"""
SELECT *, sum(user_duration_ms) OVER (PARTITION BY warehouse_id, charge_month) AS warehouse_duration_ms FROM (
SELECT warehouse_id, executed_by, {MM.format('start_time')}, count(*) AS query_count, sum(total_duration_ms) AS user_duration_ms,
  CASE WHEN count(*) > 1 THEN date_sub('minute', min(start_time), max(start_time))::DOUBLE / (count(*) - 1) END AS avg_interval_minutes
FROM db_history WHERE warehouse_id IS NOT NULL AND executed_by IS NOT NULL GROUP BY ALL)""")
add("e_job", """
SELECT 'job' AS entity_type, u.job_id AS entity_id, coalesce(max(u.job_name), u.job_id) AS entity_name,
  coalesce(max(jm.run_as_user_name), u.run_as) AS owner_user, max(u.tag_project) AS owner_project, u.charge_month,
  sum(cost) AS billed_cost, sum(usage_quantity) AS native_quantity, least(100, avg(greatest(avg_cpu, avg_mem))) AS utilization_pct,
  max(run_count) AS activity_count, max(run_count) AS run_count,
  sum(cost) * ifnull(max(failed_runs)::DOUBLE / max(run_count), 0) AS failed_cost, bool_or(photon) AS photon,
  max(worker_node_type) AS worker_node_type, max(core_count) AS core_count, max(max_cpu) AS max_cpu_pct, max(max_mem) AS max_mem_pct,
  max(pct_time_high_cpu_wait) AS pct_time_high_cpu_wait, max(pct_time_high_mem_swap) AS pct_time_high_mem_swap,
  min(min_local_disk_free_bytes) AS min_local_disk_free_bytes, max(network_bytes) AS network_bytes,
  max(avg_run_seconds) AS avg_run_seconds, max(policy_id) AS policy_id, max(tag_count) AS tag_count
FROM up u LEFT JOIN ut ON ut.cluster_id = u.cluster_id AND ut.charge_month = u.charge_month
LEFT JOIN rn ON rn.job_id = u.job_id AND rn.charge_month = u.charge_month LEFT JOIN jm ON jm.job_id = u.job_id
LEFT JOIN cm ON cm.cluster_id = u.cluster_id LEFT JOIN db_node_types nt ON nt.node_type = cm.worker_node_type
WHERE product = 'JOBS' AND u.job_id IS NOT NULL GROUP BY u.job_id, u.run_as, u.charge_month""")
add("e_int", f"""
SELECT 'interactive' AS entity_type, g.cluster_id AS entity_id, coalesce(cluster_name, g.cluster_id) AS entity_name,
  coalesce(owned_by, spender) AS owner_user, proj AS owner_project, g.charge_month, billed_cost, native_quantity,
  least(100, greatest(avg_cpu, avg_mem)) AS utilization_pct, photon, min_autoscale_workers, max_autoscale_workers,
  auto_termination_minutes, worker_node_type, core_count, availability, max_cpu AS max_cpu_pct, max_mem AS max_mem_pct,
  job_shaped_cost, top_job_name, coalesce(run_as_user_name, top_job_owner) AS top_job_owner,
  job_shaped_jobs_priced_cost AS jobs_priced_cost, pct_time_high_cpu_wait, pct_time_high_mem_swap,
  min_local_disk_free_bytes, network_bytes, policy_id, tag_count
FROM (SELECT cluster_id, charge_month, sum(cost) AS billed_cost, sum(usage_quantity) AS native_quantity, bool_or(photon) AS photon,
    {_PICK.format('run_as')} AS spender, {_PICK.format('tag_project')} AS proj
  FROM up WHERE product = 'ALL_PURPOSE' AND cluster_id IS NOT NULL GROUP BY ALL) g
LEFT JOIN ut ON ut.cluster_id = g.cluster_id AND ut.charge_month = g.charge_month LEFT JOIN cm ON cm.cluster_id = g.cluster_id
LEFT JOIN db_node_types nt ON nt.node_type = cm.worker_node_type
LEFT JOIN ij ON ij.cluster_id = g.cluster_id AND ij.charge_month = g.charge_month LEFT JOIN jm ON jm.job_id = top_job_id""")
add("e_wh", """
SELECT 'sql_warehouse' AS entity_type, u.warehouse_id AS entity_id, coalesce(max(warehouse_name), u.warehouse_id) AS entity_name,
  u.run_as AS owner_user, max(tag_project) AS owner_project, u.charge_month, sum(cost) AS billed_cost,
  sum(usage_quantity) AS native_quantity, bool_or(photon) AS photon, max(cache_hit_pct) AS cache_hit_pct,
  max(query_count) AS query_count, max(warehouse_type) AS warehouse_type, max(spill_query_count) AS spill_query_count,
  max(spilled_bytes) AS spilled_bytes, max(shuffle_bytes) AS shuffle_bytes, max(tag_count) AS tag_count,
  max(auto_stop_minutes) AS auto_stop_minutes
FROM up u LEFT JOIN wm ON wm.warehouse_id = u.warehouse_id LEFT JOIN qs ON qs.warehouse_id = u.warehouse_id
  AND qs.charge_month = u.charge_month
WHERE product = 'SQL' AND u.warehouse_id IS NOT NULL GROUP BY u.warehouse_id, u.run_as, u.charge_month""")
add("e_whu", """
SELECT 'sql_warehouse_user' AS entity_type, u.warehouse_id || ':' || executed_by AS entity_id,
  coalesce(max(warehouse_name), u.warehouse_id) || ' (' || executed_by || ')' AS entity_name, executed_by AS owner_user,
  max(tag_project) AS owner_project, u.charge_month,
  sum(cost) * (max(user_duration_ms)::DOUBLE / max(warehouse_duration_ms)) AS billed_cost, max(query_count) AS activity_count,
  false AS photon, max(query_count) AS query_count, max(warehouse_type) AS warehouse_type,
  max(avg_interval_minutes) AS avg_interval_minutes,
  100.0::DOUBLE * (max(user_duration_ms)::DOUBLE / max(warehouse_duration_ms)) AS duration_share_pct, max(tag_count) AS tag_count,
  max(auto_stop_minutes) AS auto_stop_minutes
FROM up u JOIN qu ON qu.warehouse_id = u.warehouse_id AND qu.charge_month = u.charge_month
LEFT JOIN wm ON wm.warehouse_id = u.warehouse_id
WHERE product = 'SQL' GROUP BY u.warehouse_id, executed_by, u.charge_month""")
add("e_nb", """
SELECT 'notebook' AS entity_type, notebook_id AS entity_id, coalesce(max(notebook_path), notebook_id) AS entity_name,
  run_as AS owner_user, max(tag_project) AS owner_project, charge_month, sum(cost) AS billed_cost,
  sum(usage_quantity) AS native_quantity, bool_or(photon) AS photon, sum(jcost) AS jobs_priced_cost
FROM up WHERE product IN ('NOTEBOOKS', 'INTERACTIVE') AND notebook_id IS NOT NULL GROUP BY notebook_id, run_as, charge_month""")
add("epc", f"""
SELECT endpoint_id, {MM.format('usage_date')}, sum(usage_quantity) AS dbu_quantity, sum(usage_quantity * ifnull(price, 0)) AS billed_cost,
  max((tag_project IS NOT NULL)::INT + 2 * (tag_name IS NOT NULL)::INT) AS tag_count
FROM db_usage u LEFT JOIN db_prices p ON p.sku_name = u.sku_name AND p.cloud = u.cloud AND p.price_start_time <= usage_end_time
  AND (p.price_end_time IS NULL OR p.price_end_time > usage_end_time)
WHERE billing_origin_product IN ('MODEL_SERVING', 'AI_GATEWAY', 'AI_FUNCTIONS', 'VECTOR_SEARCH') AND endpoint_id IS NOT NULL
GROUP BY ALL""")
add("rq", f"""
SELECT served_entity_id, requester, context_project AS usage_context_project, {MM.format('request_time')}, count(*) AS request_count,
  sum(ifnull(input_token_count, 0)) AS input_tokens, sum(output_token_count) AS output_tokens,
  count(CASE WHEN status_code >= 400 THEN 1 END) AS error_request_count,
  sum(CASE WHEN status_code >= 400 THEN ifnull(input_token_count, 0) ELSE 0 END) AS error_input_tokens,
  sum(CASE WHEN status_code >= 400 THEN output_token_count ELSE 0 END) AS error_output_tokens, 0 AS total_duration_ms
FROM db_requests GROUP BY ALL""")
add("aur", """
SELECT coalesce(s.endpoint_id, r.served_entity_id) AS endpoint_id, s.endpoint_name, r.served_entity_id, entity_name AS model_name,
  entity_version AS model_version, entity_type AS model_kind,
  CASE WHEN min_throughput > 0 THEN 'provisioned_throughput' ELSE CASE entity_type WHEN 'EXTERNAL_MODEL' THEN 'external'
    WHEN 'FOUNDATION_MODEL' THEN 'pay_per_token' WHEN 'CUSTOM_MODEL' THEN 'provisioned_compute'
    WHEN 'FEATURE_SPEC' THEN 'provisioned_compute' ELSE 'unknown' END END AS serving_mode,
  requester, usage_context_project, NULL::BOOLEAN AS scale_to_zero_enabled, NULL::VARCHAR AS workload_size,
  coalesce(custom_compute, spec_compute) AS workload_type, min_throughput AS min_provisioned_throughput,
  max_throughput AS max_provisioned_throughput, r.charge_month, request_count, error_request_count, input_tokens, output_tokens,
  error_input_tokens, error_output_tokens, total_duration_ms, c.billed_cost AS endpoint_billed_cost,
  c.dbu_quantity AS endpoint_dbu_quantity, c.tag_count AS endpoint_tag_count
FROM rq r LEFT JOIN sm s USING (served_entity_id)
LEFT JOIN epc c ON c.endpoint_id = coalesce(s.endpoint_id, r.served_entity_id) AND c.charge_month = r.charge_month""")

add("rsq", "SELECT * FROM stl_query WHERE userid > 1")
add("act", """
SELECT (SELECT count(*) FROM rsq) AS query_count,
  (SELECT quantile_cont(total_queue_time, 0.95) FROM stl_wlm_query SEMI JOIN rsq USING (query)) AS wlm_queue_wait_us_p95,
  (SELECT quantile_cont(total_queue_time, 0.99) FROM stl_wlm_query SEMI JOIN rsq USING (query)) AS wlm_queue_wait_us_p99,
  (SELECT avg(total_queue_time) / avg(total_exec_time) FROM stl_wlm_query SEMI JOIN rsq USING (query)) AS wlm_wait_to_exec_ratio,
  (SELECT count(DISTINCT query) FROM svl_query_summary SEMI JOIN rsq USING (query) WHERE is_diskbased = 't') AS disk_spill_query_count,
  (SELECT ifnull(sum(date_diff('second', start_time, end_time)), 0) FROM svcs_concurrency_scaling_usage)::BIGINT AS concurrency_scaling_active_seconds,
  (SELECT min(starttime)::DATE FROM stl_query) AS earliest_retained_query_ts""")
add("meas", """
SELECT query_count, wlm_queue_wait_us_p95 / 1000 AS wlm_queue_wait_ms_p95, wlm_queue_wait_us_p99 / 1000 AS wlm_queue_wait_ms_p99,
  wlm_wait_to_exec_ratio, disk_spill_query_count, concurrency_scaling_active_seconds::DOUBLE AS concurrency_scaling_active_seconds,
  earliest_retained_query_ts::VARCHAR AS activity_measured_since, false AS activity_window_unmeasurable, 'partial' AS coverage,
  true AS detail_measurable FROM act""")
add("pat", """
WITH b AS (SELECT *, date_diff('second', starttime, endtime) AS s, md5(trim(querytxt[1:160])) AS m FROM rsq
   WHERE date_diff('second', starttime, endtime) >= 30),
 t AS (SELECT m, count(*) AS n, sum(s) AS total FROM b GROUP BY m ORDER BY total DESC, m LIMIT 200),
 c AS (SELECT b.* FROM b SEMI JOIN t USING (m)),
 sp AS (SELECT query, max((is_diskbased = 't')::INT) AS hit, sum(CASE WHEN is_diskbased = 't' THEN bytes ELSE 0 END) / 1073741824.0::DOUBLE AS gb,
   sum(workmem) / 1073741824.0::DOUBLE AS wgb, count(*) AS sl,
   CASE WHEN sum(rows_out) > 0 THEN ((max(rows_out) - min(rows_out)) * count(*))::DOUBLE / sum(rows_out)::DOUBLE ELSE 0 END AS skew
   FROM svl_query_report GROUP BY query),
 smp AS (SELECT m, query, userid, starttime, trim(querytxt) AS txt FROM (
   SELECT *, row_number() OVER (PARTITION BY m ORDER BY starttime DESC, query DESC) AS i FROM c) WHERE i = 1),
 top AS (SELECT m, arg_max(usename, {'n': n, 'u': usename}) AS u FROM (
   SELECT m, usename, count(*) AS n FROM c JOIN pg_user ON usesysid = userid GROUP BY ALL) GROUP BY m)
SELECT c.m AS qry_md5, any_value(smp.query) AS sample_query_id, any_value(smp.starttime)::DATE AS last_seen_at,
  any_value(smp.txt) AS sample_query_text, any_value(o.usename) AS sample_query_owner, any_value(t.n) AS run_count,
  any_value(t.total) / 60.0::DOUBLE AS total_run_min, avg(ifnull(w.total_exec_time, 0)) / 6e7 AS avg_exec_min,
  avg(ifnull(w.total_queue_time, 0)) / 6e7 AS avg_queue_min, avg(ifnull(hit, 0)) AS pct_runs_spilling,
  avg(ifnull(gb, 0)) AS avg_disk_spill_gb, avg(ifnull(wgb, 0)) AS avg_workmem_gb, avg(ifnull(skew, 0)) AS avg_skew_ratio,
  max(ifnull(skew, 0)) AS max_skew_ratio, avg(ifnull(sl, 0)) AS avg_slices_in_use, any_value(top.u) AS top_user
FROM c JOIN t USING (m) JOIN smp ON smp.m = c.m LEFT JOIN pg_user o ON o.usesysid = smp.userid
LEFT JOIN stl_wlm_query w ON w.query = c.query LEFT JOIN sp ON sp.query = c.query LEFT JOIN top ON top.m = c.m GROUP BY c.m""")
add("spc", """
SELECT external_table_name, count(DISTINCT query) AS scan_count, sum(s3_scanned_bytes)::DOUBLE / 1073741824 AS scanned_gb,
  sum(s3query_returned_bytes)::DOUBLE / 1073741824 AS returned_gb FROM svl_s3query_summary GROUP BY ALL""")
add("scn", "SELECT * FROM stl_scan WHERE userid > 1 AND perm_table_name <> 'S3'")
add("twl", """
WITH s AS (SELECT query, tbl, sum(bytes) AS b, sum(rows_pre_filter) AS r, sum(rows_out) AS o, max(starttime) AS l FROM scn GROUP BY ALL),
 q AS (SELECT *, sum(b) OVER w AS tb, sum(r) OVER w AS tr, count(*) OVER w AS n FROM s WINDOW w AS (PARTITION BY query))
SELECT tbl AS table_id, count(*) AS query_count, max(l)::DATE AS last_access_at, sum(b) AS scan_bytes, sum(r) AS rows_pre_filter,
  sum(o) AS rows_returned, sum(ifnull(total_exec_time, 0) * CASE WHEN tb > 0 THEN b::DOUBLE / tb::DOUBLE WHEN tr > 0
    THEN r::DOUBLE / tr::DOUBLE ELSE 1.0::DOUBLE / n END) / 1e6 AS weighted_exec_seconds
FROM q LEFT JOIN stl_wlm_query USING (query) GROUP BY tbl""")
add("inv", """
SELECT 'table' AS entity_type, 'main:' || db_name || '.' || schema_name || '.' || t.table_name AS entity_id,
  db_name || '.' || schema_name || '.' || t.table_name AS entity_name, tableowner AS owner_user, DATE '1997-03-01' AS charge_month,
  size_mb::DOUBLE AS native_quantity, 'MB' AS native_unit, query_count AS activity_count, encoded, diststyle,
  unsorted::DOUBLE AS unsorted_pct, stats_off::DOUBLE AS stats_off_pct, tbl_rows, last_access_at AS last_access_date,
  date_diff('day', last_access_at, DATE '2001-12-31') AS days_since_last_access,
  weighted_exec_seconds AS table_weighted_exec_seconds,
  100 * (ifnull(weighted_exec_seconds, 0) / (SELECT sum(weighted_exec_seconds) FROM twl)) AS table_compute_share_pct,
  scan_bytes::DOUBLE / 1073741824 AS table_scan_gb, rows_pre_filter AS table_rows_pre_filter, rows_returned AS table_rows_returned
FROM svv_table_info t LEFT JOIN twl USING (table_id)
LEFT JOIN pg_tables o ON o.schemaname = schema_name AND o.tablename = t.table_name""")
_PARTS = ("compute", "concurrency_scaling", "storage", "spectrum_scan")
add("ccb", "SELECT split_part(resource_id, ':cluster:', 2) AS cluster_id, " + ", ".join(
    f"nullif(sum(CASE WHEN x_cost_subcategory = '{p}' THEN effective_cost END), 0)::DOUBLE AS {p}_cost" for p in _PARTS)
    + " FROM bill WHERE service_name LIKE 'Amazon Redshift%' AND contains(resource_id, ':cluster:') GROUP BY ALL")
add("rsv", """
SELECT cluster_id, 720.0::DOUBLE * greatest(node_count - a, 0) AS on_demand_node_hours, 720.0::DOUBLE * least(node_count, a) AS reserved_node_hours
FROM cluster_inventory, (SELECT ifnull(sum(node_count), 0) AS a FROM reserved_inventory WHERE state = 'active')""")
add("cap", """
SELECT cluster_id, avg(average) FILTER (WHERE metric LIKE 'CPU%') AS cpu_avg_pct, max(maximum) FILTER (WHERE metric LIKE 'CPU%') AS cpu_max_pct,
  avg(average) FILTER (WHERE metric LIKE 'Perc%') AS disk_avg_pct, max(maximum) FILTER (WHERE metric LIKE 'Perc%') AS disk_max_pct,
  '1997-03-18' AS measured_since, '1997-03-31' AS measured_until
FROM metric_points WHERE point_time >= TIMESTAMP '1997-03-18' AND point_time < TIMESTAMP '1997-04-01' GROUP BY ALL""")

_NULLCOUNT = {
    "e_job": ("run_count failed_cost photon worker_node_type core_count max_cpu_pct max_mem_pct pct_time_high_cpu_wait "
              "pct_time_high_mem_swap min_local_disk_free_bytes network_bytes avg_run_seconds policy_id tag_count"),
    "e_int": ("photon min_autoscale_workers max_autoscale_workers auto_termination_minutes worker_node_type core_count availability "
              "max_cpu_pct max_mem_pct job_shaped_cost top_job_name top_job_owner jobs_priced_cost pct_time_high_cpu_wait "
              "pct_time_high_mem_swap min_local_disk_free_bytes network_bytes policy_id tag_count"),
    "e_wh": ("photon cache_hit_pct query_count warehouse_type spill_query_count spilled_bytes shuffle_bytes tag_count auto_stop_minutes"),
    "e_whu": "photon query_count warehouse_type avg_interval_minutes duration_share_pct tag_count auto_stop_minutes",
    "e_nb": "photon jobs_priced_cost",
}


def _union_part(name: str) -> str:
    cols = _NULLCOUNT[name].split()

    def has(c: str) -> str:
        return c if c in cols else "NULL"

    activity = "activity_count" if name in ("e_job", "e_whu") else "NULL"
    keys = " + ".join(f"({c} IS NOT NULL)::BIGINT" for c in cols)
    return f"""SELECT 'Databricks' AS provider_name, 'databricks' AS x_source_connector, charge_month, entity_type, entity_id, owner_user,
  round(billed_cost::DECIMAL(20,6), 2)::DOUBLE AS billed_cost, 'DBU' AS native_unit, {activity}::BIGINT AS activity_count, photon,
  {has('query_count')}::BIGINT AS query_count, {has('job_shaped_cost')}::DOUBLE AS job_shaped_cost,
  {has('duration_share_pct')}::DOUBLE AS duration_share_pct, {has('warehouse_type')}::VARCHAR AS warehouse_type, {keys} AS cause_keys FROM {name}"""


_HEALTH = "billed_cost native_quantity utilization_pct"
_T26 = """
WITH sp AS (SELECT query, userid, sum(CASE WHEN is_diskbased = 't' THEN bytes ELSE 0 END)::DOUBLE / 1073741824 AS g FROM svl_query_report GROUP BY ALL),
 a AS (SELECT usename AS username, count(DISTINCT q.query) AS query_count, sum(query_execution_time) AS exec_microseconds,
  sum(query_queue_time) AS queue_microseconds, sum(query_cpu_time) AS cpu_microseconds, sum(query_blocks_read) AS blocks_read,
  sum(query_temp_blocks_to_disk) AS temp_blocks_to_disk, sum(scan_row_count) AS scan_rows,
  sum(spectrum_scan_row_count) AS spectrum_scan_rows, sum(spectrum_scan_size_mb) AS spectrum_scan_mb, sum(ifnull(g, 0)) AS spill_gb
 FROM rsq q JOIN svl_query_metrics_summary m USING (query, userid) JOIN pg_user ON usesysid = q.userid
 LEFT JOIN sp ON sp.query = q.query AND sp.userid = q.userid GROUP BY usename)
SELECT *, (SELECT sum(exec_microseconds) FROM a) AS total_exec_microseconds,
  100 * (exec_microseconds::DOUBLE / (SELECT sum(exec_microseconds)::DOUBLE FROM a)) AS duration_share_pct,
  1000 * (exec_microseconds::DOUBLE / (SELECT sum(exec_microseconds)::DOUBLE FROM a)) AS billed_cost
FROM a"""

ORACLES = {
    "t1_price_window_join": fin("""
SELECT product, sku_name, charge_month, count(*) AS lines, sum(cost) AS cost, sum(jcost) AS jobs_priced_cost,
  count(tag_project) AS tagged_lines, count(CASE WHEN photon THEN 1 END) AS photon_lines FROM up GROUP BY ALL""", r="cost jobs_priced_cost"),
    "t2_node_utilization_month": fin("SELECT * FROM ut", big="network_bytes",
                                     r="avg_cpu avg_mem pct_time_high_cpu_wait pct_time_high_mem_swap"),
    "t3_job_runs_month": fin("SELECT * FROM rn", r="avg_run_seconds"),
    "t4_latest_by_key_jobs": fin("SELECT job_id, run_as_user_name FROM jm"),
    "t4_latest_by_key_clusters": fin("""SELECT cluster_id, cluster_name, owned_by, min_autoscale_workers, max_autoscale_workers,
  auto_termination_minutes, worker_node_type, availability, policy_id, tag_count FROM cm"""),
    "t4_latest_by_key_warehouses": fin("SELECT warehouse_id, warehouse_name, warehouse_type, tag_count, auto_stop_minutes FROM wm"),
    "t5_interactive_job_slice": fin("SELECT * FROM ij", r="job_shaped_cost job_shaped_jobs_priced_cost"),
    "t6_warehouse_query_stats": fin("SELECT * FROM qs", big="spilled_bytes shuffle_bytes", r="cache_hit_pct"),
    "t7_warehouse_query_users": fin("SELECT * FROM qu", big="user_duration_ms warehouse_duration_ms", r="avg_interval_minutes"),
    "t8_efficiency_job": fin("SELECT * FROM e_job", big="network_bytes", r=_HEALTH + (
        " failed_cost pct_time_high_cpu_wait pct_time_high_mem_swap avg_run_seconds max_cpu_pct max_mem_pct")),
    "t9_efficiency_interactive": fin("SELECT * FROM e_int", big="network_bytes", r=_HEALTH + (
        " job_shaped_cost jobs_priced_cost pct_time_high_cpu_wait pct_time_high_mem_swap")),
    "t10_efficiency_sql_warehouse": fin("SELECT * FROM e_wh", big="spilled_bytes shuffle_bytes", r="billed_cost native_quantity cache_hit_pct"),
    "t11_efficiency_sql_warehouse_user": fin("SELECT * FROM e_whu", r="billed_cost avg_interval_minutes duration_share_pct"),
    "t12_efficiency_notebook": fin("SELECT * FROM e_nb", r="billed_cost native_quantity jobs_priced_cost"),
    "t13_efficiency_union": fin("\nUNION ALL\n".join(_union_part(n) for n in _NULLCOUNT), r="job_shaped_cost duration_share_pct"),
    "t14_endpoint_cost_month": fin("SELECT * REPLACE (CASE tag_count WHEN 3 THEN 3 WHEN 2 THEN 2 ELSE tag_count END AS tag_count) FROM epc",
                                   r="billed_cost dbu_quantity"),
    "t15_endpoint_requests_month": fin("SELECT * FROM rq",
        big="input_tokens output_tokens error_input_tokens error_output_tokens total_duration_ms"),
    "t16_ai_usage_rows": fin("SELECT * FROM aur", r="endpoint_billed_cost endpoint_dbu_quantity",
        big="input_tokens output_tokens error_input_tokens error_output_tokens total_duration_ms"),
    "t16_ai_usage_rows_without_entities": fin("""
SELECT served_entity_id AS endpoint_id, 'unknown' AS serving_mode, requester, usage_context_project, charge_month, request_count,
  input_tokens, NULL::DOUBLE AS endpoint_billed_cost FROM rq""", big="input_tokens"),
    "t17_endpoint_efficiency": fin("""
SELECT 'endpoint' AS entity_type, endpoint_id AS entity_id, max(endpoint_name) AS entity_name, charge_month,
  ifnull(max(endpoint_billed_cost), 0) AS billed_cost, nullif(max(endpoint_dbu_quantity), 0) AS native_quantity,
  sum(request_count) AS activity_count, max(serving_mode) AS serving_mode, sum(input_tokens) AS input_tokens,
  sum(output_tokens) AS output_tokens, sum(input_tokens + output_tokens) AS total_tokens,
  sum(error_input_tokens + error_output_tokens) AS error_tokens, sum(request_count) AS request_count,
  sum(error_request_count) AS error_request_count, count(DISTINCT model_name) AS model_count,
  NULL::BOOLEAN AS scale_to_zero_enabled, max(workload_type) AS workload_type, NULL::VARCHAR AS workload_size,
  max(endpoint_tag_count) AS tag_count,
  round(100.0::DOUBLE * (sum(error_request_count)::DOUBLE / sum(request_count)::DOUBLE), 2) AS error_rate_pct,
  CASE WHEN max(serving_mode) = 'pay_per_token' AND max(endpoint_billed_cost) > 0 THEN round(max(endpoint_billed_cost)
    * sum(error_input_tokens + error_output_tokens)::DOUBLE / sum(input_tokens + output_tokens)::DOUBLE, 2) END AS failed_cost
FROM aur GROUP BY endpoint_id, charge_month""", r="billed_cost native_quantity",
        big="activity_count input_tokens output_tokens total_tokens error_tokens request_count error_request_count"),
    "t18_delta_table_inventory": fin("""
SELECT 'table' AS entity_type, table_name AS entity_id, table_name AS entity_name, DATE '1997-03-01' AS charge_month,
  size_in_bytes::DOUBLE AS native_quantity, 'bytes' AS native_unit, num_files, codec AS compression_codec
FROM db_table_detail WHERE table_type <> 'VIEW' ORDER BY size_in_bytes DESC, table_name LIMIT 20"""),
    "t19_compute_instance_month": fin(f"""
SELECT 'Databricks' AS provider_name, n.charge_month, n.cluster_id, cluster_name, coalesce(run_as_user_name, owned_by) AS owner_user,
  instance_id, is_driver, node_type
FROM (SELECT cluster_id, instance_id, {MM.format('start_time')}, max(driver) AS is_driver, min(node_type) AS node_type
  FROM db_nodes GROUP BY ALL) n LEFT JOIN cm USING (cluster_id)
LEFT JOIN jm ON 'job-' || jm.job_id || '-run-1' = cluster_name"""),
    "t20_driver_health_databricks": fin(f"""
SELECT 'Databricks' AS provider_name, {MM.format('start_time')}, client_driver, client_application, executed_by, count(*) AS query_count
FROM db_history GROUP BY ALL"""),
    "t21_driver_health_redshift": fin(f"""
SELECT 'AWS' AS provider_name, {MM.format('recordtime')}, nullif(trim(driver_version), '') AS client_driver,
  CASE WHEN application_name <> '' THEN application_name END AS client_application, username AS executed_by, count(*) AS query_count
FROM stl_connection_log WHERE event LIKE 'init%' GROUP BY ALL"""),
    "t22_driver_health_snowflake": fin(f"""
SELECT 'Snowflake' AS provider_name, {MM.format('start_time')}, client_application_id AS client_driver, NULL::VARCHAR AS client_application,
  user_name AS executed_by, count(*) AS query_count,
  CASE WHEN client_application_id LIKE 'PythonConnector%' THEN CASE WHEN regexp_extract(client_application_id, '3\\.(\\d+)', 1)::INT >= 7 THEN 'supported' ELSE 'unsupported' END
    WHEN client_application_id LIKE 'JDBC%' THEN CASE WHEN regexp_extract(client_application_id, '3\\.14\\.(\\d+)', 1)::INT >= 5 THEN 'supported' ELSE 'unsupported' END
    WHEN client_application_id LIKE '%Go 1.7.2' THEN 'supported' WHEN client_application_id LIKE 'SnowSQL%' THEN 'unsupported'
    WHEN client_application_id LIKE 'Kafka%' THEN 'unsupported' ELSE 'unknown' END AS support_status
FROM sf_queries JOIN sf_sessions USING (session_id) WHERE client_application_id IS NOT NULL GROUP BY ALL"""),
    "t23_cluster_activity": fin("SELECT * FROM act", r="wlm_queue_wait_us_p95 wlm_queue_wait_us_p99 wlm_wait_to_exec_ratio"),
    "t24_retention_ledger": fin("""
WITH per AS (
  SELECT 'stl_query' AS log_table, min(starttime)::DATE AS covered_from, max(starttime)::DATE AS covered_to FROM stl_query
  UNION ALL SELECT 'stl_wlm_query', min(queue_start_time)::DATE, max(queue_start_time)::DATE FROM stl_wlm_query
  UNION ALL SELECT 'svcs_concurrency_scaling_usage', min(start_time)::DATE, max(start_time)::DATE FROM svcs_concurrency_scaling_usage),
 rows AS (SELECT * FROM per UNION ALL
  SELECT '*', CASE WHEN count(covered_from) = count(*) THEN max(covered_from) END, CASE WHEN count(covered_from) = count(*) THEN min(covered_to) END FROM per)
SELECT log_table, covered_from, covered_to, DATE '1997-03-01' AS window_from, DATE '1997-03-31' AS window_to, DATE '1997-03-25' AS capped_from,
  CASE WHEN covered_from IS NOT NULL AND greatest(DATE '1997-03-01', covered_from) <= least(DATE '1997-03-31', covered_to) THEN greatest(DATE '1997-03-01', covered_from) END AS effective_from,
  CASE WHEN covered_from IS NOT NULL AND greatest(DATE '1997-03-01', covered_from) <= least(DATE '1997-03-31', covered_to) THEN least(DATE '1997-03-31', covered_to) END AS effective_to,
  NOT coalesce(covered_from IS NOT NULL AND greatest(DATE '1997-03-01', covered_from) <= least(DATE '1997-03-31', covered_to), false) OR coalesce(covered_from > DATE '1997-03-01', false) AS truncated,
  coalesce(covered_from <= DATE '1997-03-01' AND covered_to >= DATE '1997-03-31', false) AS complete
FROM rows"""),
    "t24_measurable_window": fin("SELECT * FROM meas", r="wlm_queue_wait_ms_p95 wlm_queue_wait_ms_p99 wlm_wait_to_exec_ratio"),
    "t25_query_patterns": fin("SELECT * FROM pat", r=("total_run_min avg_exec_min avg_queue_min pct_runs_spilling avg_disk_spill_gb "
        "avg_workmem_gb avg_skew_ratio max_skew_ratio avg_slices_in_use")),
    "t26_user_activity": fin(_T26 + " ORDER BY exec_microseconds DESC LIMIT 50", r="spill_gb duration_share_pct billed_cost", big=(
        "exec_microseconds total_exec_microseconds queue_microseconds cpu_microseconds blocks_read temp_blocks_to_disk scan_rows "
        "spectrum_scan_rows spectrum_scan_mb")),
    "t26_user_activity_all": fin(_T26, r="spill_gb duration_share_pct billed_cost", big=(
        "exec_microseconds total_exec_microseconds queue_microseconds cpu_microseconds blocks_read temp_blocks_to_disk scan_rows "
        "spectrum_scan_rows spectrum_scan_mb")),
    "t27_spectrum_table_usage": fin("SELECT * FROM spc", r="scanned_gb returned_gb"),
    "t28_allocate_spectrum_cost": fin("""
SELECT *, 500 * (scanned_gb / sum(scanned_gb) OVER ()) AS spectrum_allocated_cost, 100 * (scanned_gb / sum(scanned_gb) OVER ()) AS spectrum_allocation_pct,
  'allocated' AS spectrum_allocation_status FROM spc""", r="scanned_gb returned_gb spectrum_allocated_cost spectrum_allocation_pct"),
    "t28_allocate_spectrum_cost_partial_window": fin("""
SELECT *, NULL::DOUBLE AS spectrum_allocated_cost, NULL::DOUBLE AS spectrum_allocation_pct, NULL::VARCHAR AS spectrum_allocation_status
FROM spc""", r="scanned_gb returned_gb"),
    "t29_table_workload_share": fin("SELECT * FROM twl", big="scan_bytes rows_pre_filter rows_returned", r2="weighted_exec_seconds"),
    "t30_table_inventory_rows": fin("SELECT * FROM inv", big="table_rows_pre_filter table_rows_returned",
        r2="table_weighted_exec_seconds", r="table_compute_share_pct table_scan_gb"),
    "t31_cluster_cost_breakdown": fin("SELECT * FROM ccb"),
    "t32_reserved_coverage": fin("SELECT * FROM rsv"),
    "t33_capacity_metrics": fin("SELECT * FROM cap", r="cpu_avg_pct disk_avg_pct"),
    "t34_redshift_cluster_row": fin("""
SELECT 'sql_warehouse' AS entity_type, c.cluster_id AS entity_id, c.cluster_id AS entity_name, DATE '1997-03-01' AS charge_month,
  ifnull(compute_cost, 0) + ifnull(concurrency_scaling_cost, 0) + ifnull(storage_cost, 0) + ifnull(spectrum_scan_cost, 0) AS billed_cost,
  query_count AS activity_count, compute_cost, concurrency_scaling_cost, storage_cost, spectrum_scan_cost, on_demand_node_hours,
  reserved_node_hours, cpu_avg_pct AS cluster_cpu_utilization_avg_pct, cpu_max_pct AS cluster_cpu_utilization_max_pct,
  disk_avg_pct AS cluster_disk_space_used_avg_pct, disk_max_pct AS cluster_disk_space_used_max_pct,
  measured_since AS capacity_metrics_measured_since, measured_until AS capacity_metrics_measured_until,
  meas.* EXCLUDE (activity_window_unmeasurable, coverage, detail_measurable), NULL::BOOLEAN AS activity_window_unmeasurable,
  NULL::BOOLEAN AS activity_window_capped
FROM ccb c LEFT JOIN rsv USING (cluster_id) LEFT JOIN cap USING (cluster_id), meas""", r=(
        "billed_cost compute_cost concurrency_scaling_cost storage_cost spectrum_scan_cost cluster_cpu_utilization_avg_pct "
        "cluster_disk_space_used_avg_pct wlm_queue_wait_ms_p95 wlm_queue_wait_ms_p99 wlm_wait_to_exec_ratio")),
    "t35_table_usage_daily": fin("""
SELECT starttime::DATE AS snapshot_date, tbl AS table_id, count(DISTINCT query) AS query_count, count(*) AS scan_step_count,
  sum(bytes) AS scan_bytes, sum(rows_pre_filter) AS rows_pre_filter, sum(rows_out) AS rows_returned, min(starttime)::DATE AS first_scan_at,
  max(starttime)::DATE AS last_scan_at FROM scn GROUP BY ALL""", big="scan_bytes rows_pre_filter rows_returned"),
    "t36_external_query_daily": fin("""
SELECT start_time::DATE AS usage_date, source_type, nullif(trim(table_name), '') AS external_table, trim(file_location) AS file_location,
  file_format, count(DISTINCT query_id) AS query_count, count(*) AS segment_count, sum(duration) / 1e6 AS duration_seconds,
  sum(total_partitions) AS total_partitions, sum(qualified_partitions) AS qualified_partitions, sum(scanned_files) AS scanned_files,
  sum(returned_rows) AS source_rows, sum(returned_bytes) AS source_bytes, sum(s3list_time) AS s3_listing_milliseconds,
  sum(get_partition_time) AS partition_catalog_milliseconds
FROM sys_external_query_detail WHERE source_type = 'S3' GROUP BY ALL""", r="duration_seconds", big=(
        "total_partitions qualified_partitions scanned_files source_rows source_bytes s3_listing_milliseconds partition_catalog_milliseconds")),
    "t37_external_table_catalog": fin("""
SELECT DATE '2001-06-01' AS snapshot_at, redshift_database_name, schemaname AS external_schema, tablename AS external_table, tabletype,
  location AS table_location, input_format, output_format, serialization_lib, compressed, parameters AS table_parameters
FROM svv_external_tables"""),
    "t38_s3_tiering_signal": fin(f"""
SELECT * FROM (SELECT 'storage' AS entity_type, resource_id AS entity_id, min(resource_name) AS entity_name, {MM.format('charge_period_start')},
  sum(billed_cost) AS billed_cost, CASE WHEN count(CASE WHEN charge_description ILIKE '%intelligent-tiering%' THEN 1 END) > 0
    THEN 'intelligent_tiering' ELSE 'standard' END AS storage_class
FROM bill WHERE service_name = 'Amazon Simple Storage Service' AND resource_id IS NOT NULL GROUP BY ALL) WHERE billed_cost > 0""", "billed_cost"),
    "t39_policy_config_snapshot": fin("""
SELECT '2001-06' AS snapshot_month, cluster_id, cluster_id AS cluster_name, encrypted, is_public AS publicly_accessible,
  snapshot_days AS automated_snapshot_retention_days, lower(parameter_value) = 'true' AS require_ssl, tag_total AS tag_count
FROM cluster_inventory LEFT JOIN parameter_inventory USING (parameter_group)"""),
}
