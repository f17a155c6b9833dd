"""Comparison SQL for read-side analytics, over the comparison SQL of the views they read."""

from __future__ import annotations

import oracles.planes as planes
from oracles import account_usage, ai_backing, spend, telemetry, waste
from oracles.planes import add, fin
from tallyspark.operators.rules import WASTE_RULES
from tallyspark.sources.driver_tables import PLANES

for _k, _v in PLANES.items():
    planes.CTES.setdefault(_k, _v)
for _cte, _key in (("v_service", "g2_spend_by_service_month"), ("v_sku", "g3_spend_by_sku_month"), ("v_bill", "g1_monthly_bill"),
                   ("v_sub", "g4_spend_by_cost_subcategory_month"), ("v_res", "g5_resource_month"), ("v_clu", "g6_redshift_cluster_cost_month"),
                   ("v_skutag", "g7_spend_by_sku_tag_month"), ("v_tag", "g9_spend_by_tag_month"), ("v_cred", "g14_credits_month"),
                   ("v_day", "g15_spend_trend_daily"), ("v_mom", "g16_sku_month_over_month"), ("v_key", "g19_spend_by_tag_key_month"),
                   ("v_ai", "g20_ai_spend_month"), ("v_fc", "g21_spend_forecast_month")):
    add(_cte, spend.ORACLES[_key], True)
for _cte, _key in (("v_bst", "g38_backing_storage_month"), ("v_bco", "g40_backing_compute_month"), ("v_epm", "g47_endpoint_month"),
                   ("v_mod", "g48_model_month"), ("v_prj", "g49_project_month"), ("v_rqm", "g50_requester_month")):
    add(_cte, ai_backing.ORACLES[_key], True)
add("v_util", waste.ORACLES["g34_utilization_entity_month"], True)
add("v_reso", waste.ORACLES["g33_waste_resolution_month"], True)
add("v_inv", telemetry.ORACLES["t30_table_inventory_rows"], True)
add("v_crow", telemetry.ORACLES["t34_redshift_cluster_row"], True)
add("v_tco", account_usage.ORACLES["a8_tco_monthly_trend_and_forecast"], True)
add("v_hws", account_usage.ORACLES["a18_hidden_waste_summary"], True)

R = "charge_month BETWEEN DATE '1996-01-01' AND DATE '1999-12-01'"
CUR, PRV = "DATE '1998-06-01'", "DATE '1998-05-01'"
MAPPED = ("(SELECT charge_month, 'Databricks Storage' AS service_name, net_cost, gross_cost FROM v_bst WHERE mapping = 'databricks' "
          "UNION ALL SELECT charge_month, 'Databricks Compute', net_cost, gross_cost FROM v_bco WHERE mapping = 'databricks')")


def at(col: str, month: str) -> str:
    return f"coalesce(sum({col}) FILTER (WHERE charge_month = {month}), 0)"


BEST = """SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY charge_month, entity_type, entity_id, lens) AS findings,
  row_number() OVER (PARTITION BY charge_month, entity_type, entity_id, lens ORDER BY recoverable_cost DESC, waste_category DESC) AS i FROM findings) WHERE i = 1"""
BEST_ANY = BEST.replace("entity_id, lens", "entity_id")
add("mv", f"""
SELECT provider_name, service_name AS driver, c - p AS cost_delta, CASE WHEN p <> 0 THEN 100 * ((c - p) / p) END AS cost_pct_change, 'Service' AS type
FROM (SELECT provider_name, service_name, {at('gross_cost', CUR)} AS c, {at('gross_cost', PRV)} AS p FROM v_service
  WHERE provider_name <> 'Databricks' AND charge_month IN ({CUR}, {PRV}) GROUP BY ALL)
UNION ALL SELECT provider_name, replace(sku_id, 'ENTERPRISE_', ''), cost_delta, cost_pct_change, 'SKU' FROM v_mom
WHERE provider_name = 'Databricks' AND charge_month = {CUR} AND cost_delta IS NOT NULL""")
_SCOPE = "('Amazon Redshift', 'Amazon Redshift Spectrum')"
add("sday", f"""
SELECT *, date_trunc('month', charge_day)::DATE AS mm, date_trunc('month', last_day)::DATE AS anchor FROM (
 SELECT charge_day, sum(ifnull(gross_cost, 0)) AS c, max(charge_day) OVER () - 1 AS last_day FROM v_day WHERE service_name IN {_SCOPE} GROUP BY 1)""")
add("polnew", """SELECT * EXCLUDE (i) FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, policy_category ORDER BY charge_month DESC) AS i
FROM policy_rows) WHERE i = 1""")
_RULESCOPE = ", ".join(f"('{r.category}', '{r.lens}', '{p}', '{k}')" for r in WASTE_RULES
                       for p in (r.providers or ("AWS", "Databricks", "Snowflake")) for k in (r.entity_types or ("",)))
add("scope", f"SELECT * FROM (VALUES {_RULESCOPE}) AS t(waste_category, lens, provider_name, entity_type)")


def basis(src: str, label: str) -> str:
    return f"""SELECT {label}, sum(input_tokens) AS input_tokens, sum(output_tokens) AS output_tokens, sum(total_tokens) AS total_tokens,
  sum(request_count) AS request_count, sum(allocated_cost) AS allocated_cost,
  CASE WHEN count(DISTINCT cost_allocation_basis) > 1 THEN 'mixed: ' ELSE '' END
   || list_aggregate(list_sort(list(DISTINCT cost_allocation_basis)), 'string_agg', ', ') AS basis FROM {src} GROUP BY {label}"""


_TOK = "input_tokens output_tokens total_tokens request_count"
_WALLET = "entity_type IN ('sql_warehouse', 'sql_warehouse_user') OR waste_category LIKE 'redshift\\_%' ESCAPE '\\'"
_RECOV = f"""SELECT provider_name, sum(p) AS potential_savings FROM (SELECT provider_name, entity_type, entity_id, lens, max(recoverable_cost) AS p
 FROM findings WHERE charge_month = {CUR} AND (provider_name <> 'AWS' OR {_WALLET}) GROUP BY ALL) GROUP BY 1"""

ORACLES = {
    "d1_service_share": fin(f"""
SELECT * FROM (SELECT service_name, g AS gross_cost, 100 * (g / sum(g) OVER ()) AS share_pct FROM (
 SELECT service_name, sum(gross_cost) AS g FROM v_service WHERE provider_name = 'AWS' AND {R} GROUP BY 1)) WHERE gross_cost <> 0""", r="gross_cost share_pct"),
    "d2_resource_rank": fin(f"""
SELECT resource_name, resource_id, resource_type, sub_account_id, region_id, sum(gross_cost) AS gross_cost FROM v_res
WHERE provider_name = 'Databricks' AND service_name = 'JOBS' AND {R} GROUP BY ALL""", r="gross_cost"),
    "d3_billing_tier": fin("""
SELECT CASE WHEN service_name IN ('JOBS', 'MODEL_SERVING') THEN 'dedicated' WHEN service_name = 'SQL' OR service_name LIKE 'Amazon Redshift%' THEN 'shared_subgrain'
  WHEN service_name = 'ALL_PURPOSE' THEN 'shared_no_subgrain' ELSE 'unclassified' END AS tier, service_name, sum(net_cost) AS net_cost
FROM v_service GROUP BY ALL""", r="net_cost"),
    "d4_allocate_cost_to_users": fin(f"""
WITH c AS (SELECT charge_month, sum(gross_cost) AS c FROM v_service WHERE provider_name = 'Databricks' AND service_name = 'SQL' AND {R} GROUP BY 1),
 u AS (SELECT charge_month, entity_id, max(primary_signal_value) / 100 AS s, max(secondary_signals) AS n FROM v_util
   WHERE provider_name = 'Databricks' AND entity_type = 'sql_warehouse_user' AND {R} GROUP BY ALL),
 a AS (SELECT entity_id, n, c * (s / nullif(sum(s) OVER (PARTITION BY charge_month), 0)) AS part FROM u JOIN c USING (charge_month))
SELECT entity_id AS owner_user, sum(part) AS allocated_cost, 100 * (sum(part) / (SELECT sum(c) FROM c)) AS duration_share_pct, max(n) AS note FROM a GROUP BY 1
UNION ALL SELECT 'Unallocated (no query telemetry)', greatest(0, (SELECT sum(c) FROM c) - (SELECT sum(part) FROM a)), NULL, 'No measured query activity'""",
        r="allocated_cost duration_share_pct"),
    "d5_tag_key_rank": fin(f"""
SELECT k.*, tag_value_count FROM (SELECT tag_key_normalized, list_aggregate(list_sort(list(DISTINCT tag_key_variants)), 'string_agg', ' · ') AS tag_key_variants,
  sum(net_cost) AS net_cost FROM v_key WHERE provider_name = 'Databricks' AND {R} GROUP BY 1) k
JOIN (SELECT replace(lower(tag_key), '-', '_') AS tag_key_normalized, count(DISTINCT tag_value) AS tag_value_count FROM v_tag
  WHERE provider_name = 'Databricks' AND {R} GROUP BY 1) USING (tag_key_normalized)""", r="net_cost"),
    "d6_tag_value_rank": fin(f"""
SELECT tag_value, sum(gross_cost) AS net_cost FROM v_tag WHERE provider_name = 'Databricks' AND tag_key = 'cost-project' AND {R} GROUP BY 1
ORDER BY 2 DESC, 1 LIMIT 20""", r="net_cost"),
    "d7_bill_months": fin(f"""SELECT charge_month, net_cost, list_cost, savings FROM v_bill WHERE provider_name = 'Databricks' AND {R}"""),
    "d7_bill_months_scoped": fin(f"""SELECT charge_month, net_cost, list_cost, savings FROM v_service WHERE service_name = 'Amazon Redshift' AND {R}"""),
    "d8_scoped_run_rate": fin("""
SELECT anchor AS charge_month, round(sum(c) FILTER (WHERE charge_day <= last_day) / count(*) FILTER (WHERE charge_day <= last_day) * day(last_day(anchor)), 2)
  AS forecast_cost, sum(c) AS actual_to_date, count(*) FILTER (WHERE charge_day <= last_day) AS history_days FROM sday WHERE mm = anchor GROUP BY anchor""", r="actual_to_date"),
    "d8_scoped_forecast": fin("""
SELECT (any_value(anchor) + to_months(any_value(i)::INT))::DATE AS charge_month, greatest(0, round(avg(c), 2)) AS forecast_cost, count(*) AS history_days
FROM (SELECT anchor, mm, sum(c) AS c FROM sday WHERE charge_day <= last_day AND mm < anchor GROUP BY ALL ORDER BY mm DESC LIMIT 3), range(1, 4) AS g(i) GROUP BY i HAVING count(*) = 3"""),
    "d9_cap_series": fin("""
SELECT charge_month, CASE WHEN r < 5 THEN service_name ELSE 'Other' END AS service_name, sum(net_cost) AS net_cost FROM v_service
JOIN (SELECT service_name, row_number() OVER (ORDER BY sum(net_cost) DESC) AS r FROM v_service GROUP BY 1) USING (service_name) GROUP BY ALL""", r="net_cost"),
    "d10_backing_monthly": fin(f"SELECT charge_month, service_name, sum(net_cost) AS net_cost FROM {MAPPED} WHERE {R} GROUP BY ALL", r="net_cost"),
    "d10_backing_run_rate": fin(f"""SELECT round(sum(net_cost) / 12 * 30, 2) AS forecast_cost, sum(net_cost) AS actual_to_date FROM {MAPPED}
WHERE charge_month = {CUR}""", r2="actual_to_date"),
    "d10_backing_trend": fin(f"""SELECT avg(c) AS forecast_addition FROM (SELECT charge_month, sum(net_cost) AS c FROM {MAPPED}
WHERE charge_month < DATE '1999-01-01' AND {R} GROUP BY 1 ORDER BY 1 DESC LIMIT 3)""", r="forecast_addition"),
    "d11_partial_month_remainder": fin("""
SELECT * FROM (SELECT provider_name, charge_month, round(forecast_cost - actual_to_date, 2) AS remainder FROM v_fc
 JOIN (SELECT provider_name, max(charge_month) AS charge_month FROM v_bill GROUP BY 1) USING (provider_name, charge_month)
 WHERE forecast_kind = 'run_rate' AND history_days >= 1) WHERE remainder > 0"""),
    "d12_spend_pivot": fin("SELECT replace(sku_id, 'ENTERPRISE_', '') AS k, " + ", ".join(
        f"coalesce(sum(net_cost) FILTER (WHERE charge_month = DATE '1998-{m:02d}-01'), 0) AS m_1998_{m:02d}" for m in range(1, 7))
        + ", sum(net_cost) AS total FROM v_sku WHERE provider_name = 'Databricks' AND charge_month BETWEEN DATE '1998-01-01' AND DATE '1998-06-01' GROUP BY 1",
        r="total " + " ".join(f"m_1998_{m:02d}" for m in range(1, 7))),
    "d13_resource_delta": fin(f"""
SELECT *, cur - prev AS delta, cur_q - prev_q AS qty_delta, CASE WHEN prev <> 0 THEN 100 * ((cur - prev) / prev) END AS pct FROM (
 SELECT resource_name, resource_type, sub_account_id, {at('net_cost', CUR)} AS cur, {at('net_cost', PRV)} AS prev, {at('consumed_quantity', CUR)} AS cur_q,
  {at('consumed_quantity', PRV)} AS prev_q, max(consumed_unit) AS unit FROM v_res
 WHERE provider_name = 'Databricks' AND service_name = 'SQL' AND charge_month IN ({CUR}, {PRV}) GROUP BY ALL)""", r="cur prev cur_q prev_q delta qty_delta pct"),
    "d14_sku_tag_delta": fin(f"""
WITH t AS (SELECT tag_value, {at('net_cost', CUR)} AS cur, {at('net_cost', PRV)} AS prev FROM v_skutag WHERE provider_name = 'Databricks'
  AND sku_id = 'Brand#7' AND tag_key = 'team' AND charge_month IN ({CUR}, {PRV}) GROUP BY 1),
 w AS (SELECT {at('net_cost', CUR)} AS cur, {at('net_cost', PRV)} AS prev FROM v_sku WHERE provider_name = 'Databricks' AND sku_id = 'Brand#7')
SELECT *, cur - prev AS delta FROM (SELECT * FROM t UNION ALL
 SELECT '(unattributed)', w.cur - ifnull((SELECT sum(cur) FROM t), 0), w.prev - ifnull((SELECT sum(prev) FROM t), 0) FROM w)""", r="cur prev delta"),
    "d15_mom_totals": fin(f"""SELECT sum(net_cost) AS net, coalesce(sum(cost_delta), 0) AS delta, coalesce(sum(volume_effect), 0) AS vol,
  coalesce(sum(rate_effect), 0) AS rate, count(prev_cost) AS comparable FROM v_mom WHERE provider_name = 'Databricks' AND charge_month = {CUR}""", r="net delta vol rate"),
    "d16_cost_subcategory_split": fin(f"SELECT service_name, cost_subcategory, sum(net_cost) AS net_cost FROM v_sub WHERE {R} GROUP BY ALL", r="net_cost"),
    "d16_credits_detail": fin(f"""SELECT charge_month, charge_description, charge_category, service_name, sum(net_cost) AS net_cost,
  sum(line_count) AS line_count FROM v_cred WHERE provider_name = 'AWS' AND {R} GROUP BY ALL""", big="line_count", r="net_cost"),
    "d17_latest_month_movers": fin("""SELECT sku_id, charge_month, net_cost, cost_delta, cost_pct_change FROM v_mom WHERE provider_name = 'Databricks'
AND charge_month = DATE '2001-09-01' ORDER BY net_cost DESC, sku_id LIMIT 20"""),
    "d17_sku_compare": fin(f"""
SELECT sku_id, sku_description, c AS net_cost, c - p AS cost_delta, CASE WHEN p <> 0 THEN 100 * ((c - p) / p) END AS cost_pct_change FROM (
 SELECT sku_id, arg_max(sku_description, {{'n': net_cost, 'd': sku_description}}) FILTER (WHERE sku_description IS NOT NULL) AS sku_description,
  {at('net_cost', CUR)} AS c, {at('net_cost', PRV)} AS p FROM v_sku WHERE provider_name = 'AWS' AND charge_month IN ({CUR}, {PRV}) GROUP BY 1)
ORDER BY 3 DESC, 1 LIMIT 20""", r="net_cost cost_delta cost_pct_change"),
    "d18_spend_alert": fin(f"""
SELECT provider_name, sum(net_cost) FILTER (WHERE charge_month BETWEEN DATE '1998-01-01' AND DATE '1998-06-30') AS window_net, {CUR} AS cmp_month,
  {PRV} AS prior_month, {at('net_cost', CUR)} AS cur_net, {at('net_cost', PRV)} AS prior_net FROM v_bill GROUP BY 1""", r="window_net cur_net prior_net"),
    "d18_alert_movers": fin(f"""
SELECT * EXCLUDE (i) FROM (SELECT *, row_number() OVER (PARTITION BY provider_name ORDER BY abs(cost_delta) DESC, driver) AS i FROM (
 SELECT provider_name, service_name AS driver, c - p AS cost_delta, CASE WHEN p <> 0 THEN 100 * ((c - p) / p) END AS cost_pct_change FROM (
  SELECT provider_name, service_name, {at('net_cost', CUR)} AS c, {at('net_cost', PRV)} AS p FROM v_service WHERE provider_name <> 'Databricks'
   AND charge_month IN ({CUR}, {PRV}) GROUP BY ALL)
 UNION ALL SELECT provider_name, driver, cost_delta, cost_pct_change FROM mv WHERE type = 'SKU')) WHERE i <= 10""", r="cost_delta cost_pct_change"),
    "d19_cross_provider_movers": fin("SELECT * FROM mv ORDER BY abs(cost_delta) DESC LIMIT 8", r="cost_delta cost_pct_change"),
    "d20_best_action_per_entity": fin(f"""SELECT charge_month, entity_type, entity_id, lens, recoverable_cost AS potential_savings, findings, waste_category,
  confidence, detail, provider_name, entity_name FROM ({BEST})""", r="potential_savings"),
    "d20_action_groups": fin(f"""SELECT charge_month, entity_type, lens, sum(recoverable_cost) AS potential_savings, count(*) AS entities,
  coalesce(sum(recoverable_cost) FILTER (WHERE confidence = 'high'), 0) AS high_confidence FROM ({BEST}) GROUP BY ALL""", r="potential_savings high_confidence"),
    "d20_action_potential_by_month": fin(f"SELECT charge_month, lens, sum(recoverable_cost) AS potential_savings FROM ({BEST}) GROUP BY ALL", r="potential_savings"),
    "d20_action_potential_by_month_all_lanes": fin(f"SELECT charge_month, sum(recoverable_cost) AS potential_savings FROM ({BEST_ANY}) GROUP BY ALL", r="potential_savings"),
    "d21_entity_findings": fin("""
SELECT charge_month, provider_name, entity_type, entity_id, lens, waste_category, detail, recoverable_cost AS rule_estimate,
  CASE WHEN row_number() OVER (PARTITION BY charge_month, entity_id, lens ORDER BY recoverable_cost DESC, waste_category DESC) = 1
   THEN recoverable_cost ELSE 0 END AS potential_savings FROM findings""", r="rule_estimate potential_savings"),
    "d22_completed_months": fin("SELECT DISTINCT charge_month FROM findings WHERE charge_month < DATE '2001-10-01'"),
    "d22_mom_recoverable_delta": fin(f"""
SELECT lens, round(sum(CASE charge_month WHEN DATE '2001-09-01' THEN recoverable_cost WHEN DATE '2001-08-01' THEN -recoverable_cost ELSE 0 END), 2)
  AS recoverable_delta FROM ({BEST}) WHERE charge_month < DATE '2001-10-01' GROUP BY 1"""),
    "d23_measurement_coverage": fin("""
SELECT provider_name, charge_month, count(*) AS total, count(util) AS measured,
  count(*) FILTER (WHERE util IS NULL AND et IN ('sql_warehouse', 'sql_warehouse_user', 'query_pattern')) AS not_applicable,
  count(*) FILTER (WHERE util IS NULL AND et NOT IN ('sql_warehouse', 'sql_warehouse_user', 'query_pattern')) AS unmeasured,
  coalesce(max(util) >= 100, false) AS pegged FROM ent GROUP BY ALL"""),
    "d24_rule_coverage": fin("""
WITH m AS (SELECT DISTINCT provider_name, charge_month, entity_type FROM ent),
 f AS (SELECT provider_name, charge_month, waste_category, count(*) AS n, sum(recoverable_cost) AS rc FROM findings GROUP BY ALL)
SELECT pm.provider_name, pm.charge_month, s.entity_type, s.waste_category, s.lens,
  CASE WHEN n > 0 THEN 'fired' WHEN s.entity_type = '' OR m.entity_type IS NOT NULL THEN 'clean' ELSE 'no data' END AS status,
  ifnull(n, 0) AS entities, CASE WHEN rc > 0 THEN rc END AS recoverable
FROM (SELECT DISTINCT provider_name, charge_month FROM m) pm JOIN scope s ON s.provider_name = pm.provider_name
LEFT JOIN f ON f.provider_name = pm.provider_name AND f.charge_month = pm.charge_month AND f.waste_category = s.waste_category
LEFT JOIN m ON m.provider_name = pm.provider_name AND m.charge_month = pm.charge_month AND m.entity_type = s.entity_type""", r="recoverable"),
    "w40_rule_scope": fin("""SELECT s.*, n AS entity_months FROM scope s JOIN (SELECT provider_name, entity_type, count(*) AS n FROM ent GROUP BY ALL)
USING (provider_name, entity_type)"""),
    "w40_rule_scope_all": fin("""SELECT s.*, e.entity_type AS measured_entity_type, e.n AS entity_months FROM scope s
JOIN (SELECT provider_name, entity_type, count(*) AS n FROM ent GROUP BY ALL) e
  ON e.provider_name = s.provider_name AND (s.entity_type = '' OR s.entity_type = e.entity_type)"""),
    "d25_first_seen_context": fin(f"""SELECT b.charge_month, b.entity_type, b.entity_id, b.lens, recoverable_cost AS potential_savings, first_seen_month FROM ({BEST}) b
LEFT JOIN (SELECT entity_type, entity_id, lens, min(charge_month) AS first_seen_month FROM findings GROUP BY ALL) USING (entity_type, entity_id, lens)""", r="potential_savings"),
    "d26_driver_staleness": fin("""
WITH p AS (SELECT provider_name, ifnull(cluster_id, '') AS cluster_id, charge_month, executed_by, client_driver,
   ifnull(split_part(client_driver, ' ', 1), '') AS driver_family, ifnull(split_part(client_driver, ' ', 2), '') AS driver_version,
   list_transform(string_split(split_part(client_driver, ' ', 2), '.'), lambda x: x::INT) AS k FROM driver_health),
 n AS (SELECT provider_name, cluster_id, driver_family, max(k) AS k FROM p GROUP BY ALL)
SELECT p.* EXCLUDE (k), ifnull(list_aggregate(list_transform(n.k, lambda x: x::VARCHAR), 'string_agg', '.'), '') AS newest_seen_version,
  CASE WHEN p.k IS NULL THEN 'unknown' WHEN p.k < n.k THEN 'behind' ELSE 'current' END AS status
FROM p JOIN n USING (provider_name, cluster_id, driver_family)"""),
    "d27_latest_policy_status": fin("SELECT * FROM polnew"),
    "d27_policy_compliance": fin("""SELECT policy_category, count(*) FILTER (WHERE status = 'non_compliant') AS non_compliant,
  count(*) FILTER (WHERE status = 'compliant') AS compliant, count(*) FILTER (WHERE status = 'not_applicable') AS not_evaluated,
  100.0 * count(*) FILTER (WHERE status = 'compliant') / nullif(count(*) FILTER (WHERE status <> 'not_applicable'), 0) AS compliance_pct
FROM polnew GROUP BY 1""", r="compliance_pct"),
    "d28_redshift_spend_partition": fin(f"""
SELECT CASE WHEN resource_id LIKE '%:cluster:%' THEN split_part(resource_id, ':cluster:', 2) WHEN resource_id LIKE '%:snapshot:%' THEN '(snapshot storage)'
  ELSE '(other Redshift resource)' END AS cluster, sku_id, arg_max(sku_description, {{'n': net_cost, 'd': sku_description}})
  FILTER (WHERE sku_description IS NOT NULL) AS description, sum(net_cost) AS net_cost
FROM v_res WHERE service_name LIKE 'Amazon Redshift%' AND resource_id <> '(none)' AND {R} GROUP BY ALL""", r="net_cost"),
    "d29_cluster_components": fin(f"""SELECT * FROM (SELECT cluster_id, cost_subcategory, sum(gross_cost) AS gross_cost FROM v_clu WHERE {R} GROUP BY ALL)
WHERE gross_cost <> 0""", r="gross_cost"),
    "d29_component_charges": fin(f"""SELECT sku_id, arg_max(sku_description, {{'n': ifnull(gross_cost, -1e18), 'd': sku_description}}) FILTER (WHERE sku_description IS NOT NULL)
  AS sku_description, sum(gross_cost) AS gross_cost FROM v_clu WHERE cluster_id = 'cl-3' AND cost_subcategory = 'storage' AND {R} GROUP BY 1""", r="gross_cost"),
    "d30_spectrum_table_cost": fin("""SELECT entity_name AS external_table, charge_month, spectrum_scan_count AS scans, spectrum_scanned_gb AS scanned_gb,
  spectrum_returned_gb AS returned_gb, spectrum_allocated_cost AS allocated_cost, round(100 * (spectrum_returned_gb / nullif(spectrum_scanned_gb, 0)), 1) AS return_pct,
  round(spectrum_allocated_cost * 0.3::DOUBLE, 2) AS estimated_recovery FROM ent
WHERE provider_name = 'AWS' AND et = 'table' AND spectrum_allocation_status = 'allocated'"""),
    "d31_compute_heavy_tables": fin("""SELECT entity_name AS table_name, owner_user, table_weighted_exec_seconds AS weighted_exec_seconds,
  table_compute_share_pct AS compute_share_pct, table_scan_gb AS scan_gb, activity_count AS query_count, table_rows_pre_filter AS rows_pre_filter,
  table_rows_returned AS rows_returned, round(100 * (table_rows_returned::DOUBLE / table_rows_pre_filter::DOUBLE), 1) AS return_pct
FROM v_inv WHERE table_weighted_exec_seconds IS NOT NULL"""),
    "d32_capacity_state": fin("""
SELECT entity_id, cluster_cpu_utilization_avg_pct AS cpu_avg, cluster_cpu_utilization_max_pct AS cpu_max, wlm_queue_wait_ms_p95 AS queue_p95,
  CASE WHEN cluster_cpu_utilization_avg_pct IS NULL THEN 'Insufficient capacity telemetry'
   WHEN cluster_cpu_utilization_avg_pct < 25 AND cluster_cpu_utilization_max_pct < 50 AND wlm_queue_wait_ms_p95 < 1000
     AND disk_spill_query_count * 100 < activity_count THEN 'Likely underused'
   WHEN cluster_cpu_utilization_max_pct >= 90 AND (wlm_queue_wait_ms_p95 >= 5000 OR disk_spill_query_count * 50 >= activity_count
     OR concurrency_scaling_active_seconds > 0) THEN 'Likely constrained' ELSE 'Balanced / mixed' END AS state FROM v_crow"""),
    "d33_billed_vs_instrumented_clusters": fin("""
SELECT cluster_id, max(b) AS is_billed, max(i) AS is_instrumented FROM (
 SELECT split_part(resource_id, ':cluster:', 2) AS cluster_id, true AS b, false AS i FROM v_res WHERE service_name LIKE 'Amazon Redshift%' AND resource_id LIKE '%:cluster:%'
 UNION ALL SELECT cluster_id, false, true FROM cap) GROUP BY 1"""),
    "d34_total_cost_of_ownership": fin(f"""
SELECT charge_month, sum(p) AS platform_cost, sum(s) AS storage_cost, sum(c) AS compute_cost, sum(p + s + c) AS total_cost FROM (
 SELECT charge_month, net_cost AS p, 0 AS s, 0 AS c FROM v_bill WHERE provider_name = 'Databricks'
 UNION ALL SELECT charge_month, 0, CASE WHEN service_name = 'Databricks Storage' THEN net_cost ELSE 0 END,
   CASE WHEN service_name = 'Databricks Compute' THEN net_cost ELSE 0 END FROM {MAPPED}) WHERE {R} GROUP BY 1""",
        r="platform_cost storage_cost compute_cost total_cost"),
    "d35_headline_month": fin("SELECT max(charge_month) AS headline_month FROM v_bill WHERE charge_month BETWEEN DATE '1996-01-01' AND DATE '2001-09-01'"),
    "d35_credits_by_provider": fin(f"SELECT provider_name, sum(net_cost) AS credits FROM v_cred WHERE charge_month = {CUR} GROUP BY 1", r="credits"),
    "d35_recoverable_by_provider": fin(_RECOV, r="potential_savings"),
    "d35_recoverable_by_provider_with_account": fin(f"SELECT * FROM ({_RECOV}) UNION ALL SELECT 'Snowflake', total FROM v_hws", r="potential_savings"),
    "d35_provider_history": fin(f"""
SELECT * FROM (SELECT charge_month, provider_name, sum(c) AS cost FROM (
 SELECT charge_month, provider_name, gross_cost AS c FROM v_bill WHERE provider_name <> 'Snowflake' AND {R}
 UNION ALL SELECT charge_month, 'Databricks', gross_cost FROM {MAPPED} WHERE {R}
 UNION ALL SELECT (month - to_months(300))::DATE, 'Snowflake', tco FROM v_tco WHERE type = 'Actual'
   AND (month - to_months(300))::DATE BETWEEN DATE '1996-01-01' AND DATE '1999-12-01') GROUP BY ALL) WHERE abs(cost) > 1e-9""", r="cost"),
    "d36_home_movers": fin(f"""
WITH b AS (SELECT service_name AS driver, {at('gross_cost', CUR)} AS c, {at('gross_cost', PRV)} AS p FROM {MAPPED} GROUP BY 1),
 s AS (SELECT 4 * coalesce(sum(credits_used) FILTER (WHERE strftime(start_time, '%Y-%m') = '2023-12'), 0)::DOUBLE AS c,
   4 * coalesce(sum(credits_used) FILTER (WHERE strftime(start_time, '%Y-%m') = '2023-11'), 0)::DOUBLE AS p FROM au_warehouse_metering_history)
SELECT * FROM (SELECT * FROM (SELECT * FROM mv WHERE provider_name <> 'Snowflake' UNION ALL
  SELECT 'Databricks', driver, c - p, round(100 * ((c - p) / nullif(p, 0)), 1), split_part(driver, ' ', 2) FROM b WHERE c <> p) ORDER BY abs(cost_delta) DESC LIMIT 7)
UNION ALL SELECT 'Snowflake', 'Compute', c - p, round(100 * ((c - p) / p), 1), 'Compute' FROM s""", r="cost_delta cost_pct_change"),
    "d37_ai_by_product": fin("""SELECT ifnull(ai_product_family, 'Unmapped AI product') AS product, sum(net_cost) AS net_cost, count(DISTINCT resource_id) AS resources
FROM v_ai GROUP BY 1""", r="net_cost"),
    "d37_ai_by_resource": fin("""SELECT resource_name, ifnull(ai_product_family, 'Unmapped AI product') AS product, sku_id, consumed_unit, sum(net_cost) AS net_cost,
  sum(consumed_quantity) AS consumed_quantity FROM v_ai GROUP BY ALL""", r="net_cost consumed_quantity"),
    "d37_ai_by_tag": fin("SELECT coalesce(tags->>'$.team', tags->>'$.Team', '(untagged)') AS tag_value, sum(net_cost) AS net_cost FROM v_ai GROUP BY 1", r="net_cost"),
    "d38_token_rollup_by_user": fin(basis("v_rqm", "requester_display"), big=_TOK, r2="allocated_cost"),
    "d38_token_rollup_by_project": fin(basis("v_prj", "project_key"), big=_TOK, r2="allocated_cost"),
    "d39_model_economics": fin("""SELECT model_name, model_kind, serving_mode, sum(total_tokens) AS total_tokens, sum(request_count) AS request_count,
  sum(allocated_cost) AS allocated_cost, 1e6 * (sum(allocated_cost) / sum(total_tokens) FILTER (WHERE allocated_cost IS NOT NULL)) AS cost_per_million_tokens,
  count(DISTINCT endpoint_id) AS endpoints FROM v_mod GROUP BY ALL""", big="total_tokens request_count", r2="allocated_cost cost_per_million_tokens"),
    "d39_endpoint_findings": fin("""SELECT waste_category, lens, confidence, count(DISTINCT entity_id) AS endpoints, sum(recoverable_cost) AS recoverable_cost
FROM findings WHERE entity_type = 'endpoint' GROUP BY ALL""", r="recoverable_cost"),
    "d40_managed_clusters": fin("""SELECT cluster_id, cluster_name, owner_user, sum(net_cost) AS net_cost, count(DISTINCT instance_id) AS instance_count
FROM v_bco WHERE mapping = 'databricks' GROUP BY ALL""", r="net_cost"),
    "d40_pricing_trend": fin("SELECT charge_month, pricing_category, sum(net_cost) AS net_cost FROM v_bco WHERE mapping = 'databricks' GROUP BY ALL", r="net_cost"),
    "d40_managed_storage": fin("""SELECT bucket_name, managed_name, managed_kind, mapping_confidence, sum(net_cost) AS net_cost FROM v_bst
WHERE mapping = 'databricks' GROUP BY ALL""", r="net_cost"),
    "d40_subcategory_trend": fin("SELECT charge_month, cost_subcategory, sum(net_cost) AS net_cost FROM v_bst WHERE mapping = 'databricks' GROUP BY ALL", r="net_cost"),
    "d41_turn_usage": fin("""SELECT count(*) AS turns, count(duration_ms) AS timed_turns,
  count(*) FILTER (WHERE outcome = 'answer' AND duration_ms IS NOT NULL) / count(duration_ms) AS answered_share,
  count(*) FILTER (WHERE answer_source IN ('caption', 'summary_spec')) / count(answer_source) AS without_model_share,
  count(*) FILTER (WHERE route = 'deterministic') / count(route) AS fast_share, sum(total_tokens) AS total_tokens, sum(tool_call_count) AS tool_calls,
  quantile_cont(duration_ms, 0.5) AS median_ms, quantile_cont(duration_ms, 0.9) AS p90_ms,
  quantile_cont(plan_ms, 0.5) FILTER (WHERE duration_ms IS NOT NULL) AS plan_median_ms,
  quantile_cont(explore_ms, 0.5) FILTER (WHERE duration_ms IS NOT NULL) AS explore_median_ms,
  quantile_cont(execute_ms, 0.5) FILTER (WHERE duration_ms IS NOT NULL) AS execute_median_ms,
  quantile_cont(synthesize_ms, 0.5) FILTER (WHERE duration_ms IS NOT NULL) AS synthesize_median_ms FROM turn_log""", big="total_tokens tool_calls",
        r="answered_share without_model_share fast_share median_ms p90_ms plan_median_ms explore_median_ms execute_median_ms synthesize_median_ms"),
    "d42_ai_kpis": fin("""SELECT sum(net_cost) AS ai_spend, count(DISTINCT resource_id) AS resources, coalesce(sum(net_cost) FILTER (WHERE project_tag IS NULL), 0) AS untagged_spend,
  (SELECT sum(total_tokens) FROM v_epm) AS measured_tokens,
  (SELECT 1e6 * (sum(net_cost) / sum(total_tokens)) FROM v_epm WHERE cost_allocation_basis = 'measured_tokens') AS cost_per_million_tokens FROM v_ai""",
        big="measured_tokens", r="ai_spend untagged_spend cost_per_million_tokens"),
    "d43_redshift_tag_keys": fin(f"""SELECT replace(lower(tag_key), '-', '_') AS tag_key_normalized, sum(net_cost) AS net_cost FROM v_skutag
WHERE provider_name = 'AWS' AND {R} AND sku_id IN (SELECT sku_id FROM v_res WHERE service_name LIKE 'Amazon Redshift%') GROUP BY 1""", r="net_cost"),
    "d43_redshift_tag_values": fin(f"""SELECT tag_value, sum(net_cost) AS net_cost FROM v_skutag WHERE provider_name = 'AWS' AND lower(tag_key) = 'team' AND {R}
AND sku_id IN (SELECT sku_id FROM v_res WHERE service_name LIKE 'Amazon Redshift%') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""", r="net_cost"),
}
