"""Comparison SQL for the spend views."""

from __future__ import annotations

from oracles.planes import fin

CHARGES = "sum(CASE WHEN is_credit THEN NULL ELSE cost END)"
CREDITS = "sum(CASE WHEN is_credit THEN cost END)"
FAMILY = """CASE WHEN service_name IN ('ALL_PURPOSE','INTERACTIVE','NOTEBOOKS','SHARED_SERVERLESS_COMPUTE')
  THEN 'interactive' WHEN service_name IN ('JOBS','DLT') THEN 'job'
  WHEN service_name = 'SQL' THEN 'sql_warehouse' WHEN service_name = 'MODEL_SERVING' THEN 'endpoint' END"""
DESC = """arg_max(regexp_replace(charge_description, 'arn:aws:\\S+', 'a reservation'),
  {'c': cost, 'd': regexp_replace(charge_description, 'arn:aws:\\S+', 'a reservation')})
  FILTER (WHERE charge_description IS NOT NULL)"""
SKU = "coalesce(sku_id, '(unknown)')"
RES = """coalesce(resource_type, '(none)') AS resource_type, coalesce(resource_id, '(none)') AS resource_id,
  coalesce(resource_name, resource_id, '(unattributed)') AS resource_name,
  coalesce(sub_account_id, '(none)') AS sub_account_id, coalesce(region_id, '(none)') AS region_id"""
TAGGED = "sum(CASE WHEN NOT is_credit AND tags <> '{}' THEN cost END)"
UNTAGGED = "sum(CASE WHEN NOT is_credit AND tags = '{}' THEN cost END)"

ORACLES = {
    "g1_monthly_bill": fin(f"""
SELECT provider_name, charge_month, sum(cost) AS net_cost, {CHARGES} AS gross_cost, {CREDITS} AS credit_cost,
  sum(list_cost) AS list_cost, sum(list_cost - cost) AS savings,
  max(is_partial_period) AS is_partial_period, min(billing_currency) AS currency
FROM pbill GROUP BY ALL""", "net_cost gross_cost credit_cost list_cost savings"),
    "g2_spend_by_service_month": fin(f"""
SELECT provider_name, service_category, service_name, charge_month, sum(cost) AS net_cost,
  {CHARGES} AS gross_cost, {CREDITS} AS credit_cost, sum(list_cost) AS list_cost,
  sum(list_cost - cost) AS savings, max(is_partial_period) AS is_partial_period,
  max(x_effective_is_list) AS effective_is_list, min(billing_currency) AS currency
FROM pbill GROUP BY ALL""", "net_cost gross_cost credit_cost list_cost savings"),
    "g3_spend_by_sku_month": fin(f"""
SELECT provider_name, service_name, {FAMILY} AS compute_family, {SKU} AS sku_id, charge_month,
  {DESC} AS sku_description, sum(cost) AS net_cost, sum(billed_cost) AS billed_cost, {CHARGES} AS gross_cost,
  sum(consumed_quantity) AS consumed_quantity, max(consumed_unit) AS consumed_unit,
  max(is_partial_period) AS is_partial_period
FROM pbill GROUP BY ALL""", "net_cost billed_cost gross_cost", r="consumed_quantity"),
    "g4_spend_by_cost_subcategory_month": fin("""
SELECT provider_name, service_name, x_cost_subcategory AS cost_subcategory, charge_month,
  sum(cost) AS net_cost, max(is_partial_period) AS is_partial_period
FROM pbill WHERE x_cost_subcategory IS NOT NULL GROUP BY ALL""", "net_cost"),
    "g5_resource_month": fin(f"""
SELECT provider_name, service_name, {FAMILY} AS compute_family, {SKU} AS sku_id, {RES}, charge_month,
  {DESC} AS sku_description, sum(cost) AS net_cost, {CHARGES} AS gross_cost,
  sum(consumed_quantity) AS consumed_quantity, max(consumed_unit) AS consumed_unit,
  max(is_partial_period) AS is_partial_period
FROM pbill GROUP BY ALL""", "net_cost gross_cost", r="consumed_quantity"),
    "g6_redshift_cluster_cost_month": fin(f"""
SELECT provider_name, service_name,
  CASE WHEN position(':cluster:' IN coalesce(resource_id, '')) > 0 THEN split_part(resource_id, ':cluster:', 2)
    ELSE '(not assigned to a cluster)' END AS cluster_id,
  coalesce(x_cost_subcategory, '(unclassified)') AS cost_subcategory, {SKU} AS sku_id, charge_month,
  {DESC} AS sku_description, sum(cost) AS net_cost, {CHARGES} AS gross_cost,
  max(is_partial_period) AS is_partial_period
FROM pbill WHERE service_name LIKE 'Amazon Redshift%' GROUP BY ALL""", "net_cost gross_cost"),
    "g7_spend_by_sku_tag_month": fin(f"""
SELECT provider_name, {SKU} AS sku_id, tag_key, tag_value, charge_month, sum(cost) AS net_cost
FROM tagrows GROUP BY ALL""", "net_cost"),
    "g8_spend_by_workspace_month": fin(f"""
SELECT provider_name, coalesce(sub_account_id, '(none)') AS sub_account_id, charge_month, sum(cost) AS net_cost,
  {CHARGES} AS gross_cost, max(is_partial_period) AS is_partial_period FROM pbill GROUP BY ALL""",
        "net_cost gross_cost"),
    "g9_spend_by_tag_month": fin(f"""
SELECT tag_key, tag_value, provider_name, charge_month, sum(cost) AS net_cost, {CHARGES} AS gross_cost,
  max(is_partial_period) AS is_partial_period FROM tagrows GROUP BY ALL""", "net_cost gross_cost"),
    "g10_spend_tag_coverage_month": fin(f"""
SELECT *, CASE WHEN gross_cost > 0 THEN round(100 * tagged_cost::DOUBLE / gross_cost::DOUBLE, 1) END AS tagged_pct
FROM (SELECT provider_name, charge_month, sum(cost) AS net_cost, {CHARGES} AS gross_cost,
  {TAGGED} AS tagged_cost, {UNTAGGED} AS untagged_cost, max(is_partial_period) AS is_partial_period
FROM pbill GROUP BY ALL)""", "net_cost gross_cost tagged_cost untagged_cost"),
    "g11_spend_untagged_by_service_month": fin(f"""
SELECT *, CASE WHEN gross_cost > 0 THEN round(100 * tagged_cost::DOUBLE / gross_cost::DOUBLE, 1) END AS tagged_pct
FROM (SELECT provider_name, service_name, charge_month, {CHARGES} AS gross_cost,
  coalesce({TAGGED}, 0) AS tagged_cost, coalesce({UNTAGGED}, 0) AS untagged_cost,
  max(is_partial_period) AS is_partial_period
FROM pbill GROUP BY ALL)""", "gross_cost tagged_cost untagged_cost"),
    "g12_spend_untagged_by_resource_month": fin(f"""
SELECT provider_name, service_name, {SKU} AS sku_id, {RES}, charge_month, sum(cost) AS untagged_cost,
  max(is_partial_period) AS is_partial_period
FROM pbill WHERE tags = '{{}}' AND NOT is_credit GROUP BY ALL""", "untagged_cost"),
    "g13_savings_summary_month": fin("""
SELECT *, CASE WHEN list_cost > 0 THEN round(100 * savings::DOUBLE / list_cost::DOUBLE, 1) ELSE 0 END AS savings_pct
FROM (SELECT provider_name, charge_month, sum(list_cost) AS list_cost, sum(cost) AS effective_cost,
  sum(list_cost - cost) AS savings, max(x_effective_is_list) AS effective_is_list,
  max(is_partial_period) AS is_partial_period FROM pbill GROUP BY ALL)""", "list_cost effective_cost savings"),
    "g14_credits_month": fin("""
SELECT provider_name, charge_month, charge_category, service_name,
  coalesce(charge_description, '(no description)') AS charge_description, sum(cost) AS net_cost,
  count(*) AS line_count, max(is_partial_period) AS is_partial_period
FROM pbill WHERE charge_category IN ('Adjustment', 'Credit') GROUP BY ALL""", "net_cost"),
    "g15_spend_trend_daily": fin(f"""
SELECT charge_day, provider_name, service_name, sum(cost) AS net_cost, {CHARGES} AS gross_cost,
  max(is_partial_period) AS is_partial_period FROM pbill GROUP BY ALL""", "net_cost gross_cost"),
    "g16_sku_month_over_month": fin(f"""
SELECT m.provider_name, m.sku_id, m.charge_month, m.is_partial_period, m.c AS net_cost, m.q AS consumed_quantity,
  CASE WHEN m.q > 0 THEN m.c::DOUBLE / m.q END AS unit_rate, p.c AS prev_cost, m.c - p.c AS cost_delta,
  CASE WHEN p.c > 0 THEN round(100 * (m.c - p.c)::DOUBLE / p.c::DOUBLE, 1) END AS cost_pct_change,
  m.q - p.q AS qty_delta,
  CASE WHEN p.q > 0 THEN (m.q - p.q) * (p.c::DOUBLE / p.q) END AS volume_effect,
  (m.c - p.c)::DOUBLE - CASE WHEN p.q > 0 THEN (m.q - p.q) * (p.c::DOUBLE / p.q) ELSE 0 END AS rate_effect
FROM (SELECT *, row_number() OVER (PARTITION BY provider_name, sku_id ORDER BY charge_month) AS i FROM (
   SELECT provider_name, {SKU} AS sku_id, charge_month, sum(cost) AS c, sum(consumed_quantity) AS q,
     max(is_partial_period) AS is_partial_period FROM pbill GROUP BY ALL)) m
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY provider_name, sku_id ORDER BY charge_month) AS i FROM (
   SELECT provider_name, {SKU} AS sku_id, charge_month, sum(cost) AS c, sum(consumed_quantity) AS q
   FROM pbill GROUP BY ALL)) p
 ON p.provider_name = m.provider_name AND p.sku_id = m.sku_id AND p.i = m.i - 1""",
        "net_cost prev_cost cost_delta"),
    "g17_commitment_summary_month": fin("""
SELECT provider_name, charge_month, commitment_discount_type, commitment_discount_category,
  commitment_discount_status, sum(cost) AS effective_cost, sum(billed_cost) AS billed_cost,
  count(DISTINCT commitment_discount_id) AS commitment_count
FROM pbill WHERE commitment_discount_id IS NOT NULL GROUP BY ALL""", "effective_cost billed_cost"),
    "g18_invoice_reconciliation_month": fin("""
SELECT provider_name, billing_account_id, invoice_id, charge_month, sum(billed_cost) AS billed_cost
FROM pbill WHERE invoice_id IS NOT NULL GROUP BY ALL""", "billed_cost"),
    "g19_spend_by_tag_key_month": fin("""
SELECT provider_name, charge_month, translate(lower(tag_key), '-', '_') AS tag_key_normalized,
  list_aggregate(list_sort(list(DISTINCT tag_key)), 'string_agg', ' · ') AS tag_key_variants,
  count(DISTINCT tag_key) AS variant_count, sum(cost) AS net_cost, count(DISTINCT tag_value) AS tag_value_count
FROM tagrows WHERE NOT is_credit GROUP BY ALL""", "net_cost"),
    "g20_ai_spend_month": fin(f"""
SELECT provider_name, charge_month,
  CASE service_name WHEN 'MODEL_SERVING' THEN 'model_serving' WHEN 'AI_BI_GENIE' THEN 'genie' END AS ai_product_family,
  service_name, coalesce(resource_type, '(none)') AS resource_type, coalesce(resource_id, '(none)') AS resource_id,
  coalesce(resource_name, resource_id, '(unattributed)') AS resource_name, {SKU} AS sku_id,
  coalesce(consumed_unit, '(unknown)') AS consumed_unit,
  max(coalesce(tags->>'$.project', tags->>'$.Project')) AS project_tag, max(tags) AS tags,
  sum(cost) AS net_cost, {CHARGES} AS gross_cost, sum(consumed_quantity) AS consumed_quantity,
  max(is_partial_period) AS is_partial_period
FROM pbill WHERE service_name <> 'PREDICTIVE_OPTIMIZATION'
  AND (service_category = 'AI and Machine Learning' OR service_name = 'AI_BI_GENIE')
GROUP BY ALL""", "net_cost gross_cost", r="consumed_quantity"),
    "g21_spend_forecast_month": fin("""
WITH d AS (SELECT provider_name AS p, charge_day AS dd, date_trunc('month', charge_day)::DATE AS mm, sum(cost) AS c
  FROM pbill GROUP BY ALL),
 b AS (SELECT p, max(dd) - 1 AS last_day, date_trunc('month', max(dd) - 1)::DATE AS anchor FROM d GROUP BY p),
 full_months AS (SELECT d.p, d.mm, sum(d.c) AS c, count(*) AS n,
    row_number() OVER (PARTITION BY d.p ORDER BY d.mm DESC) AS i
  FROM d JOIN b USING (p) WHERE dd <= last_day AND d.mm < anchor GROUP BY d.p, d.mm),
 t AS (SELECT p, count(*) AS k, sum(c)::DOUBLE / count(*) AS avg_c, sum(n) AS days FROM full_months WHERE i <= 3 GROUP BY p)
SELECT b.p AS provider_name, anchor AS charge_month, 'run_rate' AS forecast_kind,
  round(sum(CASE WHEN dd <= last_day THEN c END)::DOUBLE / count(CASE WHEN dd <= last_day THEN 1 END)
    * day(last_day(anchor)), 2) AS forecast_cost,
  sum(c)::DOUBLE AS actual_to_date, count(CASE WHEN dd <= last_day THEN 1 END) AS history_days
FROM b JOIN d ON d.p = b.p AND d.mm = b.anchor GROUP BY b.p, anchor
UNION ALL
SELECT b.p, (anchor + to_months(g.n::INT))::DATE, 'trend', CASE WHEN k >= 3 THEN greatest(0, round(avg_c, 2)) END,
  NULL, coalesce(days, 0)
FROM b CROSS JOIN (VALUES (1), (2), (3)) AS g(n) LEFT JOIN t USING (p)""",
        "forecast_cost", big="history_days", r="actual_to_date"),
}
