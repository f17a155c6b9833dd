"""Comparison SQL for column functions and source mappings."""

from __future__ import annotations

import oracles.planes as planes
from oracles.planes import add, fin
from tallyspark.operators import mapping as mp
from tallyspark.sources import export_tables, telemetry_tables  # noqa: F401  (add their planes)
from tallyspark.sources.driver_tables import PLANES

for _k, _v in PLANES.items():
    planes.CTES.setdefault(_k, _v)

_HAVE = ("ProviderName BillingAccountId SubAccountId ChargePeriodStart ChargePeriodEnd BilledCost EffectiveCost ListCost ChargeCategory ChargeClass "
         "ChargeDescription ServiceCategory ServiceName SkuId RegionId PricingCategory ResourceId ConsumedQuantity Tags CommitmentDiscountId "
         "CommitmentDiscountCategory CommitmentDiscountStatus InvoiceId").split()


def z(c: str) -> str:
    return f"CASE WHEN upper(trim({c})) NOT IN ('', 'NULL', 'NONE', 'NAN') THEN trim({c}) END"


add("clean", "SELECT " + ", ".join(f"{z(c)} AS {c}" for c in _HAVE) + " FROM focus_export")
_KEY = "sha256(concat_ws('|', 'exporter', " + ", ".join(
    f"coalesce({c}, '')" if c in _HAVE else "''" for c in mp.FOCUS_COLUMNS + mp.RECORD_COLUMNS) + "))"
_SUB = """CASE WHEN {cat} = 'Credit' THEN NULL WHEN {svc} LIKE 'Amazon Redshift%' THEN CASE
   WHEN regexp_matches(t, 'spectrum|data scan') THEN 'spectrum_scan' WHEN t LIKE '%concurrency%' THEN 'concurrency_scaling'
   WHEN regexp_matches(t, 'storage|backup|snapshot') THEN 'storage' WHEN t LIKE '%unused commitment%' THEN NULL
   WHEN regexp_matches(t, 'compute|node|cluster|instance') THEN 'compute' ELSE 'other' END
  WHEN {svc} = 'Amazon Simple Storage Service' THEN CASE WHEN regexp_matches(t, 'earlydelete|early delet') THEN 'early_delete'
   WHEN regexp_matches(t, 'monitoring|automation') THEN 'monitoring' WHEN regexp_matches(t, 'data ?transfer|transfer acceleration|bandwidth') THEN 'data_transfer'
   WHEN regexp_matches(t, 'request|put, copy|retrieval|lifecycle transition|select') THEN 'requests'
   WHEN regexp_matches(t, 'bytehrs|storage|sizeoverhead') THEN 'storage' ELSE 'other' END END"""
_EMPTY = ("billing_account_name sub_account_name resource_name resource_type consumed_unit commitment_discount_type commitment_discount_name "
          "commitment_discount_unit invoice_issuer_name x_record_id x_record_type").split()


def word(c: str, ok: str, default: str = "NULL") -> str:
    return f"CASE WHEN {c} IN ({ok}) THEN {c} ELSE {default} END"


CATS = "'Usage', 'Credit', 'Adjustment', 'Tax', 'Purchase'"
SVCS = "'AI and Machine Learning', 'Analytics', 'Compute', 'Databases', 'Storage', 'Networking', 'Other'"
PRIC = "'Standard', 'Committed', 'Dynamic', 'Other'"
_BRONZE = f"""
SELECT DISTINCT {_KEY} AS dedupe_key, 'run-1' AS ingest_run_id, ProviderName AS provider_name, coalesce(BillingAccountId, 'unknown') AS billing_account_id,
  SubAccountId AS sub_account_id, ChargePeriodStart[1:10]::DATE AS billing_period_start,
  coalesce(ChargePeriodEnd, ChargePeriodStart)[1:10]::DATE AS billing_period_end, 'USD' AS billing_currency,
  coalesce(try_cast(BilledCost AS DECIMAL(20,6)), 0)::DOUBLE AS billed_cost, EffectiveCost::DECIMAL(20,6)::DOUBLE AS effective_cost,
  ListCost::DECIMAL(20,6)::DOUBLE AS list_cost, 0::DOUBLE AS contracted_cost, {word('ChargeCategory', CATS, "'Usage'")} AS charge_category,
  ChargeClass AS charge_class, ChargeDescription AS charge_description, {word('ServiceCategory', SVCS, "'Other'")} AS service_category,
  ServiceName AS service_name, SkuId AS sku_id, RegionId AS region_id, {word('PricingCategory', PRIC)} AS pricing_category, ResourceId AS resource_id,
  ConsumedQuantity::DOUBLE AS consumed_quantity, CASE WHEN Tags LIKE '{{%' THEN Tags ELSE '{{}}' END AS tags, CommitmentDiscountId AS commitment_discount_id,
  CommitmentDiscountCategory AS commitment_discount_category, CommitmentDiscountStatus AS commitment_discount_status,
  NULL::DOUBLE AS commitment_discount_quantity, InvoiceId AS invoice_id, 'n/a' AS x_compute_class, '1.3' AS x_focus_version, false AS x_effective_is_list,
  {_SUB.format(cat='ChargeCategory', svc='ServiceName')} AS x_cost_subcategory, 'exporter' AS x_source_connector, ChargePeriodStart[1:7] AS charge_month,
  {', '.join(f'NULL::VARCHAR AS {c}' for c in _EMPTY)}
FROM (SELECT *, lower(concat(ChargeDescription, ' ', SkuId)) AS t FROM clean)"""
add("brz", _BRONZE)


def n(keys: str, src: str) -> str:
    return f"SELECT {keys}, count(*) AS n FROM {src} GROUP BY ALL"


_RID = """CASE WHEN p = 'MODEL_SERVING' AND sku_name = 'ENTERPRISE_ALL_PURPOSE_COMPUTE' THEN cluster_id
  WHEN p IN ('VECTOR_SEARCH', 'DATABASE') AND sku_name LIKE 'ENTERPRISE_JOBS_SERVERLESS_COMPUTE%' THEN dlt_pipeline_id
  WHEN p = 'SQL' AND sku_name LIKE '%JOBS_SERVERLESS_COMPUTE%' THEN dlt_pipeline_id
  WHEN p = 'JOBS' THEN job_id WHEN p IN ('DLT', 'LAKEFLOW_CONNECT', 'ONLINE_TABLES') THEN dlt_pipeline_id WHEN p = 'ALL_PURPOSE' THEN cluster_id
  WHEN p IN ('INTERACTIVE', 'NOTEBOOKS') THEN notebook_id WHEN p = 'SQL' THEN warehouse_id
  WHEN p IN ('MODEL_SERVING', 'VECTOR_SEARCH', 'AI_GATEWAY', 'AI_FUNCTIONS') THEN endpoint_id
  WHEN p IN ('LAKEHOUSE_MONITORING', 'FINE_GRAINED_ACCESS_CONTROL') THEN tag_name
  WHEN p IN ('FOUNDATION_MODEL_TRAINING', 'AGENT_BRICKS', 'AI_RUNTIME', 'DATABASE', 'DATA_QUALITY_MONITORING', 'CLEAN_ROOM', 'DATA_SHARING',
    'DATA_CLASSIFICATION', 'BASE_ENVIRONMENTS', 'APPS') THEN object_id END"""
_RNAME = """CASE WHEN p = 'JOBS' THEN coalesce(job_name, job_id) WHEN p IN ('DLT', 'LAKEFLOW_CONNECT', 'ONLINE_TABLES') THEN coalesce(pn, dlt_pipeline_id)
  WHEN p = 'ALL_PURPOSE' THEN coalesce(cn, cluster_id) WHEN p IN ('INTERACTIVE', 'NOTEBOOKS') THEN coalesce(notebook_path, notebook_id)
  WHEN p = 'SQL' THEN coalesce(wn, warehouse_id) WHEN p IN ('MODEL_SERVING', 'VECTOR_SEARCH', 'AI_GATEWAY', 'AI_FUNCTIONS') THEN coalesce(endpoint_name, endpoint_id)
  WHEN p = 'APPS' THEN coalesce(endpoint_name, object_id)
  WHEN p IN ('FOUNDATION_MODEL_TRAINING', 'AGENT_BRICKS', 'AI_RUNTIME', 'DATABASE', 'CLEAN_ROOM', 'DATA_SHARING', 'BASE_ENVIRONMENTS') THEN object_id ELSE p END"""
_FACTS = ", ".join("('{}', '{}', '{}', '{}')".format(k, v[2], v[3], v[4]) for k, v in mp.PRODUCTS.items())


def newest(table: str, key: str, name: str, when: str) -> str:
    return (f"(SELECT workspace_id, {key}, {name} FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id, {key} ORDER BY {when} DESC) AS i "
            f"FROM {table}) WHERE i = 1)")


_RATE = ("LEFT JOIN (SELECT * FROM db_prices WHERE cloud = 'AWS') pr ON pr.sku_name = u.sku_name AND pr.account_id = u.account_id "
         "AND pr.usage_unit = u.usage_unit AND pr.price_start_time <= usage_end_time "
         "AND (pr.price_end_time IS NULL OR pr.price_end_time > usage_end_time)")
_URL = """
SELECT url, CASE WHEN url LIKE 'dbfs:%' THEN 'dbfs' ELSE lower(split_part(url, '://', 1)) END AS scheme,
  CASE lower(split_part(url, '://', 1)) WHEN 's3' THEN 'AWS' WHEN 's3a' THEN 'AWS' WHEN 'gs' THEN 'Google Cloud' WHEN 'abfss' THEN 'Microsoft' END AS cloud_provider_name,
  CASE WHEN contains(url, '://') THEN split_part(split_part(url, '://', 2), '/', 1) END AS bucket_name,
  CASE WHEN contains(url, '://') THEN nullif(trim(list_aggregate(string_split(split_part(url, '://', 2), '/')[2:], 'string_agg', '/'), '/'), '') END AS key_prefix
FROM {0}"""

ORACLES = {
    "m1_nz": fin(n("BillingAccountId AS account, ChargePeriodEnd IS NULL AS no_end, ResourceId IS NULL AS no_resource", "clean")),
    "m2_stringify_columns": fin(n("ProviderName, NULL::VARCHAR AS BillingCurrency, CASE WHEN Tags LIKE '{%' THEN Tags END AS Tags", "focus_export")),
    "m3_map_focus_to_bronze": fin("SELECT * FROM brz"),
    "m4_coerce_vocab": fin(n(f"{word('ChargeCategory', CATS, chr(39) + 'Usage' + chr(39))} AS charge_category, "
                             f"{word('ServiceCategory', SVCS, chr(39) + 'Other' + chr(39))} AS service_category, "
                             f"{word('PricingCategory', PRIC)} AS pricing_category, ChargeClass AS charge_class, "
                             "CommitmentDiscountCategory AS commitment_category", "clean")),
    "m5_coerce_money_and_time": fin("""SELECT try_cast(ChargePeriodEnd[1:10] AS DATE) AS end_day, sum(coalesce(try_cast(BilledCost AS DECIMAL(20,6)), 0)) AS billed,
  count(ChargePeriodEnd) AS dated FROM clean GROUP BY 1""", "billed"),
    "m6_valid_tags": fin(n("CASE WHEN json_valid(Tags) THEN Tags ELSE '{}' END AS tags", "focus_export")),
    "m7_dedupe_key": fin(n(f"{_KEY} AS dedupe_key", "clean")),
    "m8_dedupe_exact": fin("""SELECT provider_name, charge_month, count(*) AS n, sum(effective_cost::DECIMAL(20,6)) AS cost FROM brz GROUP BY ALL""", "cost"),
    "m9_assert_single_currency": fin(n("provider_name, billing_currency", "bill")),
    "m10_classify_cost_subcategory": fin(n("service_name, charge_category, " + _SUB.format(cat="charge_category", svc="service_name") + " AS cost_subcategory",
        "(SELECT *, lower(concat(charge_description, ' ', sku_id)) AS t FROM bill)")),
    "m11_compute_class": fin(n("CASE WHEN contains(sku_name, 'SERVERLESS') THEN 'serverless' ELSE 'classic' END AS compute_class, sku_name", "db_usage")),
    "m12_map_cost_explorer": fin("""
SELECT 'AWS' AS ProviderName, 'aws-cost-explorer' AS BillingAccountId, date_trunc('month', period_start)::DATE AS BillingPeriodStart,
  period_end AS BillingPeriodEnd, a AS BilledCost, a AS EffectiveCost, a AS ListCost, a AS ContractedCost, 'Usage' AS ChargeCategory,
  service || ' (Cost Explorer)' AS ChargeDescription, CASE WHEN service LIKE '%Redshift%' THEN 'Analytics' ELSE 'Other' END AS ServiceCategory, service AS ServiceName
FROM (SELECT *, try_cast(amount AS DOUBLE) AS a FROM ce_costs) WHERE a <> 0"""),
    "m13_map_snowflake_usage": fin("""
SELECT account_name AS SubAccountId, account_locator AS SubAccountName, date_trunc('month', usage_date)::DATE AS BillingPeriodStart,
  (date_trunc('month', usage_date) + INTERVAL 1 MONTH)::DATE AS BillingPeriodEnd,
  CASE WHEN usage_in_currency < 0 OR billing_type IN ('REBATE', 'support_credit') THEN 'Credit' WHEN is_adjustment THEN 'Adjustment' ELSE 'Usage' END AS ChargeCategory,
  usage_type AS ChargeDescription, CASE service_type WHEN 'warehouse_metering' THEN 'Compute' WHEN 'QUERY_ACCELERATION' THEN 'Compute' WHEN 'STORAGE' THEN 'Storage'
   WHEN 'REPLICATION' THEN 'Networking' WHEN 'AI_SERVICES' THEN 'AI and Machine Learning' ELSE 'Other' END AS ServiceCategory, service_type AS ServiceName,
  sum(usage_in_currency) AS cost, sum(usage) AS quantity, count(*) AS n
FROM sf_org_usage WHERE usage_in_currency IS NOT NULL AND usage_date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' GROUP BY ALL""", "cost", r="quantity"),
    "m14_map_databricks_usage": fin(f"""
SELECT workspace_name AS SubAccountName, date_trunc('month', usage_date)::DATE AS BillingPeriodStart, CASE WHEN price IS NOT NULL THEN 'USD' END AS BillingCurrency,
  CASE cloud WHEN 'AWS' THEN 'Amazon Web Services' ELSE 'Microsoft Azure' END AS HostProviderName, coalesce({_RID}, p) AS ResourceId, {_RNAME} AS ResourceName,
  coalesce(f.ty, p) AS ResourceType, coalesce(f.ca, 'Other') AS ServiceCategory, p AS ServiceName,
  CASE WHEN p = 'INTERACTIVE' AND contains(sku_name, 'SERVERLESS') THEN 'Serverless Compute' ELSE coalesce(f.su, 'Other (Other)') END AS ServiceSubcategory,
  sku_name AS SkuId, CAST(json_merge_patch('{{}}', json_object('x_is_photon', is_photon::VARCHAR, 'x_jobs_tier', jobs_tier)) AS VARCHAR) AS SkuPriceDetails,
  sum(ifnull(usage_quantity * price, 0)) AS cost, sum(ifnull(usage_quantity * price, 0)) AS list_cost, count(*) AS n
FROM (SELECT u.*, billing_origin_product AS p, price, pn.name AS pn, cn.cluster_name AS cn, wn.warehouse_name AS wn, workspace_name FROM db_usage u {_RATE}
 LEFT JOIN db_workspaces ws ON ws.workspace_id = u.workspace_id
 LEFT JOIN {newest('db_pipelines', 'pipeline_id', 'name', 'create_time')} pn ON pn.workspace_id = u.workspace_id AND pn.pipeline_id = u.dlt_pipeline_id
 LEFT JOIN {newest('db_clusters', 'cluster_id', 'cluster_name', 'change_time')} cn ON cn.workspace_id = u.workspace_id AND cn.cluster_id = u.cluster_id
 LEFT JOIN {newest('db_warehouses', 'warehouse_id', 'warehouse_name', 'change_time')} wn ON wn.workspace_id = u.workspace_id AND wn.warehouse_id = u.warehouse_id)
LEFT JOIN (VALUES {_FACTS}) AS f(k, ty, ca, su) ON f.k = p GROUP BY ALL""", r="cost list_cost"),
    "m15_resolve_price_table": fin(n("cloud, true AS effective_is_list", "db_prices")),
    "m16_parse_storage_url": fin(_URL.format("(SELECT coalesce(storage_root, storage_location) AS url FROM uc_catalogs)")),
    "m17_storage_location_rows": fin(f"""
SELECT location_kind, location_name, l.url, scheme, cloud_provider_name, bucket_name, key_prefix, is_read_only, credential_name,
  'databricks' AS x_source_connector, 'Databricks' AS provider_name, '2001-06' AS snapshot_month
FROM (SELECT DISTINCT 'metastore_root' AS location_kind, name AS location_name, storage_root AS url, NULL::BOOLEAN AS is_read_only, NULL::VARCHAR AS credential_name
   FROM uc_metastores WHERE storage_root <> ''
  UNION ALL SELECT CASE WHEN catalog_type = 'MANAGED_CATALOG' THEN 'catalog' ELSE 'foreign_catalog' END, name, coalesce(storage_root, storage_location), NULL, NULL FROM uc_catalogs
  UNION ALL SELECT 'external_location', name, url, read_only, credential_name FROM uc_external) l
JOIN ({_URL.format('(SELECT DISTINCT url FROM (SELECT storage_root AS url FROM uc_metastores UNION SELECT coalesce(storage_root, storage_location) FROM uc_catalogs UNION SELECT url FROM uc_external))')}) x
  ON x.url = l.url"""),
    "m18_driver_support_status": fin(n("""client_application_id, CASE
  WHEN client_application_id LIKE 'PythonConnector%' THEN CASE WHEN split_part(client_application_id, '.', 2)::INT >= 7 THEN 'supported' ELSE 'unsupported' END
  WHEN client_application_id LIKE 'JDBC%' THEN CASE WHEN split_part(client_application_id, '.', 3)::INT >= 5 THEN 'supported' ELSE 'unsupported' END
  WHEN client_application_id LIKE '%Go%' THEN 'supported' WHEN client_application_id LIKE 'SnowSQL%' OR client_application_id LIKE 'Kafka%' THEN 'unsupported'
  ELSE 'unknown' END AS support_status""", "sf_sessions")),
    "m19_silver_focus_normalized": fin("""SELECT provider_name, charge_day, charge_month, is_credit, is_correction, is_partial_period, count(*) AS n, sum(cost) AS cost,
  sum(billed_cost) AS billed_cost FROM silver GROUP BY ALL""", "cost billed_cost"),
    "m20_silver_provider_bill": fin("SELECT provider_name, service_name, count(*) AS n, sum(cost) AS cost FROM pbill GROUP BY ALL", "cost"),
    "m21_compute_family": fin(n("""billing_origin_product, CASE WHEN billing_origin_product IN ('JOBS', 'DLT') THEN 'job' WHEN billing_origin_product = 'SQL' THEN 'sql_warehouse'
  WHEN billing_origin_product = 'MODEL_SERVING' THEN 'endpoint'
  WHEN billing_origin_product IN ('ALL_PURPOSE', 'INTERACTIVE', 'NOTEBOOKS', 'SHARED_SERVERLESS_COMPUTE') THEN 'interactive' END AS compute_family""", "db_usage")),
    "m22_ai_product_family": fin(n("""billing_origin_product, CASE WHEN billing_origin_product IN ('MODEL_SERVING', 'VECTOR_SEARCH', 'AI_GATEWAY', 'AI_FUNCTIONS',
  'FOUNDATION_MODEL_TRAINING', 'AGENT_BRICKS', 'AI_RUNTIME', 'AGENT_EVALUATION') THEN lower(billing_origin_product) END AS ai_product_family""", "db_usage")),
    "m23_fold_tag_key": fin(n("replace(lower(k), '-', '_') AS folded, k", "(SELECT unnest(json_keys(tags)) AS k FROM bill)")),
    "m24_tag_lookup": fin(n("coalesce(tags->>'$.project', tags->>'$.Project') AS project, tags->>'$.\"cost-project\"' AS cost_project", "bill")),
    "m25_extract_arn_part": fin(n("""service_name, CASE WHEN resource_id LIKE 'arn:aws:s3:::%' THEN substr(resource_id, 14) ELSE resource_id END AS bucket,
  CASE WHEN resource_id LIKE 'arn:aws:ec2:%' THEN split_part(resource_id, 'instance/', 2) ELSE resource_id END AS instance,
  CASE WHEN resource_id LIKE '%:cluster:%' THEN split_part(resource_id, ':cluster:', 2) ELSE '(not assigned to a cluster)' END AS cluster""", "bill")),
    "m26_identity_kind": fin(n("""nullif(lower(trim(requester)), '') AS identity, CASE WHEN ifnull(trim(requester), '') = '' THEN 'unattributed'
  WHEN length(requester) = 36 THEN 'service_principal' ELSE 'user' END AS kind""", "ai_usage")),
}
