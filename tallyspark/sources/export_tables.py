"""Raw source exports derived from the driver tables, before any mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.sources import driver_tables as dt

_FROM_BILL = dt.bill_select([
    "provider_name", "billing_account_id", "sub_account_id", "charge_period_start", "charge_period_end", "effective_cost",
    "billed_cost", "list_cost", "charge_category", "charge_class", "charge_description", "service_category", "service_name",
    "sku_id", "region_id", "pricing_category", "resource_id", "consumed_quantity", "tags", "commitment_discount_id",
    "commitment_discount_category", "commitment_discount_status", "invoice_id"])

# Text with the noise real exports carry: padding, spelled-out nulls, unknown words, bad numbers, repeats.
_EXPORT = f"""
SELECT provider_name AS ProviderName,
  CASE WHEN invoice_id IS NULL THEN ' null ' ELSE '  ' || billing_account_id || ' ' END AS BillingAccountId,
  sub_account_id AS SubAccountId, CAST(charge_period_start AS STRING) AS ChargePeriodStart,
  CASE WHEN sub_account_id IS NULL THEN 'NaN' ELSE CAST(charge_period_end AS STRING) END AS ChargePeriodEnd,
  CASE WHEN charge_class IS NULL THEN CAST(billed_cost AS STRING) ELSE 'n/a' END AS BilledCost,
  CAST(effective_cost AS STRING) AS EffectiveCost, CAST(list_cost AS STRING) AS ListCost,
  CASE WHEN pricing_category = 'Dynamic' THEN 'Mystery' ELSE charge_category END AS ChargeCategory,
  charge_class AS ChargeClass, charge_description AS ChargeDescription,
  CASE WHEN service_category = 'Networking' THEN 'Transfer' ELSE service_category END AS ServiceCategory, service_name AS ServiceName,
  sku_id AS SkuId, region_id AS RegionId, CASE WHEN pricing_category = 'Dynamic' THEN 'Spotty' ELSE pricing_category END AS PricingCategory,
  CASE WHEN resource_id IS NULL THEN 'None' ELSE resource_id END AS ResourceId, CAST(consumed_quantity AS STRING) AS ConsumedQuantity,
  CASE WHEN charge_class = 'Correction' THEN 'not json' ELSE tags END AS Tags, commitment_discount_id AS CommitmentDiscountId,
  commitment_discount_category AS CommitmentDiscountCategory, commitment_discount_status AS CommitmentDiscountStatus, invoice_id AS InvoiceId
FROM (SELECT * FROM ({_FROM_BILL}) AS once UNION ALL SELECT * FROM ({_FROM_BILL}) AS again WHERE charge_category = 'Adjustment') AS b"""

dt.PLANES.update({
    "focus_export": _EXPORT,
    "manifests": """
SELECT 'exp/metadata/BILLING_PERIOD=' || substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 7) || '/m-' || CAST(o_orderkey AS STRING) || '.json' AS path,
  CASE o_orderkey % 5 WHEN 0 THEN '{"dataFiles":["s3://other/f' || CAST(o_orderkey % 100 AS STRING) || '.parquet"]}'
   WHEN 1 THEN '{"dataFiles":[{"key":"/exp/data/k' || CAST(o_orderkey % 100 AS STRING) || '.parquet"}]}'
   WHEN 2 THEN '{"dataFiles":[{"relativePath":"r' || CAST(o_orderkey % 100 AS STRING) || '.parquet","size":3}]}'
   WHEN 3 THEN '{"files":{"a":"exp/x' || CAST(o_orderkey % 100 AS STRING) || '.parquet"}}' ELSE '{"dataFiles":[]}' END AS document
FROM orders""",
    "run_log": """
SELECT 'run-' || CAST(o_orderkey % 1000 AS STRING) AS run_id, 'conn-' || CAST(o_custkey % 4 AS STRING) AS connector,
  CASE WHEN o_orderkey % 37 = 0 THEN 'failed' ELSE 'success' END AS status, o_custkey AS rows_written, CAST(NULL AS STRING) AS detail,
  CAST(o_orderdate AS TIMESTAMP) AS started_at, CAST(o_orderdate + INTERVAL '1' SECOND * (o_orderkey % 5000) AS TIMESTAMP) AS finished_at FROM orders""",
    "ce_costs": """
SELECT CASE o_orderkey % 3 WHEN 0 THEN 'Amazon Redshift' WHEN 1 THEN 'Amazon Redshift Spectrum' ELSE 'AWS Glue' END AS service,
  CAST(o_orderdate AS DATE) AS period_start, CAST(o_orderdate + INTERVAL '1' DAY AS DATE) AS period_end,
  CASE o_orderkey % 7 WHEN 0 THEN '0' WHEN 1 THEN 'oops' ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) END AS amount FROM orders""",
    "sf_org_usage": """
SELECT 'ORG' AS organization_name, 'ACC' || CAST(l_suppkey % 4 AS STRING) AS account_name, 'LOC' || CAST(l_suppkey % 4 AS STRING) AS account_locator,
  CAST(l_shipdate AS DATE) AS usage_date, 'USD' AS currency,
  CASE WHEN l_linenumber = 7 THEN NULL WHEN l_returnflag = 'R' THEN -CAST(l_extendedprice AS DECIMAL(20,6)) ELSE CAST(l_extendedprice AS DECIMAL(20,6)) END AS usage_in_currency,
  CASE l_linenumber WHEN 1 THEN 'REBATE' WHEN 2 THEN 'support_credit' ELSE 'consumption' END AS billing_type, l_linenumber = 3 AS is_adjustment,
  'type ' || CAST(l_partkey % 5 AS STRING) AS usage_type, CASE l_partkey % 6 WHEN 0 THEN 'warehouse_metering' WHEN 1 THEN 'STORAGE' WHEN 2 THEN 'REPLICATION'
   WHEN 3 THEN 'AI_SERVICES' WHEN 4 THEN 'QUERY_ACCELERATION' ELSE 'OTHER_THING' END AS service_type, 'us-east' AS region, CAST(l_quantity AS DOUBLE) AS usage
FROM lineitem""",
    "uc_metastores": """
SELECT 'ms-' || CAST(s_suppkey % 5 AS STRING) AS name, CASE WHEN s_suppkey % 5 = 4 THEN '' ELSE 's3://root-' || CAST(s_suppkey % 5 AS STRING) || '/' END AS storage_root FROM supplier""",
    "uc_catalogs": """
SELECT 'cat-' || CAST(s_suppkey AS STRING) AS name, CASE s_suppkey % 5 WHEN 0 THEN 's3a://Bkt-' || CAST(s_suppkey AS STRING) || '/a/b/'
   WHEN 1 THEN 'abfss://c' || CAST(s_suppkey AS STRING) || '@acct.dfs.core.windows.net/x' WHEN 2 THEN 'gs://g-' || CAST(s_suppkey AS STRING)
   WHEN 3 THEN 'dbfs:/user/x' END AS storage_root, 'S3://late-' || CAST(s_suppkey % 7 AS STRING) || '//deep/' AS storage_location,
  CASE s_suppkey % 3 WHEN 0 THEN 'MANAGED_CATALOG' WHEN 1 THEN 'FOREIGN_CATALOG' END AS catalog_type FROM supplier""",
    "uc_external": """
SELECT 'ext-' || CAST(s_suppkey AS STRING) AS name, 'https://x/' || CAST(s_suppkey AS STRING) AS url, s_suppkey % 2 = 0 AS read_only, 'cred' AS credential_name FROM supplier""",
})


def focus_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plane `focus_export`; its bill lines are derived once, in short methods, the text around them is the plane's own.

    A line that the plane's second reading of the bill gives again is repeated where it is, so the joins under it run once.
    """
    lines = dt.in_short_methods(dt.select(spark, sf_dir, _FROM_BILL), "service_name")
    times = F.when(F.col("charge_category") == "Adjustment", F.lit(2)).otherwise(F.lit(1))
    delivered = lines.withColumn("_times", F.explode(F.array_repeat(F.lit(0), times))).drop("_times")
    columns = _EXPORT[: _EXPORT.index(f"FROM (SELECT * FROM ({_FROM_BILL})")].replace("{", "{{").replace("}", "}}")
    return spark.sql(columns + "FROM {delivered} AS b", delivered=delivered)
