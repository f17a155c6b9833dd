"""Source exports mapped to the 48-column charge table, one projection each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from tallyspark.functions import coerce, labels
from tallyspark.operators.frame import in_short_methods, latest_by_key, union_all
from tallyspark.operators.price_index import price_index, with_price
from tallyspark.schemas import BILL

FOCUS_VERSION = "1.3"

# The export's column names, in the order the row key hashes them.
FOCUS_COLUMNS = (
    "ProviderName", "BillingAccountId", "BillingAccountName", "SubAccountId", "SubAccountName",
    "BillingPeriodStart", "BillingPeriodEnd", "ChargePeriodStart", "ChargePeriodEnd",
    "BillingCurrency", "BilledCost", "EffectiveCost", "ListCost", "ContractedCost",
    "ChargeCategory", "ChargeClass", "ChargeDescription", "ServiceCategory", "ServiceName",
    "SkuId", "RegionId", "PricingCategory", "ResourceId", "ResourceName", "ResourceType",
    "ConsumedQuantity", "ConsumedUnit", "Tags", "CommitmentDiscountId", "CommitmentDiscountType",
    "CommitmentDiscountCategory", "CommitmentDiscountName", "CommitmentDiscountStatus",
    "CommitmentDiscountQuantity", "CommitmentDiscountUnit", "InvoiceId", "InvoiceIssuerName",
)
RECORD_COLUMNS = ("x_RecordId", "x_RecordType")


class MixedCurrencyError(ValueError):
    """Charges in several currencies cannot be summed."""


def stringify_columns(export: DataFrame) -> DataFrame:
    """Every export column as text: nested values as JSON, absent columns as NULL."""
    kinds = {f.name.lower(): (f.name, f.dataType) for f in export.schema.fields}
    out = []
    for name in FOCUS_COLUMNS + RECORD_COLUMNS:
        if name.lower() not in kinds:
            out.append(F.lit(None).cast("string").alias(name))
            continue
        actual, kind = kinds[name.lower()]
        c = F.col(f"`{actual}`")
        nested = isinstance(kind, (MapType, StructType, ArrayType))
        out.append((F.to_json(c) if nested else c.cast("string")).alias(name))
    return export.select(*out)


def dedupe_key(connector: str) -> Column:
    """Hash over every source column: only identical rows share a key."""
    parts = [F.coalesce(coerce.nz(F.col(c)), F.lit("")) for c in FOCUS_COLUMNS + RECORD_COLUMNS]
    return F.sha2(F.concat_ws("|", F.lit(connector), *parts), 256)


def map_focus_to_bronze(
    export: DataFrame,
    connector: str,
    run_id: str,
    cost_subcategory: bool = False,
    compute_class: bool = False,
    effective_is_list: bool = False,
    ingested_at: Column | None = None,
    by_files: bool = False,
) -> DataFrame:
    """Export rows as charge-table rows; identical rows collapse to one, undated rows are dropped.

    Identical rows meet by a shuffle of the columns that are read later. With `by_files`, for readers of whole rows, the export is
    written once as text and they meet in its files, which take a fraction of the room of 48 shuffled columns.
    """
    text = stringify_columns(export).where(coerce.nz(F.col("ChargePeriodStart")).isNotNull())
    if by_files:
        text = _one_of_each(text, connector)

    def nz(name: str) -> Column:
        return coerce.nz(F.col(name))

    def raw(name: str) -> Column:
        return F.col(name)

    start = coerce.instant(raw("ChargePeriodStart"))
    start_day, end_day = coerce.day(raw("ChargePeriodStart")), coerce.day(raw("ChargePeriodEnd"))
    service = F.coalesce(nz("ServiceName"), F.lit("Unknown"))
    subcategory = F.lit(None).cast("string")
    if cost_subcategory:
        subcategory = labels.cost_subcategory(
            service, nz("ChargeCategory"), nz("ChargeDescription"), nz("SkuId"))
    values: dict[str, Column] = {
        "dedupe_key": F.col("dedupe_key") if by_files else dedupe_key(connector),
        "ingest_run_id": F.lit(run_id),
        "x_ingested_at": F.current_timestamp() if ingested_at is None else ingested_at,
        "provider_name": F.coalesce(nz("ProviderName"), F.lit("Unknown")),
        "billing_account_id": F.coalesce(nz("BillingAccountId"), F.lit("unknown")),
        "billing_account_name": nz("BillingAccountName"),
        "sub_account_id": nz("SubAccountId"),
        "sub_account_name": nz("SubAccountName"),
        "billing_period_start": F.coalesce(coerce.day(raw("BillingPeriodStart")), start_day),
        "billing_period_end": F.coalesce(coerce.day(raw("BillingPeriodEnd")), end_day, start_day),
        "charge_period_start": start,
        "charge_period_end": F.coalesce(coerce.instant(raw("ChargePeriodEnd")), start),
        "billing_currency": F.coalesce(nz("BillingCurrency"), F.lit("USD")),
        "billed_cost": coerce.money(raw("BilledCost")),
        "effective_cost": coerce.money(raw("EffectiveCost")),
        "list_cost": coerce.money(raw("ListCost")),
        "contracted_cost": coerce.money(raw("ContractedCost")),
        "charge_category": coerce.charge_category(raw("ChargeCategory")),
        "charge_class": coerce.charge_class(raw("ChargeClass")),
        "charge_description": nz("ChargeDescription"),
        "service_category": coerce.service_category(raw("ServiceCategory")),
        "service_name": service,
        "sku_id": nz("SkuId"),
        "region_id": nz("RegionId"),
        "pricing_category": coerce.pricing_category(raw("PricingCategory")),
        "resource_id": nz("ResourceId"),
        "resource_name": nz("ResourceName"),
        "resource_type": nz("ResourceType"),
        "consumed_quantity": coerce.number(raw("ConsumedQuantity")),
        "consumed_unit": nz("ConsumedUnit"),
        "tags": coerce.valid_tags(raw("Tags")),
        "commitment_discount_id": nz("CommitmentDiscountId"),
        "commitment_discount_type": nz("CommitmentDiscountType"),
        "commitment_discount_category": coerce.commitment_category(raw("CommitmentDiscountCategory")),
        "commitment_discount_name": nz("CommitmentDiscountName"),
        "commitment_discount_status": coerce.commitment_status(raw("CommitmentDiscountStatus")),
        "commitment_discount_quantity": coerce.number(raw("CommitmentDiscountQuantity")),
        "commitment_discount_unit": nz("CommitmentDiscountUnit"),
        "invoice_id": nz("InvoiceId"),
        "invoice_issuer_name": nz("InvoiceIssuerName"),
        "x_compute_class": labels.compute_class(F.coalesce(nz("SkuId"), F.lit(""))) if compute_class else F.lit("n/a"),
        "x_focus_version": F.lit(FOCUS_VERSION),
        "x_effective_is_list": F.lit(effective_is_list),
        "x_record_id": nz("x_RecordId"),
        "x_record_type": nz("x_RecordType"),
        "x_cost_subcategory": subcategory,
        "x_source_connector": F.lit(connector),
        "charge_month": F.date_format(start, "yyyy-MM"),
    }
    mapped = text.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in BILL.fields])
    return in_short_methods(mapped, "service_name") if by_files else dedupe_exact(mapped)


def _one_of_each(text: DataFrame, connector: str) -> DataFrame:
    """One of the text rows of each key, with its `dedupe_key`; rows are dealt by files (`stored_in_buckets`), not shuffled."""
    from tallyspark.sinks.files import stored_in_buckets

    covered = F.xxhash64(*[F.coalesce(coerce.nz(F.col(c)), F.lit("")) for c in FOCUS_COLUMNS + RECORD_COLUMNS])
    n = int(text.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucketed = in_short_methods(text.withColumn("_bucket", F.pmod(covered, F.lit(n)).cast("int")), "_bucket")
    dealt = in_short_methods(stored_in_buckets(bucketed, "bill-export", "_bucket").withColumn("dedupe_key", dedupe_key(connector)), "dedupe_key")
    return dealt.dropDuplicates(["_bucket", "dedupe_key"]).drop("_bucket")


def dedupe_exact(rows: DataFrame) -> DataFrame:
    return rows.dropDuplicates(["dedupe_key"])


def assert_single_currency(rows: DataFrame, connector: str, base: str) -> None:
    """Raise when any charge is not in the base currency; names at most a few of the others."""
    others = rows.where(F.col("billing_currency") != base).select("billing_currency").distinct().limit(20)
    found = sorted(r[0] for r in others.collect())
    if found:
        raise MixedCurrencyError(f"{connector}: currencies {found} differ from base {base}")


def map_cost_explorer(costs: DataFrame) -> DataFrame:
    """Daily cost per service as coarse export rows; days without cost are dropped."""
    amount = coerce.money(F.col("amount"))
    analytics = F.col("service").isin(*labels.REDSHIFT_SERVICES)
    return costs.select("*", amount.alias("_cost")).where(F.col("_cost") != 0).select(
        F.lit("AWS").alias("ProviderName"), F.lit("aws-cost-explorer").alias("BillingAccountId"),
        F.trunc("period_start", "MM").alias("BillingPeriodStart"), F.col("period_end").alias("BillingPeriodEnd"),
        F.col("period_start").cast("timestamp").alias("ChargePeriodStart"),
        F.col("period_end").cast("timestamp").alias("ChargePeriodEnd"),
        *[F.col("_cost").alias(c) for c in ("BilledCost", "EffectiveCost", "ListCost", "ContractedCost")],
        F.lit("Usage").alias("ChargeCategory"),
        F.concat("service", F.lit(" (Cost Explorer)")).alias("ChargeDescription"),
        F.when(analytics, "Analytics").otherwise("Other").alias("ServiceCategory"),
        F.col("service").alias("ServiceName"))


def map_snowflake_usage(usage: DataFrame, start: str, end: str) -> DataFrame:
    """Daily organization usage as export rows; money flowing back is a credit."""
    cost = F.col("usage_in_currency")
    back = (cost < 0) | F.lower("billing_type").isin("support_credit", "rebate")
    day = F.col("usage_date")
    category = labels.lookup(F.upper("service_type"), labels.SNOWFLAKE_CATEGORIES, "Other")
    return usage.where(day.between(start, end) & cost.isNotNull()).select(
        F.lit("Snowflake").alias("ProviderName"), F.col("organization_name").alias("BillingAccountId"),
        F.col("account_name").alias("SubAccountId"), F.col("account_locator").alias("SubAccountName"),
        F.trunc(day, "MM").alias("BillingPeriodStart"), F.add_months(F.trunc(day, "MM"), 1).alias("BillingPeriodEnd"),
        day.cast("timestamp").alias("ChargePeriodStart"), F.date_add(day, 1).cast("timestamp").alias("ChargePeriodEnd"),
        F.col("currency").alias("BillingCurrency"),
        *[cost.alias(c) for c in ("BilledCost", "EffectiveCost", "ListCost", "ContractedCost")],
        F.when(back, "Credit").when(F.col("is_adjustment"), "Adjustment").otherwise("Usage").alias("ChargeCategory"),
        F.col("usage_type").alias("ChargeDescription"), category.alias("ServiceCategory"),
        F.col("service_type").alias("ServiceName"), F.col("usage_type").alias("SkuId"), F.col("region").alias("RegionId"),
        F.col("usage").alias("ConsumedQuantity"), F.lit("Credits").alias("ConsumedUnit"))


# --- platform usage ---------------------------------------------------------------------------------------
# Product -> (id field, name fields, resource type, category, subcategory).
_ENDPOINT_NAMES = ("endpoint_name", "endpoint_id")
_PIPELINE_NAMES = ("pipeline_name", "dlt_pipeline_id")
_NOTEBOOK_NAMES = ("notebook_path", "notebook_id")
_AI, _MG = "AI and Machine Learning", "Management and Governance"
PRODUCTS: dict[str, tuple] = {
    "JOBS": ("job_id", ("job_name", "job_id"), "Job", "Analytics", "Data Processing"),
    "DLT": ("dlt_pipeline_id", _PIPELINE_NAMES, "Spark Declarative Pipeline", "Analytics", "Data Processing"),
    "LAKEFLOW_CONNECT": ("dlt_pipeline_id", _PIPELINE_NAMES, "LakeFlow Connect", "Integration", "Other (Integration)"),
    "ONLINE_TABLES": ("dlt_pipeline_id", _PIPELINE_NAMES, "Online Table", "Databases", "Relational Databases"),
    "ALL_PURPOSE": ("cluster_id", ("cluster_name", "cluster_id"), "Cluster", "Compute", "Virtual Machines"),
    "INTERACTIVE": ("notebook_id", _NOTEBOOK_NAMES, "Compute", "Compute", "Virtual Machines"),
    "NOTEBOOKS": ("notebook_id", _NOTEBOOK_NAMES, "Notebook", "Compute", "Serverless Compute"),
    "SQL": ("warehouse_id", ("warehouse_name", "warehouse_id"), "SQL Warehouse", "Databases", "Data Warehouses"),
    "MODEL_SERVING": ("endpoint_id", _ENDPOINT_NAMES, "Model Serving Endpoint", _AI, "AI Platforms"),
    "VECTOR_SEARCH": ("endpoint_id", _ENDPOINT_NAMES, "Vector Search Endpoint", _AI, f"Other ({_AI})"),
    "AI_GATEWAY": ("endpoint_id", _ENDPOINT_NAMES, "AI Gateway", _AI, "AI Platforms"),
    "AI_FUNCTIONS": ("endpoint_id", _ENDPOINT_NAMES, "AI Function", _AI, "AI Platforms"),
    "FOUNDATION_MODEL_TRAINING": ("run_name", ("run_name",), "Foundation Model Training Run", _AI, "Generative AI"),
    "AGENT_EVALUATION": (None, None, "Agent Evaluation", _AI, f"Other ({_AI})"),
    "AGENT_BRICKS": ("agent_bricks_id", ("agent_bricks_id",), "Agent", _AI, "Generative AI"),
    "AI_RUNTIME": ("ai_runtime_workload_id", ("ai_runtime_workload_id",), "AI Runtime Workload", _AI, "Generative AI"),
    "DATABASE": ("database_instance_id", ("database_instance_id",), "Database Instance", "Databases", "Relational Databases"),
    "DEFAULT_STORAGE": (None, None, "Storage", "Storage", "Object Storage"),
    "LAKEHOUSE_MONITORING": ("tag:LakehouseMonitoringTableId", None, "Lakehouse Monitoring", _MG, "Observability"),
    "DATA_QUALITY_MONITORING": ("schema_id", None, "Data Quality Monitor", _MG, "Observability"),
    "PREDICTIVE_OPTIMIZATION": (None, None, "Predictive Optimization", _MG, "Cost Management"),
    "CLEAN_ROOM": ("central_clean_room_id", ("central_clean_room_id",), "Clean Room", _MG, f"Other ({_MG})"),
    "DATA_SHARING": ("sharing_materialization_id", ("sharing_materialization_id",), "Data Share", _MG, f"Other ({_MG})"),
    "DATA_CLASSIFICATION": ("catalog_id", None, "Data Classification", "Security", "Security Posture Management"),
    "FINE_GRAINED_ACCESS_CONTROL": ("tag:Name", None, "Access Control Policy", "Security", "Other (Security)"),
    "NETWORKING": (None, None, "Networking", "Networking", "Network Connectivity"),
    "SHARED_SERVERLESS_COMPUTE": (None, None, "Serverless Compute", "Compute", "Serverless Compute"),
    "BASE_ENVIRONMENTS": ("base_environment_id", ("base_environment_id",), "Base Environment", "Developer Tools", "Development Environments"),
    "APPS": ("app_id", ("app_name", "app_id"), "Application", "Web", "Application Platforms"),
}
# Products that a named SKU moves onto another resource.
_SKU_OVERRIDES = (
    ("MODEL_SERVING", "^ENTERPRISE_ALL_PURPOSE_COMPUTE$", "cluster_id"),
    ("VECTOR_SEARCH", "^ENTERPRISE_(JOBS_SERVERLESS_COMPUTE|SERVERLESS_SQL_COMPUTE)", "dlt_pipeline_id"),
    ("DATABASE", "^ENTERPRISE_JOBS_SERVERLESS_COMPUTE", "dlt_pipeline_id"),
    ("SQL", "_JOBS_SERVERLESS_COMPUTE", "dlt_pipeline_id"),
)
_NAMES = ("pipeline_name", "cluster_name", "warehouse_name")


def _source(field: str) -> Column:
    if field.startswith("tag:"):
        return F.try_element_at("custom_tags", F.lit(field[4:]))
    return F.col(field) if field in _NAMES else F.col(f"usage_metadata.{field}")


def _per_product(pick) -> Column:
    """One value per product; products with the same expression share a branch."""
    product = F.col("billing_origin_product")
    groups: dict[object, list[str]] = {}
    for name, facts in PRODUCTS.items():
        groups.setdefault(pick(facts), []).append(name)
    return product, groups


def _resource_id() -> Column:
    product, groups = _per_product(lambda f: f[0])
    out = product
    for field, names in groups.items():
        if field is not None:
            out = F.when(product.isin(*names), F.coalesce(_source(field), product)).otherwise(out)
    for name, sku, field in reversed(_SKU_OVERRIDES):
        out = F.when((product == name) & F.col("sku_name").rlike(sku),
                     F.coalesce(_source(field), product)).otherwise(out)
    return out


def _resource_name() -> Column:
    product, groups = _per_product(lambda f: f[1])
    out = product
    for fields, names in groups.items():
        if fields is not None:
            out = F.when(product.isin(*names), F.coalesce(*[_source(f) for f in fields])).otherwise(out)
    return out


def _product_fact(position: int, default: Column) -> Column:
    product, groups = _per_product(lambda f: f[position])
    out = default
    for value, names in groups.items():
        out = F.when(product.isin(*names), F.lit(value)).otherwise(out)
    return out


def _rated(usage: DataFrame, prices: DataFrame, name: str) -> DataFrame:
    """Usage with the USD price of its account, SKU and unit that is valid at its end; NULL without one.

    Prices keep their decimals. Where validities of one account, SKU and unit overlap, the one that started last
    holds, so no usage row doubles.
    """
    index = price_index(
        prices.where(F.col("currency_code") == "USD"), ["account_id", "sku_name", "usage_unit"],
        F.col("pricing.default").cast("decimal(30,15)"), "price_start_time", "price_end_time")
    on = [(F.col("account_id"), "account_id"), (F.col("sku_name"), "sku_name"), (F.col("usage_unit"), "usage_unit")]
    return with_price(usage, index, on, F.col("usage_end_time"), name)


def map_databricks_usage(
    usage: DataFrame, list_prices: DataFrame, account_prices: DataFrame, workspaces: DataFrame,
    pipelines: DataFrame, clusters: DataFrame, warehouses: DataFrame, region: str | None = None,
) -> DataFrame:
    """Platform usage as export rows: priced at list and account rates, named after what used it.

    A price is valid from its start up to, not including, its end, so no usage row doubles at a
    price change.
    """
    keys = ["account_id", "workspace_id"]

    def names(df: DataFrame, key: str, column: str, label: str, when: str) -> DataFrame:
        newest = latest_by_key(df.select(*keys, key, F.col(column).alias(label), when), [*keys, key], when, [label])
        return newest.withColumnRenamed(key, f"_{key}")

    def join_names(df: DataFrame, dim: DataFrame, key: str, field: str) -> DataFrame:
        cond = (df["account_id"] == dim["account_id"]) & (df["workspace_id"] == dim["workspace_id"]) & (
            df["usage_metadata"][field] == dim[f"_{key}"])
        return df.join(dim, cond, "left").drop(dim["account_id"], dim["workspace_id"], dim[f"_{key}"])

    rows = _rated(_rated(usage, list_prices, "_list"), account_prices, "_rate")
    rows = rows.join(workspaces.select(*keys, "workspace_name"), keys, "left")
    rows = join_names(rows, names(pipelines, "pipeline_id", "name", "pipeline_name", "create_time"), "pipeline_id", "dlt_pipeline_id")
    rows = join_names(rows, names(clusters, "cluster_id", "cluster_name", "cluster_name", "change_time"), "cluster_id", "cluster_id")
    rows = join_names(rows, names(warehouses, "warehouse_id", "warehouse_name", "warehouse_name", "change_time"), "warehouse_id", "warehouse_id")

    paid = F.coalesce(F.col("usage_quantity") * F.col("_rate"), F.lit(0.0))
    product, sku = F.col("billing_origin_product"), F.col("sku_name")
    month = F.trunc("usage_date", "MM")
    details = F.from_json(F.to_json("product_features"), "map<string,string>")
    prefixed = F.transform_keys(F.map_filter(details, lambda k, v: v.isNotNull()), lambda k, v: F.concat(F.lit("x_"), k))
    serverless = (product == "INTERACTIVE") & F.upper(sku).contains("SERVERLESS")
    return rows.select(
        F.lit("Databricks").alias("ProviderName"), F.col("account_id").alias("BillingAccountId"),
        F.col("account_id").alias("BillingAccountName"), F.col("workspace_id").alias("SubAccountId"),
        F.col("workspace_name").alias("SubAccountName"), F.lit("Workspace").alias("SubAccountType"),
        month.alias("BillingPeriodStart"), F.add_months(month, 1).alias("BillingPeriodEnd"),
        F.col("usage_start_time").alias("ChargePeriodStart"), F.col("usage_end_time").alias("ChargePeriodEnd"),
        F.when(F.col("_list").isNotNull(), "USD").alias("BillingCurrency"),
        *[paid.alias(c) for c in ("BilledCost", "EffectiveCost", "ContractedCost")],
        F.coalesce(F.col("usage_quantity") * F.col("_list"), F.lit(0.0)).alias("ListCost"),
        F.col("_list").alias("ListUnitPrice"), F.col("_rate").alias("ContractedUnitPrice"),
        F.lit("Usage").alias("ChargeCategory"), F.lit("Usage-Based").alias("ChargeFrequency"),
        sku.alias("ChargeDescription"), F.lit("Standard").alias("PricingCategory"),
        F.col("usage_quantity").alias("ConsumedQuantity"), F.col("usage_unit").alias("ConsumedUnit"),
        F.when(F.col("cloud") == "AWS", "Amazon Web Services").when(F.col("cloud") == "AZURE", "Microsoft Azure")
        .when(F.col("cloud") == "GCP", "Google Cloud Platform").otherwise(F.col("cloud")).alias("HostProviderName"),
        F.lit("Databricks").alias("InvoiceIssuerName"), F.lit(region).cast("string").alias("RegionId"),
        _resource_id().alias("ResourceId"), _resource_name().alias("ResourceName"),
        _product_fact(2, F.coalesce(product, F.lit("Other"))).alias("ResourceType"),
        _product_fact(3, F.lit("Other")).alias("ServiceCategory"), product.alias("ServiceName"),
        F.when(serverless, "Serverless Compute").otherwise(_product_fact(4, F.lit("Other (Other)"))).alias("ServiceSubcategory"),
        sku.alias("SkuId"), F.col("usage_type").alias("SkuMeter"), F.to_json(prefixed).alias("SkuPriceDetails"),
        F.col("custom_tags").alias("Tags"), F.col("record_id").alias("x_RecordId"), F.col("record_type").alias("x_RecordType"),
    )


def resolve_price_table(spark: SparkSession, account_table: str, list_table: str) -> tuple[DataFrame, bool]:
    """Negotiated prices when that table exists, else list prices; the flag says list was used."""
    if spark.catalog.tableExists(account_table):
        return spark.table(account_table), False
    return spark.table(list_table), True


def storage_location_rows(
    metastores: DataFrame, catalogs: DataFrame, external: DataFrame, snapshot_month: str, connector: str = "databricks"
) -> DataFrame:
    """Metastore roots, catalogs and external locations as one deduplicated location map."""
    parts = [
        metastores.select(F.lit("metastore_root").alias("location_kind"), F.col("name").alias("location_name"),
                          F.col("storage_root").alias("url"), F.lit(None).cast("boolean").alias("is_read_only"),
                          F.lit(None).cast("string").alias("credential_name")),
        # Only managed catalogs own their storage; any other kind points at data kept elsewhere.
        catalogs.select(
            F.when(F.col("catalog_type") == "MANAGED_CATALOG", "catalog").otherwise("foreign_catalog").alias("location_kind"),
            F.col("name").alias("location_name"), F.coalesce("storage_root", "storage_location").alias("url"),
            F.lit(None).cast("boolean").alias("is_read_only"), F.lit(None).cast("string").alias("credential_name")),
        external.select(F.lit("external_location").alias("location_kind"), F.col("name").alias("location_name"),
                        "url", F.col("read_only").alias("is_read_only"), "credential_name"),
    ]
    rows = union_all(parts).where(F.coalesce("url", F.lit("")) != "")
    url = labels.parse_storage_url(F.col("url"))
    # Aggregating by key keeps one row and a stable choice of its flags.
    unique = rows.groupBy("location_kind", "location_name", "url").agg(
        F.min("is_read_only").alias("is_read_only"), F.min("credential_name").alias("credential_name"))
    return unique.select(
        "location_kind", "location_name", "url", *[c.alias(n) for n, c in url.items()], "is_read_only", "credential_name",
        F.lit(connector).alias("x_source_connector"), F.lit("Databricks").alias("provider_name"),
        F.lit(snapshot_month).alias("snapshot_month"))
