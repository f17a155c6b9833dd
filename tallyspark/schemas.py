"""Fixed table schemas. Files written before a column existed read it as NULL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.types import StructField, StructType

_TYPES = {
    "string": T.StringType(), "date": T.DateType(), "timestamp": T.TimestampType(), "boolean": T.BooleanType(),
    "double": T.DoubleType(), "bigint": T.LongType(), "decimal(20,6)": T.DecimalType(20, 6),
}


def _schema(columns: str) -> StructType:
    """'name type' pairs; needs no running session, so modules can be imported before one exists."""
    pairs = [c.split() for c in columns.replace("(20,6)", "(20;6)").replace("\n", " ").split(",")]
    return StructType([StructField(n, _TYPES[t.replace(";", ",")]) for n, t in pairs])


BILL = _schema("""
    dedupe_key string, ingest_run_id string, x_ingested_at timestamp,
    provider_name string, billing_account_id string, billing_account_name string,
    sub_account_id string, sub_account_name string,
    billing_period_start date, billing_period_end date,
    charge_period_start timestamp, charge_period_end timestamp,
    billing_currency string,
    billed_cost decimal(20,6), effective_cost decimal(20,6),
    list_cost decimal(20,6), contracted_cost decimal(20,6),
    charge_category string, charge_class string, charge_description string,
    service_category string, service_name string, sku_id string, region_id string,
    pricing_category string,
    resource_id string, resource_name string, resource_type string,
    consumed_quantity double, consumed_unit string, tags string,
    commitment_discount_id string, commitment_discount_type string,
    commitment_discount_category string, commitment_discount_name string,
    commitment_discount_status string, commitment_discount_quantity double,
    commitment_discount_unit string,
    invoice_id string, invoice_issuer_name string,
    x_compute_class string, x_focus_version string, x_effective_is_list boolean,
    x_record_id string, x_record_type string, x_cost_subcategory string,
    x_source_connector string, charge_month string
""")

EFFICIENCY = _schema("""
    entity_type string, entity_id string, entity_name string,
    owner_user string, owner_project string,
    billed_cost decimal(20,6), native_quantity double, native_unit string,
    utilization_pct double, activity_count bigint, cause_detail string,
    provider_name string, x_source_connector string, charge_month string
""")

AI_USAGE = _schema("""
    endpoint_id string, endpoint_name string, served_entity_id string,
    model_name string, model_version string, model_kind string, serving_mode string,
    requester string, usage_context_project string,
    scale_to_zero_enabled boolean, workload_size string, workload_type string,
    min_provisioned_throughput double, max_provisioned_throughput double,
    request_count bigint, error_request_count bigint,
    input_tokens bigint, output_tokens bigint,
    error_input_tokens bigint, error_output_tokens bigint, total_duration_ms bigint,
    x_source_connector string, provider_name string, charge_month string
""")

STORAGE_LOCATION = _schema("""
    location_kind string, location_name string, url string, scheme string,
    cloud_provider_name string, bucket_name string, key_prefix string,
    is_read_only boolean, credential_name string,
    x_source_connector string, provider_name string, snapshot_month string
""")

COMPUTE_INSTANCE = _schema("""
    cluster_id string, cluster_name string, owner_user string, instance_id string,
    is_driver boolean, node_type string,
    x_source_connector string, provider_name string, charge_month string
""")

DRIVER_HEALTH = _schema("""
    client_driver string, client_application string, executed_by string,
    cluster_id string, query_count bigint, support_status string,
    x_source_connector string, provider_name string, charge_month string
""")

POLICY_CONFIG = _schema("""
    cluster_id string, cluster_name string,
    encrypted boolean, publicly_accessible boolean, enhanced_vpc_routing boolean,
    automated_snapshot_retention_days bigint, require_ssl boolean, tag_count bigint,
    x_source_connector string, provider_name string, snapshot_month string
""")

TABLE_OBSERVABILITY = _schema("""
    record_kind string, table_id bigint, table_name string,
    external_schema string, external_table string, source_type string,
    file_location string, file_format string,
    query_count bigint, scan_step_count bigint, scan_bytes bigint,
    rows_pre_filter bigint, rows_returned bigint,
    first_scan_at timestamp, last_scan_at timestamp,
    segment_count bigint, duration_seconds double,
    total_partitions bigint, qualified_partitions bigint, scanned_files bigint,
    source_rows bigint, source_bytes bigint,
    s3_listing_milliseconds bigint, partition_catalog_milliseconds bigint,
    redshift_database_name string, table_type string, table_location string,
    input_format string, output_format string, serialization_lib string,
    compressed bigint, table_parameters string, partition_count bigint,
    sample_partition_location string, x_source_connector string,
    cluster_id string, observation_date string
""")

RUN_LOG = _schema("""
    run_id string, connector string, status string, rows bigint, detail string,
    started_at timestamp, finished_at timestamp
""")

TURN_LOG = _schema("""
    turn_id string, session_id string, model string,
    prompt_tokens bigint, completion_tokens bigint, total_tokens bigint,
    tool_call_count bigint, occurred_at timestamp, duration_ms double,
    plan_ms double, explore_ms double, execute_ms double, synthesize_ms double,
    llm_request_count bigint, plan_pass_count bigint, empty_round_retries bigint,
    outcome string, answer_source string, route string, intent string,
    time_to_first_result_ms double, output_retries bigint
""")


def empty(spark: SparkSession, schema: StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Project onto *schema* by name: absent columns become typed NULLs, extra ones are dropped."""
    from pyspark.sql import functions as F

    have = {c.lower(): c for c in df.columns}
    return df.select(
        *[
            (F.col(f"`{have[f.name.lower()]}`") if f.name.lower() in have else F.lit(None))
            .cast(f.dataType)
            .alias(f.name)
            for f in schema.fields
        ]
    )
