"""Raw platform telemetry derived from the driver tables, shaped like the source systems' own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.sources import driver_tables as dt

# The window covers all of the data.
START, END = "1990-01-01", "2030-12-31"

PRODUCTS = (
    "JOBS", "ALL_PURPOSE", "SQL", "MODEL_SERVING", "NOTEBOOKS", "DLT", "VECTOR_SEARCH", "INTERACTIVE",
    "AI_GATEWAY", "AI_FUNCTIONS", "LAKEHOUSE_MONITORING", "PREDICTIVE_OPTIMIZATION", "ONLINE_TABLES",
    "LAKEFLOW_CONNECT", "DATABASE", "DATA_CLASSIFICATION", "FINE_GRAINED_ACCESS_CONTROL", "NETWORKING",
    "AGENT_EVALUATION", "SHARED_SERVERLESS_COMPUTE", "FOUNDATION_MODEL_TRAINING", "AI_RUNTIME",
    "CLEAN_ROOM", "APPS", "AGENT_BRICKS", "BASE_ENVIRONMENTS", "DATA_QUALITY_MONITORING", "DATA_SHARING",
    "DEFAULT_STORAGE", "SOMETHING_NEW",
)


def _product(key: str) -> str:
    whens = " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PRODUCTS))
    return f"CASE {key} % {len(PRODUCTS)} {whens} END"


def _sku(key: str) -> str:
    return (f"CASE WHEN {key} % 60 = 3 THEN 'ENTERPRISE_ALL_PURPOSE_COMPUTE' "
            f"WHEN {key} % 60 = 6 THEN 'ENTERPRISE_JOBS_SERVERLESS_COMPUTE_US' "
            f"WHEN {key} % 90 = 2 THEN 'PREMIUM_JOBS_SERVERLESS_COMPUTE' "
            f"WHEN {key} % 60 = 14 THEN 'ENTERPRISE_JOBS_SERVERLESS_COMPUTE_EU' "
            f"ELSE 'PREMIUM_' || {_product(key)} || CASE WHEN {key} % 4 = 0 THEN '_SERVERLESS' ELSE '' END "
            f"|| '_B' || CAST({key} % 5 AS STRING) END")


_P = _product("l_partkey")
_USAGE = f"""
SELECT 'rec-' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) AS record_id,
  CASE WHEN l_returnflag = 'R' THEN 'RETRACTION' ELSE 'ORIGINAL' END AS record_type,
  'acc-1' AS account_id, 'ws-' || CAST(l_suppkey % 5 AS STRING) AS workspace_id, {_sku('l_partkey')} AS sku_name,
  CASE WHEN l_suppkey % 7 = 0 THEN 'AZURE' ELSE 'AWS' END AS cloud,
  CAST(l_shipdate AS TIMESTAMP) AS usage_start_time,
  CAST(l_shipdate + INTERVAL '1' HOUR AS TIMESTAMP) AS usage_end_time, CAST(l_shipdate AS DATE) AS usage_date,
  CAST(l_quantity AS DOUBLE) AS usage_quantity, 'DBU' AS usage_unit, 'COMPUTE_TIME' AS usage_type,
  {_P} AS billing_origin_product,
  CASE WHEN l_orderkey % 3 <> 0 THEN 'p' || CAST(l_orderkey % 7 AS STRING) END AS tag_project,
  CASE WHEN l_orderkey % 4 = 0 THEN 'nm' || CAST(l_suppkey % 9 AS STRING) END AS tag_name,
  CASE WHEN ({_P} = 'JOBS' OR ({_P} = 'ALL_PURPOSE' AND l_orderkey % 4 = 0)) AND l_linenumber < 7
    THEN CAST(l_suppkey % 90 AS STRING) END AS job_id,
  CASE WHEN {_P} IN ('JOBS', 'ALL_PURPOSE') AND l_orderkey % 4 = 0 AND l_linenumber < 6
    THEN 'job ' || CAST(l_suppkey % 90 AS STRING) END AS job_name,
  CASE WHEN {_P} IN ('JOBS', 'ALL_PURPOSE', 'MODEL_SERVING') AND l_linenumber < 7
    THEN 'clu-' || CAST(l_suppkey % 30 AS STRING) END AS cluster_id,
  CASE WHEN {_P} = 'SQL' AND l_linenumber < 7 THEN 'wh-' || CAST(l_suppkey % 10 AS STRING) END AS warehouse_id,
  CASE WHEN {_P} IN ('NOTEBOOKS', 'INTERACTIVE') AND l_linenumber < 7 THEN 'nb-' || CAST(l_suppkey AS STRING) END AS notebook_id,
  CASE WHEN {_P} = 'NOTEBOOKS' AND l_linenumber < 5 THEN '/nb/' || CAST(l_suppkey AS STRING) END AS notebook_path,
  CASE WHEN {_P} IN ('MODEL_SERVING', 'VECTOR_SEARCH', 'AI_GATEWAY', 'AI_FUNCTIONS') AND l_linenumber < 7
    THEN 'ep-' || CAST(l_partkey % 25 AS STRING) END AS endpoint_id,
  CASE WHEN l_linenumber < 4 THEN 'endpoint ' || CAST(l_partkey % 25 AS STRING) END AS endpoint_name,
  CASE WHEN l_linenumber < 6 THEN 'pip-' || CAST(l_suppkey % 12 AS STRING) END AS dlt_pipeline_id,
  CASE WHEN l_linenumber < 6 THEN 'obj-' || CAST(l_suppkey % 12 AS STRING) END AS object_id,
  'user' || CAST(l_suppkey % 40 AS STRING) AS run_as,
  CASE l_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS is_photon,
  CASE WHEN l_suppkey % 2 = 0 THEN 'CLASSIC' END AS jobs_tier
FROM lineitem"""

_PRICES = f"""
SELECT DISTINCT {_sku('p_partkey')} AS sku_name, c.cloud AS cloud, 'acc-1' AS account_id, 'DBU' AS usage_unit,
  'USD' AS currency_code, CAST(0.2 AS DOUBLE) + CAST(length({_sku('p_partkey')}) AS DOUBLE) / 100 + w.bump AS price,
  CAST(w.price_start AS TIMESTAMP) AS price_start_time, CAST(w.price_end AS TIMESTAMP) AS price_end_time
FROM part CROSS JOIN (SELECT 'AWS' AS cloud UNION ALL SELECT 'AZURE') AS c
CROSS JOIN (SELECT '1990-01-01 00:00:00' AS price_start, '1998-07-01 00:00:00' AS price_end, CAST(0 AS DOUBLE) AS bump
  UNION ALL SELECT '1998-07-01 00:00:00', NULL, CAST(0.05 AS DOUBLE)) AS w
WHERE p_partkey % 50 <> 7"""

_NODES = """
SELECT 'clu-' || CAST(l_suppkey % 30 AS STRING) AS cluster_id, 'i-' || CAST(l_partkey % 50 AS STRING) AS instance_id,
  l_linenumber = 1 AS driver, 'm5.' || CAST(l_suppkey % 4 AS STRING) AS node_type, CAST(l_shipdate AS TIMESTAMP) AS start_time,
  CAST(l_quantity AS DOUBLE) AS cpu_user_percent, round(CAST(l_discount AS DOUBLE) * 100) AS cpu_system_percent,
  round(CAST(l_tax AS DOUBLE) * 500) AS cpu_wait_percent, CAST(l_quantity AS DOUBLE) + 20 AS mem_used_percent,
  round(CAST(l_tax AS DOUBLE) * 400) AS mem_swap_percent,
  CASE WHEN l_linenumber < 5 THEN l_partkey * 10000000 END AS local_disk_free,
  l_partkey * 1000 AS network_sent_bytes, l_suppkey * 5000 AS network_received_bytes
FROM lineitem"""

_RUNS = """
SELECT CAST(o_custkey % 90 AS STRING) AS job_id, CAST(o_orderdate AS TIMESTAMP) AS period_start_time,
  CAST(o_orderdate + INTERVAL '1' SECOND * (o_orderkey % 1000) AS TIMESTAMP) AS period_end_time,
  CASE o_orderkey % 5 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'ERROR' WHEN 2 THEN 'TIMED_OUT' ELSE 'SUCCEEDED' END AS result_state
FROM orders"""

_JOBS = """
SELECT CAST(c_custkey % 90 AS STRING) AS job_id,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 'owner' || CAST(c_custkey AS STRING) END AS run_as_user_name,
  CAST(timestamp '2000-01-01 00:00:00' + INTERVAL '1' MINUTE * c_custkey AS TIMESTAMP) AS change_time
FROM customer"""

_CLUSTERS = """
SELECT 'acc-1' AS account_id, 'ws-' || CAST(s_suppkey % 5 AS STRING) AS workspace_id,
  'clu-' || CAST(s_suppkey % 30 AS STRING) AS cluster_id,
  CASE WHEN s_suppkey % 4 = 0 THEN 'job-' || CAST(s_suppkey % 90 AS STRING) || '-run-1' ELSE 'cluster ' || CAST(s_suppkey AS STRING) END AS cluster_name,
  CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'owner' || CAST(s_suppkey AS STRING) END AS owned_by,
  s_suppkey % 3 AS min_autoscale_workers, CASE WHEN s_suppkey % 6 <> 0 THEN s_suppkey % 9 END AS max_autoscale_workers,
  CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 100 END AS auto_termination_minutes,
  'm5.' || CAST(s_suppkey % 5 AS STRING) AS worker_node_type,
  CASE WHEN s_suppkey % 2 = 0 THEN 'ON_DEMAND' END AS availability_aws, 'SPOT' AS availability_azure,
  CASE WHEN s_suppkey % 3 = 0 THEN 'pol-1' END AS policy_id, s_suppkey % 3 AS tag_total,
  CAST(timestamp '2000-01-01 00:00:00' + INTERVAL '1' MINUTE * s_suppkey AS TIMESTAMP) AS change_time
FROM supplier"""

_WAREHOUSES = """
SELECT 'acc-1' AS account_id, 'ws-' || CAST(s_suppkey % 5 AS STRING) AS workspace_id,
  'wh-' || CAST(s_suppkey % 10 AS STRING) AS warehouse_id,
  CASE WHEN s_suppkey % 10 = 3 THEN NULL ELSE 'warehouse ' || CAST(s_suppkey AS STRING) END AS warehouse_name,
  CASE s_suppkey % 3 WHEN 0 THEN 'SERVERLESS' ELSE 'PRO' END AS warehouse_type,
  s_suppkey % 4 AS tag_total, s_suppkey % 45 AS auto_stop_minutes,
  CAST(timestamp '2000-01-01 00:00:00' + INTERVAL '1' MINUTE * s_suppkey AS TIMESTAMP) AS change_time
FROM supplier"""

_PIPELINES = """
SELECT 'acc-1' AS account_id, 'ws-' || CAST(s_suppkey % 5 AS STRING) AS workspace_id,
  'pip-' || CAST(s_suppkey % 12 AS STRING) AS pipeline_id, 'pipeline ' || CAST(s_suppkey AS STRING) AS name,
  CAST(timestamp '2000-01-01 00:00:00' + INTERVAL '1' MINUTE * s_suppkey AS TIMESTAMP) AS create_time
FROM supplier"""

_WORKSPACES = """
SELECT DISTINCT 'acc-1' AS account_id, 'ws-' || CAST(s_suppkey % 5 AS STRING) AS workspace_id,
  'Workspace ' || CAST(s_suppkey % 5 AS STRING) AS workspace_name FROM supplier"""

_NODE_TYPES = """
SELECT DISTINCT 'm5.' || CAST(s_suppkey % 4 AS STRING) AS node_type, CAST(4 * (1 + s_suppkey % 4) AS DOUBLE) AS core_count
FROM supplier"""

# Events move to early 1997, where the bill has data, over three months.
_WHEN = "CAST(ts - INTERVAL '27' YEAR + INTERVAL '1' MONTH * (event_id % 3) AS TIMESTAMP)"

_HISTORY = f"""
SELECT CASE WHEN user_id % 11 <> 0 THEN 'wh-' || CAST(user_id % 10 AS STRING) END AS warehouse_id,
  CASE WHEN user_id % 13 <> 0 THEN 'user' || CAST(user_id AS STRING) END AS executed_by, {_WHEN} AS start_time,
  CAST(round(value * 1000) AS BIGINT) AS total_duration_ms, event_type = 'view' AS from_result_cache,
  CASE WHEN event_type = 'error' THEN CAST(round(value * 10) AS BIGINT) WHEN event_type = 'click' THEN CAST(0 AS BIGINT) END AS spilled_local_bytes,
  CAST(round(value) AS BIGINT) AS shuffle_read_bytes,
  'Driver, ' || CAST(user_id % 4 AS STRING) AS client_driver,
  CASE WHEN user_id % 3 = 0 THEN NULL ELSE 'app-' || CAST(user_id % 5 AS STRING) END AS client_application
FROM events"""

_SERVED = """
SELECT 'se-' || CAST(s_suppkey % 50 AS STRING) AS served_entity_id, 'ep-' || CAST(s_suppkey % 50 % 25 AS STRING) AS endpoint_id,
  'endpoint ' || CAST(s_suppkey % 50 % 25 AS STRING) AS endpoint_name,
  CASE s_suppkey % 5 WHEN 0 THEN 'EXTERNAL_MODEL' WHEN 1 THEN 'FOUNDATION_MODEL' WHEN 2 THEN 'CUSTOM_MODEL'
    WHEN 3 THEN 'FEATURE_SPEC' ELSE 'OTHER' END AS entity_type,
  'model-' || CAST(s_suppkey % 7 AS STRING) AS entity_name, CAST(s_suppkey % 3 AS STRING) AS entity_version,
  CASE WHEN s_suppkey % 4 = 0 THEN 'GPU' END AS custom_compute, CASE WHEN s_suppkey % 3 = 0 THEN 'CPU' END AS spec_compute,
  CASE WHEN s_suppkey % 6 = 0 THEN CAST(s_suppkey AS DOUBLE) END AS min_throughput,
  CASE WHEN s_suppkey % 6 = 0 THEN CAST(s_suppkey * 2 AS DOUBLE) END AS max_throughput,
  CAST(timestamp '2000-01-01 00:00:00' + INTERVAL '1' MINUTE * s_suppkey AS TIMESTAMP) AS change_time
FROM supplier"""

_REQUESTS = f"""
SELECT 'se-' || CAST(user_id % 60 AS STRING) AS served_entity_id, 'user' || CAST(user_id % 20 AS STRING) AS requester,
  CASE WHEN user_id % 4 = 0 THEN 'proj-' || CAST(user_id % 6 AS STRING) END AS context_project, {_WHEN} AS request_time,
  CASE WHEN event_id % 9 <> 0 THEN CAST(round(value * 100) AS BIGINT) END AS input_token_count,
  CAST(round(value * 10) AS BIGINT) AS output_token_count,
  CASE event_type WHEN 'error' THEN 500 WHEN 'click' THEN 400 ELSE 200 END AS status_code
FROM events"""

_TABLE_DETAIL = """
SELECT 'main.s' || CAST(p_size AS STRING) || '.t' || CAST(p_partkey AS STRING) AS table_name,
  CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'owner' || CAST(p_partkey % 9 AS STRING) END AS owner,
  p_partkey * 7919 % 1000003 AS size_in_bytes, p_partkey % 500 AS num_files,
  CASE p_partkey % 4 WHEN 0 THEN 'SNAPPY' WHEN 1 THEN 'zstd' WHEN 2 THEN 'snappy' END AS codec,
  CASE WHEN p_partkey % 10 = 9 THEN 'VIEW' ELSE 'MANAGED' END AS table_type
FROM part"""

_STL_QUERY = """
SELECT o_orderkey AS query, o_custkey % 40 AS userid, CAST(o_orderdate AS TIMESTAMP) AS starttime,
  CAST(o_orderdate + INTERVAL '1' SECOND * (o_orderkey % 100) AS TIMESTAMP) AS endtime,
  '  select /* ' || o_orderpriority || ' */ sum(x) from t' || CAST(o_custkey % 60 AS STRING) || ' where s = ''' || o_orderstatus
    || ''' and padding_padding_padding_padding_padding_padding_padding_padding_padding_padding_padding_padding_padding_padding_padding '
    || CAST(o_orderkey AS STRING) AS querytxt
FROM orders"""

_PLANES = {
    "db_usage": _USAGE,
    "db_prices": _PRICES,
    "db_nodes": _NODES,
    "db_runs": _RUNS,
    "db_jobs": _JOBS,
    "db_clusters": _CLUSTERS,
    "db_warehouses": _WAREHOUSES,
    "db_pipelines": _PIPELINES,
    "db_workspaces": _WORKSPACES,
    "db_node_types": _NODE_TYPES,
    "db_history": _HISTORY,
    "db_served": _SERVED,
    "db_requests": _REQUESTS,
    "db_table_detail": _TABLE_DETAIL,
    "stl_query": _STL_QUERY,
    "svl_query_summary": """
SELECT l_orderkey AS query, CASE WHEN l_linenumber = 1 AND l_partkey % 3 = 0 THEN 't' ELSE 'f' END AS is_diskbased FROM lineitem""",
    "stl_wlm_query": """
SELECT o_orderkey AS query, CAST(o_orderdate AS TIMESTAMP) AS queue_start_time, o_orderkey * 7919 % 9999991 AS total_queue_time,
  CAST(round(o_totalprice * 10) AS BIGINT) AS total_exec_time FROM orders""",
    "svcs_concurrency_scaling_usage": """
SELECT CAST(o_orderdate AS TIMESTAMP) AS start_time,
  CAST(o_orderdate + INTERVAL '1' SECOND * (o_orderkey % 77) AS TIMESTAMP) AS end_time FROM orders WHERE o_orderstatus = 'P'""",
    "svl_query_report": """
SELECT l_orderkey AS query, o_custkey % 40 AS userid, CASE WHEN l_linenumber = 1 AND l_partkey % 2 = 0 THEN 't' ELSE 'f' END AS is_diskbased,
  l_partkey * 1048576 AS bytes, l_suppkey * 1048576 AS workmem, l_partkey % 500 AS rows_out FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    "pg_user": """
SELECT DISTINCT c_custkey % 38 AS usesysid, 'u' || CAST(c_custkey % 38 AS STRING) AS usename FROM customer""",
    "svl_query_metrics_summary": """
SELECT o_orderkey AS query, o_custkey % 40 AS userid, CAST(round(o_totalprice * 100) AS BIGINT) AS query_execution_time,
  o_orderkey % 1000 AS query_queue_time, o_orderkey % 3000 AS query_cpu_time, o_orderkey % 70 AS query_blocks_read,
  o_orderkey % 9 AS query_temp_blocks_to_disk, o_orderkey % 5000 AS scan_row_count, o_orderkey % 11 AS spectrum_scan_row_count,
  o_orderkey % 13 AS spectrum_scan_size_mb FROM orders""",
    "svl_s3query_summary": """
SELECT l_orderkey AS query, 'ext_' || CAST(l_suppkey % 15 AS STRING) AS external_table_name, l_partkey * 1048576 AS s3_scanned_bytes,
  l_suppkey * 1048576 AS s3query_returned_bytes, CAST(l_shipdate AS TIMESTAMP) AS starttime FROM lineitem""",
    "stl_scan": """
SELECT l_orderkey AS query, l_suppkey AS tbl, CASE WHEN l_orderkey % 5 = 0 THEN CAST(0 AS BIGINT) ELSE l_partkey * 8 END AS bytes,
  CASE WHEN l_orderkey % 10 = 0 THEN CAST(0 AS BIGINT) ELSE l_partkey END AS rows_pre_filter, l_partkey % 100 AS rows_out,
  CASE WHEN l_linenumber = 7 THEN 'S3' ELSE 'orders' END AS perm_table_name, l_partkey % 40 AS userid,
  CAST(l_shipdate AS TIMESTAMP) AS starttime FROM lineitem""",
    "sys_external_query_detail": """
SELECT l_orderkey AS query_id, CASE WHEN l_linenumber = 7 THEN 'KAFKA' ELSE 'S3' END AS source_type,
  CASE WHEN l_suppkey % 6 = 0 THEN ' ' ELSE 'ext_' || CAST(l_suppkey % 15 AS STRING) END AS table_name,
  ' s3://bkt-' || CAST(l_suppkey % 8 AS STRING) AS file_location, 'PARQUET' AS file_format,
  l_partkey * 1000 AS duration, l_partkey % 9 AS total_partitions, l_partkey % 4 AS qualified_partitions,
  l_partkey % 30 AS scanned_files, l_partkey AS returned_rows, l_partkey * 100 AS returned_bytes, l_suppkey % 7 AS s3list_time,
  l_suppkey % 5 AS get_partition_time, CAST(l_shipdate AS TIMESTAMP) AS start_time FROM lineitem""",
    "svv_external_tables": """
SELECT 'dev' AS redshift_database_name, 'spectrum' AS schemaname, 'ext_' || CAST(s_suppkey AS STRING) AS tablename, 'TABLE' AS tabletype,
  's3://bkt-' || CAST(s_suppkey % 8 AS STRING) AS location, 'in' AS input_format, 'out' AS output_format, 'serde' AS serialization_lib,
  s_suppkey % 2 AS compressed, '{}' AS parameters FROM supplier""",
    "stl_connection_log": f"""
SELECT CASE WHEN event_type = 'signup' THEN 'disconnecting session' ELSE 'initiating session' END AS event, {_WHEN} AS recordtime,
  CASE WHEN user_id % 5 = 0 THEN '  ' ELSE ' JDBC ' || CAST(user_id % 3 AS STRING) END AS driver_version,
  CASE WHEN user_id % 4 = 0 THEN '' ELSE 'app' || CAST(user_id % 6 AS STRING) END AS application_name,
  'user' || CAST(user_id AS STRING) AS username FROM events""",
    "svv_table_info": """
SELECT s_suppkey AS table_id, 'dev' AS db_name, 'public' AS schema_name, 't' || CAST(s_suppkey AS STRING) AS table_name,
  CASE WHEN s_suppkey % 2 = 0 THEN 'Y' ELSE 'N' END AS encoded, 'EVEN' AS diststyle, s_suppkey * 13 % 101 AS size_mb,
  CAST(s_suppkey % 60 AS DOUBLE) AS unsorted, CAST(s_suppkey % 33 AS DOUBLE) AS stats_off, s_suppkey * 1000 AS tbl_rows FROM supplier
UNION ALL SELECT s_suppkey + 1000000, 'dev', 'public', 'u' || CAST(s_suppkey AS STRING), 'N', 'KEY', s_suppkey % 7, NULL, NULL, s_suppkey FROM supplier""",
    "pg_tables": """
SELECT 'public' AS schemaname, 't' || CAST(s_suppkey AS STRING) AS tablename, 'owner' || CAST(s_suppkey % 6 AS STRING) AS tableowner
FROM supplier WHERE s_suppkey % 3 <> 0""",
    "metric_points": f"""
SELECT 'cl-' || CAST(user_id % 12 AS STRING) AS cluster_id, CASE WHEN event_id % 2 = 0 THEN 'CPUUtilization' ELSE 'PercentageDiskSpaceUsed' END AS metric,
  {_WHEN} AS point_time, CASE WHEN event_id % 17 <> 0 THEN CAST(user_id % 90 AS DOUBLE) END AS average,
  CAST(user_id % 90 + event_id % 10 AS DOUBLE) AS maximum FROM events""",
    "cluster_inventory": """
SELECT 'cl-' || CAST(s_suppkey AS STRING) AS cluster_id, s_suppkey % 6 AS node_count, s_suppkey % 3 AS snapshot_days,
  CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey % 4 END AS tag_total, s_suppkey % 2 = 0 AS encrypted, s_suppkey % 3 = 0 AS is_public,
  'pg-' || CAST(s_suppkey % 4 AS STRING) AS parameter_group FROM supplier""",
    "reserved_inventory": """
SELECT s_suppkey AS reservation_id, s_suppkey % 3 AS node_count, CASE WHEN s_suppkey % 20 = 0 THEN 'active' ELSE 'retired' END AS state FROM supplier""",
    "parameter_inventory": """
SELECT DISTINCT 'pg-' || CAST(s_suppkey % 3 AS STRING) AS parameter_group, 'require_ssl' AS parameter_name,
  CASE WHEN s_suppkey % 3 = 0 THEN 'TRUE' ELSE 'false' END AS parameter_value FROM supplier""",
    "sf_sessions": """
SELECT event_id AS session_id, CASE user_id % 8 WHEN 0 THEN 'PythonConnector 3.' || CAST(user_id % 10 AS STRING) || '.0'
   WHEN 1 THEN 'JDBC 3.14.' || CAST(user_id % 9 AS STRING) WHEN 2 THEN 'Snowflake UI' WHEN 3 THEN NULL
   WHEN 4 THEN ' Go 1.7.2' WHEN 5 THEN 'SnowSQL 1.3.9' WHEN 6 THEN 'Kafka Connector 2.1.1' ELSE 'Mystery 1.0.0' END AS client_application_id FROM events""",
    "sf_queries": f"""
SELECT event_id % 9000 AS session_id, 'U' || CAST(user_id AS STRING) AS user_name, {_WHEN} AS start_time FROM events""",
}
dt.PLANES.update(_PLANES)

_OBJECT_IDS = (
    "database_instance_id", "catalog_id", "run_name", "ai_runtime_workload_id", "central_clean_room_id",
    "app_id", "agent_bricks_id", "base_environment_id", "schema_id", "sharing_materialization_id",
)
_METADATA = ("job_id", "job_name", "cluster_id", "warehouse_id", "notebook_id", "notebook_path",
             "endpoint_id", "endpoint_name", "dlt_pipeline_id")


def nested_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage rows with the source's struct and map columns."""
    flat = dt.plane(spark, sf_dir, "db_usage")
    tags = F.map_filter(
        F.create_map(F.lit("project"), F.col("tag_project"), F.lit("Name"), F.col("tag_name"),
                     F.lit("LakehouseMonitoringTableId"), F.col("tag_name")),
        lambda k, v: v.isNotNull())
    objects = [F.col("object_id").alias(c) for c in _OBJECT_IDS]
    objects.append(F.col("endpoint_name").alias("app_name"))
    return flat.select(
        "record_id", "record_type", "account_id", "workspace_id", "sku_name", "cloud", "usage_start_time",
        "usage_end_time", "usage_date", "usage_quantity", "usage_unit", "usage_type",
        "billing_origin_product", tags.alias("custom_tags"),
        F.struct(*_METADATA, *objects).alias("usage_metadata"),
        F.struct("run_as").alias("identity_metadata"),
        F.struct("is_photon", "jobs_tier").alias("product_features"),
    )


def nested_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dt.plane(spark, sf_dir, "db_prices").withColumn(
        "pricing", F.struct(F.col("price").alias("default"))).drop("price")


def nested_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    disk = F.create_map(F.lit("/"), F.lit(1).cast("bigint"), F.lit("/local_disk0"), F.col("local_disk_free"))
    return dt.plane(spark, sf_dir, "db_nodes").withColumn("disk_free_bytes_per_mount_point", disk)


def nested_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dt.plane(spark, sf_dir, "db_clusters").select(
        "*", F.struct(F.col("availability_aws").alias("availability")).alias("aws_attributes"),
        F.struct(F.col("availability_azure").alias("availability")).alias("azure_attributes"),
        F.transform(F.sequence(F.lit(1), F.col("tag_total") + 1), lambda i: i).alias("_seq"),
    ).withColumn("tags", F.map_from_arrays(
        F.slice(F.transform("_seq", lambda i: i.cast("string")), 1, F.col("tag_total").cast("int")),
        F.slice(F.transform("_seq", lambda i: i.cast("string")), 1, F.col("tag_total").cast("int")))).drop("_seq")


def nested_warehouses(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.slice(F.transform(F.sequence(F.lit(1), F.col("tag_total") + 1), lambda i: i.cast("string")),
                   1, F.col("tag_total").cast("int"))
    return dt.plane(spark, sf_dir, "db_warehouses").withColumn("tags", F.map_from_arrays(keys, keys))


def nested_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dt.plane(spark, sf_dir, "db_history").withColumn("compute", F.struct("warehouse_id"))


def nested_served(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dt.plane(spark, sf_dir, "db_served").select(
        "*", F.struct(F.col("custom_compute").alias("compute_type")).alias("custom_model_config"),
        F.struct(F.col("spec_compute").alias("compute_type")).alias("feature_spec_config"),
        F.struct(F.col("min_throughput").alias("min_provisioned_throughput"),
                 F.col("max_throughput").alias("max_provisioned_throughput")).alias("foundation_model_config"))


def nested_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    context = F.map_filter(F.create_map(F.lit("project"), F.col("context_project")), lambda k, v: v.isNotNull())
    return dt.plane(spark, sf_dir, "db_requests").withColumn("usage_context", context)
