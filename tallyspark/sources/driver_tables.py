"""Input planes derived from the driver's TPC-H-like tables.

Each plane is a SELECT in the dialect both Spark and ANSI engines accept, so the test oracle
can read the very same input rows. Only inputs live here; no operator logic does.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from tallyspark.operators.frame import in_short_methods  # noqa: F401

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

# A "now" inside the data, so partial-period flags are stable.
AS_OF = "2001-10-15"

_PROVIDER = "CASE l_suppkey % 3 WHEN 0 THEN 'AWS' WHEN 1 THEN 'Databricks' ELSE 'Snowflake' END"
_SERVICE = """CASE
    WHEN l_suppkey % 3 = 0 THEN CASE l_partkey % 4
        WHEN 0 THEN 'Amazon Redshift' WHEN 1 THEN 'Amazon Redshift Spectrum'
        WHEN 2 THEN 'Amazon Simple Storage Service' ELSE 'Amazon Elastic Compute Cloud' END
    WHEN l_suppkey % 3 = 1 THEN CASE
        WHEN l_partkey % 40 = 2 THEN 'AI_BI_GENIE'
        WHEN l_partkey % 40 = 22 THEN 'PREDICTIVE_OPTIMIZATION'
        WHEN l_partkey % 4 = 0 THEN 'JOBS' WHEN l_partkey % 4 = 1 THEN 'ALL_PURPOSE'
        WHEN l_partkey % 4 = 2 THEN 'SQL' ELSE 'MODEL_SERVING' END
    ELSE CASE l_partkey % 4
        WHEN 0 THEN 'WAREHOUSE_METERING' WHEN 1 THEN 'STORAGE'
        WHEN 2 THEN 'AI_SERVICES' ELSE 'DATA_TRANSFER' END END"""
_CATEGORY = """CASE
    WHEN l_suppkey % 3 = 0 THEN CASE l_partkey % 4
        WHEN 2 THEN 'Storage' WHEN 3 THEN 'Compute' ELSE 'Analytics' END
    WHEN l_suppkey % 3 = 1 THEN CASE
        WHEN l_partkey % 40 = 22 THEN 'AI and Machine Learning'
        WHEN l_partkey % 4 = 0 THEN 'Analytics' WHEN l_partkey % 4 = 1 THEN 'Compute'
        WHEN l_partkey % 4 = 2 THEN 'Databases' ELSE 'AI and Machine Learning' END
    ELSE CASE l_partkey % 4
        WHEN 0 THEN 'Compute' WHEN 1 THEN 'Storage'
        WHEN 2 THEN 'AI and Machine Learning' ELSE 'Networking' END END"""
_LIST = "CAST(l_extendedprice AS DECIMAL(20,6))"
_EFFECTIVE = f"""CAST({_LIST} * (CAST(1 AS DECIMAL(3,2)) - CAST(l_discount AS DECIMAL(3,2)))
    * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS DECIMAL(20,6))"""
_BILLED = f"""CAST({_EFFECTIVE}
    * (CAST(1 AS DECIMAL(3,2)) + CAST(l_tax AS DECIMAL(3,2))) AS DECIMAL(20,6))"""
_WORD = """CASE l_orderkey % 11
    WHEN 0 THEN 'Spectrum data scan' WHEN 1 THEN 'Concurrency scaling' WHEN 2 THEN 'TimedStorage'
    WHEN 3 THEN 'unused commitment' WHEN 4 THEN 'compute node' WHEN 5 THEN 'Data Transfer out'
    WHEN 6 THEN 'Requests tier 1' WHEN 7 THEN 'EarlyDelete fee' WHEN 8 THEN 'Monitoring'
    WHEN 9 THEN 'Intelligent-Tiering storage' ELSE 'misc' END"""
_RESOURCE = """CASE
    WHEN l_linenumber = 7 THEN NULL
    WHEN l_suppkey % 3 = 0 THEN CASE l_partkey % 4
        WHEN 2 THEN CASE WHEN l_orderkey % 6 = 0 THEN '' ELSE 'arn:aws:s3:::' END
            || 'bkt-' || CAST(l_suppkey % 60 AS STRING)
        WHEN 3 THEN 'arn:aws:ec2:us-east-1:1234:instance/i-' || CAST(l_suppkey AS STRING)
        ELSE CASE l_orderkey % 5
            WHEN 0 THEN 'arn:aws:redshift:us-east-1:1234:snapshot:sn-' || CAST(l_suppkey % 20 AS STRING)
            WHEN 1 THEN 'account-1234'
            ELSE 'arn:aws:redshift:us-east-1:1234:cluster:cl-' || CAST(l_suppkey % 20 AS STRING) END END
    WHEN l_suppkey % 3 = 1 AND l_partkey % 4 = 3 THEN 'ep-' || CAST(l_partkey % 25 AS STRING)
    ELSE 'res-' || CAST(l_partkey AS STRING) END"""
_SKU = """CASE
    WHEN p_size % 10 = 0 THEN NULL
    WHEN l_suppkey % 3 = 1 AND l_partkey % 4 = 3 THEN CASE l_partkey % 25 % 5
        WHEN 0 THEN 'ENTERPRISE_ALL_PURPOSE_COMPUTE' WHEN 1 THEN 'SERVERLESS_REAL_TIME_INFERENCE'
        WHEN 2 THEN p_brand ELSE 'PREMIUM_MODEL_SERVING' END
    ELSE p_brand END"""
_TAGS = """CASE WHEN l_linenumber % 4 = 0 THEN '{}' ELSE
    '{"' || CASE WHEN l_orderkey % 2 = 0 THEN 'team' ELSE 'Team' END || '":"' || c_mktsegment
    || '","' || CASE l_linenumber % 3 WHEN 0 THEN 'Project' WHEN 1 THEN 'cost-project' ELSE 'project' END
    || '":"' || o_orderpriority || '"}' END"""
_COMMITTED = "l_suppkey % 3 = 0 AND l_linenumber % 3 = 1"

# bill column -> (rule, joined tables it needs)
_BILL_RULES: dict[str, tuple[str, tuple[str, ...]]] = {
    "dedupe_key": ("CAST(NULL AS STRING)", ()),
    "ingest_run_id": ("'fixture'", ()),
    "x_ingested_at": ("CAST(NULL AS TIMESTAMP)", ()),
    "provider_name": (_PROVIDER, ()),
    "billing_account_id": ("'acct-' || CAST(c_nationkey AS STRING)", ("customer",)),
    "billing_account_name": ("CAST(NULL AS STRING)", ()),
    "sub_account_id": (
        "CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE c_mktsegment END", ("customer",)),
    "sub_account_name": ("CAST(NULL AS STRING)", ()),
    "billing_period_start": ("CAST(date_trunc('month', l_shipdate) AS DATE)", ()),
    "billing_period_end": (
        "CAST(date_trunc('month', l_shipdate) + INTERVAL '1' MONTH AS DATE)", ()),
    "charge_period_start": ("CAST(l_shipdate AS TIMESTAMP)", ()),
    "charge_period_end": ("CAST(l_shipdate + INTERVAL '1' DAY AS TIMESTAMP)", ()),
    "billing_currency": ("'USD'", ()),
    "billed_cost": (_BILLED, ()),
    "effective_cost": (_EFFECTIVE, ()),
    "list_cost": (_LIST, ()),
    "contracted_cost": (_LIST, ()),
    "charge_category": (
        "CASE WHEN l_returnflag = 'R' THEN 'Credit' "
        "WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'Adjustment' ELSE 'Usage' END", ()),
    "charge_class": ("CASE WHEN l_orderkey % 50 = 0 THEN 'Correction' END", ()),
    "charge_description": (
        f"CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE p_type || ' ' || {_WORD} || "
        "CASE WHEN l_orderkey % 10 = 0 THEN ' for arn:aws:redshift:us-east-1:1234:reserved/r-' "
        "|| CAST(l_suppkey AS STRING) || ' fee' ELSE '' END END", ("part",)),
    "service_category": (_CATEGORY, ()),
    "service_name": (_SERVICE, ()),
    "sku_id": (_SKU, ("part",)),
    "region_id": (
        "CASE WHEN l_orderkey % 19 = 0 THEN NULL ELSE n_name END", ("supplier", "nation")),
    "pricing_category": (
        "CASE l_linenumber % 3 WHEN 0 THEN 'Standard' WHEN 1 THEN 'Committed' ELSE 'Dynamic' END", ()),
    "resource_id": (_RESOURCE, ()),
    "resource_name": (
        f"CASE WHEN l_partkey % 3 = 0 OR l_linenumber = 7 THEN NULL ELSE 'name of ' || {_RESOURCE} END", ()),
    "resource_type": (
        "CASE WHEN l_suppkey % 3 = 2 THEN NULL WHEN l_suppkey % 3 = 1 THEN 'workload' "
        "ELSE 'aws-' || CAST(l_partkey % 4 AS STRING) END", ()),
    "consumed_quantity": ("CAST(l_quantity AS DOUBLE)", ()),
    "consumed_unit": ("'DBU'", ()),
    "tags": (_TAGS, ("customer",)),
    "commitment_discount_id": (
        f"CASE WHEN {_COMMITTED} THEN 'ri-' || CAST(l_suppkey % 7 AS STRING) END", ()),
    "commitment_discount_type": (
        f"CASE WHEN {_COMMITTED} THEN CASE WHEN l_suppkey % 2 = 0 "
        "THEN 'Reserved Instance' ELSE 'Savings Plan' END END", ()),
    "commitment_discount_category": (
        f"CASE WHEN {_COMMITTED} THEN CASE WHEN l_suppkey % 2 = 0 THEN 'Usage' ELSE 'Spend' END END", ()),
    "commitment_discount_name": ("CAST(NULL AS STRING)", ()),
    "commitment_discount_status": (
        f"CASE WHEN {_COMMITTED} THEN CASE WHEN l_returnflag = 'N' THEN 'Unused' ELSE 'Used' END END", ()),
    "commitment_discount_quantity": ("CAST(NULL AS DOUBLE)", ()),
    "commitment_discount_unit": ("CAST(NULL AS STRING)", ()),
    "invoice_id": (
        "CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE 'inv-' || CAST(l_orderkey AS STRING) END", ()),
    "invoice_issuer_name": (_PROVIDER, ()),
    "x_compute_class": ("'n/a'", ()),
    "x_focus_version": ("'1.3'", ()),
    "x_effective_is_list": ("l_suppkey % 3 = 1 AND l_suppkey % 2 = 0", ()),
    "x_record_id": ("CAST(NULL AS STRING)", ()),
    "x_record_type": ("CAST(NULL AS STRING)", ()),
    # Exact line-level label, independent of the keyword classifier.
    "x_cost_subcategory": (
        "CASE WHEN l_suppkey % 3 <> 0 OR l_returnflag = 'R' OR l_partkey % 4 = 3 THEN NULL "
        "WHEN l_orderkey % 4 = 0 THEN 'compute' WHEN l_orderkey % 4 = 1 THEN 'storage' "
        "WHEN l_orderkey % 4 = 2 THEN 'other' WHEN l_partkey % 4 = 2 THEN 'requests' "
        "WHEN l_partkey % 8 = 0 THEN NULL WHEN l_partkey % 4 = 1 THEN 'spectrum_scan' "
        "ELSE 'concurrency_scaling' END", ()),
    "x_source_connector": (f"lower({_PROVIDER})", ()),
    "charge_month": ("substr(CAST(CAST(l_shipdate AS DATE) AS STRING), 1, 7)", ()),
}

_BILL_JOINS = {
    "customer": "LEFT JOIN orders ON o_orderkey = l_orderkey "
                "LEFT JOIN customer ON c_custkey = o_custkey",
    "part": "LEFT JOIN part ON p_partkey = l_partkey",
    "supplier": "LEFT JOIN supplier ON s_suppkey = l_suppkey",
    "nation": "LEFT JOIN nation ON n_nationkey = s_nationkey",
}


# The customer joins of the bill with orders and customers joined first. Both joins keep their left rows and each names only its own right
# table, so the rows are the same; between tasks, narrow orders move to their customers instead of bill lines with all their columns.
_ORDERS_FIRST = (
    "LEFT JOIN (SELECT * FROM orders LEFT JOIN customer ON c_custkey = o_custkey) AS ordered ON o_orderkey = l_orderkey")


def bill_select(columns: Iterable[str] | None = None) -> str:
    """The bill plane, joining only the tables its requested columns come from."""
    wanted = list(_BILL_RULES) if columns is None else [c for c in _BILL_RULES if c in set(columns)]
    needed = {t for c in wanted for t in _BILL_RULES[c][1]}
    items = ",\n  ".join(f"{_BILL_RULES[c][0]} AS {c}" for c in wanted)
    joins = " ".join(text for name, text in _BILL_JOINS.items() if name in needed)
    return f"SELECT {items}\nFROM lineitem {joins}"


# --- efficiency plane -------------------------------------------------------------------
# h mixes supplier and month; keys absent on some rows exercise NULL handling.
_CAUSE_KEYS: dict[str, tuple[str, str]] = {
    "failed_cost": ("double", "CASE WHEN h % 7 = 0 THEN CAST(h % 50 AS DOUBLE) + 0.5 END"),
    "pct_runs_underutilized": ("double", "CASE WHEN h % 3 = 0 THEN 0.9 WHEN h % 3 = 1 THEN 0.4 END"),
    "photon": ("boolean", "CASE WHEN h % 4 = 0 THEN true WHEN h % 4 = 1 THEN false END"),
    "min_autoscale_workers": ("bigint", "CASE WHEN h % 5 <> 0 THEN h % 3 END"),
    "max_autoscale_workers": ("bigint", "CASE WHEN h % 5 <> 0 THEN h % 11 END"),
    "auto_termination_minutes": ("bigint", "CASE WHEN h % 3 <> 0 THEN 20 + h % 90 END"),
    "worker_node_type": ("string", "CASE h % 5 WHEN 0 THEN 'm5.xlarge' WHEN 1 THEN 'm6g.large' WHEN 2 THEN 'r5d.2xlarge' WHEN 3 THEN 'Standard_D4' END"),
    "core_count": ("double", "CASE WHEN h % 4 <> 3 THEN CAST(h % 32 AS DOUBLE) END"),
    "availability": ("string", "CASE h % 3 WHEN 0 THEN 'ON_DEMAND' WHEN 1 THEN 'SPOT_WITH_FALLBACK' END"),
    "storage_class": ("string", "CASE h % 3 WHEN 0 THEN 'standard' WHEN 1 THEN 'intelligent_tiering' END"),
    "compression_codec": ("string", "CASE h % 3 WHEN 0 THEN 'snappy' WHEN 1 THEN 'zstd' END"),
    "num_files": ("bigint", "CASE WHEN h % 2 = 0 THEN h % 1000 END"),
    "max_cpu_pct": ("double", "CASE WHEN h % 4 <> 0 THEN CAST(h % 100 AS DOUBLE) + 0.5 END"),
    "max_mem_pct": ("double", "CASE WHEN h % 3 <> 0 THEN CAST(h % 90 AS DOUBLE) END"),
    "job_shaped_cost": ("double", "CASE WHEN h % 3 = 0 THEN CAST(h % 700 AS DOUBLE) END"),
    "top_job_name": ("string", "CASE WHEN h % 2 = 0 THEN 'nightly ' || CAST(h % 9 AS STRING) END"),
    "top_job_owner": ("string", "CASE WHEN h % 3 = 0 THEN 'Owner' || CAST(h % 4 AS STRING) END"),
    "cache_hit_pct": ("double", "CASE WHEN h % 5 <> 0 THEN CAST(h % 12 AS DOUBLE) END"),
    "query_count": ("bigint", "CASE WHEN h % 6 <> 0 THEN (h % 40) * 100 END"),
    "spill_query_count": ("bigint", "CASE WHEN h % 4 <> 0 THEN h % 60 END"),
    "spilled_bytes": ("double", "CASE WHEN h % 2 = 0 THEN CAST(h % 90 AS DOUBLE) * 100000000 END"),
    "shuffle_bytes": ("double", "CAST(h % 10 AS DOUBLE)"),
    "pct_time_high_cpu_wait": ("double", "CASE WHEN h % 3 = 0 THEN CAST(h % 40 AS DOUBLE) / 100 END"),
    "pct_time_high_mem_swap": ("double", "CASE WHEN h % 3 = 1 THEN CAST(h % 40 AS DOUBLE) / 100 END"),
    "min_local_disk_free_bytes": ("double", "CASE WHEN h % 5 = 0 THEN CAST(h % 30 AS DOUBLE) * 1000000000 END"),
    "network_bytes": ("double", "CASE WHEN h % 2 = 1 THEN CAST(h % 900 AS DOUBLE) * 1000000000 END"),
    "avg_run_seconds": ("double", "CASE WHEN h % 4 <> 1 THEN CAST(h % 900 AS DOUBLE) END"),
    "warehouse_type": ("string", "CASE h % 3 WHEN 0 THEN 'SERVERLESS' WHEN 1 THEN 'PRO' END"),
    "avg_interval_minutes": ("double", "CASE WHEN h % 4 <> 0 THEN CAST(h % 120 AS DOUBLE) END"),
    "duration_share_pct": ("double", "CASE WHEN h % 5 <> 1 THEN CAST(h % 100 AS DOUBLE) END"),
    "serving_mode": ("string", "CASE WHEN h % 2 = 0 THEN 'pay_per_token' END"),
    "scale_to_zero_enabled": ("boolean", "CASE WHEN h % 3 = 0 THEN false WHEN h % 3 = 1 THEN true END"),
    "workload_type": ("string", "CASE h % 4 WHEN 0 THEN 'GPU_MEDIUM' WHEN 1 THEN 'CPU' WHEN 2 THEN 'GPU_LARGE' END"),
    "workload_size": ("string", "CASE WHEN h % 2 = 0 THEN 'Small' END"),
    "request_count": ("bigint", "CASE WHEN h % 5 <> 0 THEN h % 200 END"),
    "total_tokens": ("bigint", "h % 5000"),
    "jobs_priced_cost": ("double", "CASE WHEN h % 2 = 0 THEN CAST(h % 400 AS DOUBLE) END"),
    "compute_cost": ("double", "CASE WHEN h % 4 <> 0 THEN CAST(h % 300 AS DOUBLE) END"),
    "concurrency_scaling_cost": ("double", "CASE WHEN h % 3 <> 0 THEN CAST(h % 100 AS DOUBLE) END"),
    "spectrum_scan_cost": ("double", "CASE WHEN h % 3 = 0 THEN CAST(h % 77 AS DOUBLE) END"),
    "wlm_queue_wait_ms_p95": ("double", "CASE WHEN h % 2 = 0 THEN CAST(h % 13 AS DOUBLE) * 1000 END"),
    "wlm_queue_wait_ms_p99": ("double", "CASE WHEN h % 4 = 0 THEN CAST(h % 17 AS DOUBLE) * 1000 END"),
    "disk_spill_query_count": ("bigint", "CASE WHEN h % 5 <> 0 THEN h % 50 END"),
    "on_demand_node_hours": ("double", "CASE WHEN h % 3 <> 1 THEN CAST(h % 700 AS DOUBLE) END"),
    "reserved_node_hours": ("double", "CASE WHEN h % 2 = 0 THEN CAST(h % 500 AS DOUBLE) END"),
    "activity_measured_since": ("string", "CASE WHEN h % 4 = 0 THEN '1998-01-15' END"),
    "diststyle": ("string", "CASE WHEN h % 2 = 0 THEN 'EVEN' END"),
    "unsorted_pct": ("double", "CASE WHEN h % 3 <> 2 THEN CAST(h % 60 AS DOUBLE) END"),
    "stats_off_pct": ("double", "CASE WHEN h % 4 <> 2 THEN CAST(h % 50 AS DOUBLE) END"),
    "tbl_rows": ("bigint", "CASE WHEN h % 2 = 0 THEN h * 10 END"),
    "encoded": ("string", "CASE h % 3 WHEN 0 THEN 'N' WHEN 1 THEN 'Y' END"),
    "run_count": ("bigint", "CASE WHEN h % 6 <> 0 THEN h % 12 END"),
    "pct_runs_spilling": ("double", "CASE WHEN h % 3 <> 0 THEN CAST(h % 100 AS DOUBLE) / 100 END"),
    "avg_disk_spill_gb": ("double", "CASE WHEN h % 2 = 0 THEN CAST(h % 300 AS DOUBLE) / 100 END"),
    "avg_skew_ratio": ("double", "CASE WHEN h % 4 <> 0 THEN CAST(h % 50 AS DOUBLE) / 10 END"),
    "max_skew_ratio": ("double", "CASE WHEN h % 2 = 0 THEN CAST(h % 90 AS DOUBLE) / 10 END"),
    "days_since_last_access": ("bigint", "CASE WHEN h % 4 <> 0 THEN h % 200 END"),
    "spectrum_scan_count": ("bigint", "CASE WHEN h % 2 = 0 THEN h % 30 END"),
    "spectrum_scanned_gb": ("double", "CASE WHEN h % 4 = 1 THEN CAST(h % 90 AS DOUBLE) / 10 END"),
    "spectrum_returned_gb": ("double", "CASE WHEN h % 3 = 0 THEN CAST(h % 40 AS DOUBLE) / 10 END"),
    "spectrum_allocated_cost": ("double", "CASE WHEN h % 8 = 1 THEN CAST(h % 60 AS DOUBLE) END"),
    "spectrum_allocation_pct": ("double", "CASE WHEN h % 8 = 1 THEN CAST(h % 100 AS DOUBLE) END"),
    "spectrum_allocation_status": ("string", "CASE WHEN h % 8 = 1 THEN 'allocated' END"),
    "policy_id": ("string", "CASE WHEN h % 3 = 0 THEN 'pol-' || CAST(h % 5 AS STRING) END"),
    "tag_count": ("bigint", "CASE WHEN h % 4 <> 0 THEN h % 3 END"),
    "auto_stop_minutes": ("bigint", "CASE WHEN h % 5 <> 0 THEN h % 50 END"),
}

_BYTE_KEYS = ("spilled_bytes", "min_local_disk_free_bytes", "network_bytes")

_EFF_GROUPED = f"""
SELECT l_suppkey AS sk, substr(CAST(CAST(l_shipdate AS DATE) AS STRING), 1, 7) AS charge_month,
  l_suppkey * 7 + max(year(l_shipdate) * 12 + month(l_shipdate)) AS h,
  CAST(sum(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * {_BILLED}) AS DECIMAL(20,6)) AS billed_cost,
  sum(CAST(l_quantity AS DOUBLE)) AS qty,
  sum(CAST(round(l_discount * 100) AS BIGINT)) AS disc, count(*) AS n
FROM lineitem GROUP BY l_suppkey, substr(CAST(CAST(l_shipdate AS DATE) AS STRING), 1, 7)"""

_EFF_FLAT = f"""
SELECT CASE sk % 9 WHEN 0 THEN 'job' WHEN 1 THEN 'interactive' WHEN 2 THEN 'sql_warehouse'
    WHEN 3 THEN 'sql_warehouse_user' WHEN 4 THEN 'notebook' WHEN 5 THEN 'endpoint'
    WHEN 6 THEN 'storage' WHEN 7 THEN 'table' ELSE 'query_pattern' END AS entity_type,
  'ent-' || CAST(sk AS STRING) AS entity_id, 'Entity ' || CAST(sk AS STRING) AS entity_name,
  CASE h % 6 WHEN 0 THEN NULL WHEN 1 THEN ' '
    WHEN 2 THEN '0a1b2c3d-0000-4000-8000-00000000000' || CAST(sk % 3 AS STRING)
    WHEN 3 THEN ' Alice' || CAST(sk % 5 AS STRING) ELSE 'alice' || CAST(sk % 5 AS STRING) END AS owner_user,
  CASE h % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Apollo' WHEN 2 THEN 'apollo ' ELSE 'gemini' END AS owner_project,
  billed_cost, qty * 1001 AS native_quantity, CASE h % 3 WHEN 0 THEN ' DBU' ELSE 'dbu' END AS native_unit,
  CASE h % 6 WHEN 0 THEN CAST(NULL AS DOUBLE) WHEN 1 THEN CAST(disc % 20 AS DOUBLE) WHEN 2 THEN CAST(100 AS DOUBLE)
    ELSE CAST(disc % 97 AS DOUBLE) + CAST(0.5 AS DOUBLE) END AS utilization_pct,
  CASE h % 8 WHEN 0 THEN CAST(0 AS BIGINT) WHEN 1 THEN CAST(NULL AS BIGINT) ELSE n END AS activity_count,
  CASE sk % 2 WHEN 0 THEN 'Databricks' ELSE 'AWS' END AS provider_name,
  CASE sk % 2 WHEN 0 THEN 'databricks' ELSE 'aws' END AS x_source_connector, charge_month, h, sk
FROM efficiency_grouped"""

_KEY_ITEMS = ",\n  ".join(
    f"CAST({rule} AS {kind.upper()}) AS {key}" for key, (kind, rule) in _CAUSE_KEYS.items()
)
_EFF_TYPED = f"SELECT efficiency_flat.*,\n  {_KEY_ITEMS}\nFROM efficiency_flat"

# --- AI usage ------------------------------------------------------------------------------
_AI_USAGE = """
SELECT 'ep-' || CAST(user_id % 30 AS STRING) AS endpoint_id,
  CASE WHEN user_id % 30 = 4 THEN NULL ELSE 'endpoint ' || CAST(user_id % 30 AS STRING) END AS endpoint_name,
  'se-' || CAST(user_id % 60 AS STRING) AS served_entity_id,
  CASE WHEN user_id % 7 = 0 THEN NULL ELSE 'model-' || CAST(user_id % 6 AS STRING) END AS model_name,
  CASE WHEN user_id % 5 = 0 THEN NULL ELSE CAST(user_id % 3 AS STRING) END AS model_version,
  CASE user_id % 3 WHEN 0 THEN 'custom' WHEN 1 THEN 'foundation' END AS model_kind,
  CASE user_id % 30 % 5 WHEN 0 THEN 'pay_per_token' WHEN 1 THEN 'pay_per_token' WHEN 2 THEN 'external'
    WHEN 3 THEN 'provisioned_throughput' ELSE 'unknown' END AS serving_mode,
  CASE user_id % 9 WHEN 0 THEN NULL WHEN 1 THEN '  '
    WHEN 2 THEN '0A1b2c3d-0000-4000-8000-00000000000' || CAST(user_id % 4 AS STRING)
    WHEN 3 THEN 'User' || CAST(user_id % 20 AS STRING) ELSE ' user' || CAST(user_id % 20 AS STRING) END AS requester,
  CASE WHEN user_id % 4 = 0 THEN 'proj-' || CAST(user_id % 6 AS STRING) END AS usage_context_project,
  CASE user_id % 30 % 3 WHEN 0 THEN true WHEN 1 THEN false END AS scale_to_zero_enabled,
  CASE WHEN user_id % 2 = 0 THEN 'Small' END AS workload_size,
  CASE user_id % 30 % 4 WHEN 0 THEN 'GPU_MEDIUM' WHEN 1 THEN 'CPU' END AS workload_type,
  CAST(NULL AS DOUBLE) AS min_provisioned_throughput, CAST(NULL AS DOUBLE) AS max_provisioned_throughput,
  count(*) AS request_count,
  CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS error_request_count,
  CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS input_tokens,
  CAST(sum(CAST(round(value * 40) AS BIGINT)) AS BIGINT) AS output_tokens,
  CAST(sum(CASE WHEN event_type = 'error' THEN CAST(round(value * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS error_input_tokens,
  CAST(0 AS BIGINT) AS error_output_tokens, CAST(sum(CAST(round(value * 10) AS BIGINT)) AS BIGINT) AS total_duration_ms,
  'databricks' AS x_source_connector, 'Databricks' AS provider_name,
  CASE event_id % 3 WHEN 0 THEN '1997-03' WHEN 1 THEN '1997-04' ELSE '1997-05' END AS charge_month
FROM events
GROUP BY user_id, CASE event_id % 3 WHEN 0 THEN '1997-03' WHEN 1 THEN '1997-04' ELSE '1997-05' END"""

_STORAGE = """
SELECT CASE s_suppkey % 4 WHEN 0 THEN 'metastore_root' WHEN 3 THEN 'external_location' ELSE 'catalog' END AS location_kind,
  'loc-' || CAST(s_suppkey % 45 AS STRING) AS location_name,
  's3://bkt-' || CAST(s_suppkey % 40 AS STRING) || CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE '/p' || CAST(s_suppkey AS STRING) END AS url,
  's3' AS scheme, CASE WHEN s_suppkey % 10 = 9 THEN NULL ELSE 'AWS' END AS cloud_provider_name,
  'bkt-' || CAST(s_suppkey % 40 AS STRING) AS bucket_name,
  CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'p' || CAST(s_suppkey AS STRING) END AS key_prefix,
  s_suppkey % 2 = 0 AS is_read_only, CAST(NULL AS STRING) AS credential_name,
  'databricks' AS x_source_connector, 'Databricks' AS provider_name,
  CASE WHEN s_suppkey % 5 = 0 THEN '2001-05' ELSE '2001-06' END AS snapshot_month
FROM supplier"""

_COMPUTE = """
SELECT DISTINCT 'clu-' || CAST(l_suppkey % 15 AS STRING) AS cluster_id,
  CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE 'job-' || CAST(l_suppkey % 15 AS STRING) || '-run' END AS cluster_name,
  CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE 'alice' || CAST(l_suppkey % 5 AS STRING) END AS owner_user,
  'i-' || CAST(l_suppkey AS STRING) AS instance_id,
  CASE l_suppkey % 3 WHEN 0 THEN l_suppkey % 2 = 0 END AS is_driver,
  CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE 'm5.' || CAST(l_suppkey % 4 AS STRING) END AS node_type,
  'databricks' AS x_source_connector, 'Databricks' AS provider_name,
  substr(CAST(CAST(l_shipdate AS DATE) AS STRING), 1, 7) AS charge_month
FROM lineitem WHERE month(l_shipdate) % 3 <> 0 AND l_suppkey % 6 <> 5"""

_DRIVERS = """
SELECT CASE event_type WHEN 'view' THEN 'JDBC' WHEN 'click' THEN 'ODBC' WHEN 'error' THEN 'Go'
      WHEN 'signup' THEN 'PythonConnector' ELSE NULL END
    || ' ' || CAST(3 + user_id % 2 AS STRING) || '.' || CAST(user_id % 15 AS STRING) || '.' || CAST(user_id % 6 AS STRING) AS client_driver,
  CASE WHEN user_id % 4 = 0 THEN NULL ELSE 'app-' || CAST(user_id % 5 AS STRING) END AS client_application,
  'user' || CAST(user_id AS STRING) AS executed_by,
  CASE WHEN user_id % 3 = 0 THEN 'wh-' || CAST(user_id % 4 AS STRING) END AS cluster_id,
  count(*) AS query_count,
  CASE user_id % 3 WHEN 0 THEN 'supported' WHEN 1 THEN 'unsupported' ELSE 'unknown' END AS support_status,
  CASE user_id % 2 WHEN 0 THEN 'databricks' ELSE 'snowflake' END AS x_source_connector,
  CASE user_id % 2 WHEN 0 THEN 'Databricks' ELSE 'Snowflake' END AS provider_name,
  CASE event_id % 2 WHEN 0 THEN '2023-12' ELSE '2024-01' END AS charge_month
FROM events GROUP BY event_type, user_id, event_id % 2"""

_POLICY = """
SELECT 'cl-' || CAST(s_suppkey AS STRING) AS cluster_id,
  CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 'Cluster ' || CAST(s_suppkey AS STRING) END AS cluster_name,
  CASE s_suppkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS encrypted,
  CASE s_suppkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false END AS publicly_accessible,
  CASE s_suppkey % 5 WHEN 0 THEN true WHEN 1 THEN false END AS enhanced_vpc_routing,
  CASE WHEN s_suppkey % 6 <> 0 THEN s_suppkey % 15 END AS automated_snapshot_retention_days,
  CASE s_suppkey % 2 WHEN 0 THEN true WHEN 1 THEN false END AS require_ssl,
  CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey % 3 END AS tag_count,
  'redshift' AS x_source_connector, 'AWS' AS provider_name,
  CASE s_suppkey % 2 WHEN 0 THEN '2001-05' ELSE '2001-06' END AS snapshot_month
FROM supplier"""

_TURNS = """
SELECT 't' || CAST(event_id AS STRING) AS turn_id, 's' || CAST(user_id AS STRING) AS session_id, 'm' || CAST(user_id % 3 AS STRING) AS model,
  event_id % 400 AS total_tokens, event_id % 5 AS tool_call_count,
  CASE WHEN event_id % 9 <> 0 THEN CAST(value AS DOUBLE) END AS duration_ms,
  CAST(event_id % 700 AS DOUBLE) AS plan_ms, CAST(user_id % 90 AS DOUBLE) AS explore_ms,
  CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 300 AS DOUBLE) END AS execute_ms, CAST(user_id AS DOUBLE) AS synthesize_ms,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'clarify' ELSE 'answer' END AS outcome,
  CASE event_id % 5 WHEN 0 THEN 'model' WHEN 1 THEN 'caption' WHEN 2 THEN 'summary_spec' WHEN 3 THEN 'deterministic' END AS answer_source,
  CASE event_id % 3 WHEN 0 THEN 'deterministic' WHEN 1 THEN 'model' END AS route
FROM events"""

# plane -> SELECT over base tables and earlier planes
PLANES: dict[str, str] = {
    "efficiency_grouped": _EFF_GROUPED,
    "efficiency_flat": _EFF_FLAT,
    "efficiency_typed": _EFF_TYPED,
    "ai_usage": _AI_USAGE,
    "storage_location": _STORAGE,
    "compute_instance": _COMPUTE,
    "driver_health": _DRIVERS,
    "policy_config": _POLICY,
    "turn_log": _TURNS,
}


def referenced(sql: str, names: Iterable[str]) -> list[str]:
    return [n for n in names if re.search(rf"\b{n}\b", sql)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def select(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run *sql* with base-table and plane names bound to DataFrames."""
    bound = {}
    for name in referenced(sql, BASE_TABLES):
        bound[name] = table(spark, sf_dir, name)
    for name in referenced(sql, PLANES):
        bound[name] = plane(spark, sf_dir, name)
    text = sql
    if _BILL_JOINS["customer"] in text and _moves(bound["orders"], "o_orderkey", "o_custkey") and _moves(
            bound["customer"], "c_custkey", "c_nationkey", "c_mktsegment"):
        text = text.replace(_BILL_JOINS["customer"], _ORDERS_FIRST)
    aliases = "|".join(sorted(bound, key=len, reverse=True))
    if aliases:
        text = text.replace("{", "{{").replace("}", "}}")
        text = re.sub(rf"\b(FROM|JOIN)\s+({aliases})\b", r"\1 {\2} AS \2", text)
    return spark.sql(text, **bound) if bound else spark.sql(text)


def _moves(rows: DataFrame, *columns: str) -> bool:
    """Whether a join with these columns moves both sides between tasks, being too large for Spark to broadcast."""
    size = rows.select(*columns)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) > rows.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def plane(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return select(spark, sf_dir, PLANES[name])


def bill(spark: SparkSession, sf_dir: str, columns: Iterable[str] | None = None) -> DataFrame:
    return select(spark, sf_dir, bill_select(columns))


def efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Efficiency records with their causes packed into one JSON object, as a source delivers them."""
    from pyspark.sql import functions as F

    typed = plane(spark, sf_dir, "efficiency_typed")
    # Byte counts travel as whole numbers.
    detail = F.to_json(F.struct(*[
        F.col(k).cast("bigint").alias(k) if k in _BYTE_KEYS else F.col(k) for k in _CAUSE_KEYS]))
    return typed.withColumn("cause_detail", detail).drop("h", "sk", *_CAUSE_KEYS)
