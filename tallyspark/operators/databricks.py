"""Lakehouse platform telemetry to efficiency, AI-usage, instance and driver planes.

Usage is the big table: every operator aggregates it to its own grain before joining anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.operators.frame import latest_by_key, ratio, top_rows, union_all
from tallyspark.operators.price_index import price_index, with_price

_OPEN_END = "9999-12-31 00:00:00"


def _month(c: str) -> Column:
    return F.trunc(F.to_date(c), "MM").alias("charge_month")


def _in_window(c: str, start: str, end: str) -> Column:
    """Half-open on the day after *end*."""
    return (F.col(c) >= F.lit(start).cast("timestamp")) & (
        F.col(c) < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp"))


def top_by(value: str, weight: str) -> Column:
    """Value on the heaviest row, NULL included; equal weights go to the greatest value."""
    return F.max_by(F.col(value), F.struct(weight, value))


def price_windows(prices: DataFrame) -> DataFrame:
    """USD prices with half-open validity; a price without an end is still valid."""
    return prices.where(F.col("currency_code") == "USD").select(
        "sku_name", "cloud", F.col("pricing.default").cast("double").alias("unit_price"),
        "price_start_time",
        F.coalesce("price_end_time", F.lit(_OPEN_END).cast("timestamp")).alias("price_end_time"),
    )


def _index(windows: DataFrame) -> DataFrame:
    return price_index(windows, ["sku_name", "cloud"], F.col("unit_price"), "price_start_time", "price_end_time")


def _valid_price(usage: DataFrame, index: DataFrame, sku: str, name: str) -> DataFrame:
    """Usage with the price of its SKU and cloud whose validity holds its end; no row doubles or goes."""
    return with_price(usage, index, [(F.col(sku), "sku_name"), (F.col("cloud"), "cloud")], F.col("usage_end_time"), name)


def priced_usage(
    usage: DataFrame, prices: DataFrame, start: str, end: str, project_key: str = "project"
) -> DataFrame:
    """Usage with its own price and the price of the same work on jobs compute."""
    index = _index(price_windows(prices))
    rows = usage.where(F.col("usage_date").between(start, end)).withColumn(
        "_jobs_sku", F.regexp_replace("sku_name", "ALL_PURPOSE|INTERACTIVE|NOTEBOOKS", "JOBS"))
    rows = _valid_price(rows, index, "sku_name", "_price")
    rows = _valid_price(rows, index, "_jobs_sku", "_jobs_price")
    meta = F.col("usage_metadata")
    quantity = F.col("usage_quantity")
    return rows.select(
        *[meta[c].alias(c) for c in ("job_id", "job_name", "cluster_id", "warehouse_id",
                                     "notebook_id", "notebook_path")],
        F.col("identity_metadata.run_as").alias("run_as"),
        F.col("billing_origin_product").alias("product"), "sku_name",
        F.try_element_at("custom_tags", F.lit(project_key)).alias("project"),
        _month("usage_date"), "usage_quantity",
        (quantity * F.coalesce("_price", F.lit(0.0))).alias("cost"),
        (quantity * F.coalesce("_jobs_price", "_price", F.lit(0.0))).alias("jobs_priced_cost"),
        F.coalesce("product_features.is_photon", F.lit(False)).alias("photon"),
    )


def node_utilization_month(nodes: DataFrame, start: str, end: str) -> DataFrame:
    cpu = F.col("cpu_user_percent") + F.col("cpu_system_percent")

    def share(c: str, floor: int) -> Column:
        return F.avg(F.when(F.col(c) >= floor, 1.0).otherwise(0.0))

    return nodes.where(_in_window("start_time", start, end)).groupBy("cluster_id", _month("start_time")).agg(
        F.avg(cpu).alias("avg_cpu"), F.avg("mem_used_percent").alias("avg_mem"),
        F.max(cpu).alias("max_cpu"), F.max("mem_used_percent").alias("max_mem"),
        share("cpu_wait_percent", 20).alias("pct_time_high_cpu_wait"),
        share("mem_swap_percent", 25).alias("pct_time_high_mem_swap"),
        F.min(F.try_element_at("disk_free_bytes_per_mount_point", F.lit("/local_disk0")))
        .alias("min_local_disk_free_bytes"),
        F.sum(F.col("network_sent_bytes") + F.col("network_received_bytes")).alias("network_bytes"),
    )


def job_runs_month(runs: DataFrame, start: str, end: str) -> DataFrame:
    seconds = F.timestamp_diff("SECOND", F.col("period_start_time"), F.col("period_end_time"))
    return runs.where(_in_window("period_start_time", start, end)).groupBy(
        "job_id", _month("period_start_time")
    ).agg(
        F.count("*").alias("run_count"),
        F.count_if(F.col("result_state").isin("ERROR", "FAILED", "TIMED_OUT")).alias("failed_runs"),
        F.avg(seconds).alias("avg_run_seconds"),
    )


def job_meta(jobs: DataFrame) -> DataFrame:
    return latest_by_key(jobs, ["job_id"], "change_time", ["run_as_user_name"])


def cluster_meta(clusters: DataFrame) -> DataFrame:
    flat = clusters.select(
        "cluster_id", "cluster_name", "owned_by", "min_autoscale_workers", "max_autoscale_workers",
        "auto_termination_minutes", "worker_node_type",
        F.coalesce("aws_attributes.availability", "azure_attributes.availability").alias("availability"),
        "policy_id", F.size("tags").alias("tag_count"), "change_time")
    return latest_by_key(flat, ["cluster_id"], "change_time",
                         [c for c in flat.columns if c not in ("cluster_id", "change_time")])


def warehouse_meta(warehouses: DataFrame) -> DataFrame:
    flat = warehouses.withColumn("tag_count", F.size("tags"))
    return latest_by_key(flat, ["warehouse_id"], "change_time",
                         ["warehouse_name", "warehouse_type", "tag_count", "auto_stop_minutes"])


_CUBE_KEYS = ("product", "job_id", "run_as", "cluster_id", "warehouse_id", "notebook_id", "project", "charge_month")


def usage_cube(priced: DataFrame) -> DataFrame:
    """Priced usage aggregated once to (product, job, runner, cluster, warehouse, notebook, project, month), stored.

    Every efficiency branch is a roll-up of it, so usage is scanned and priced once for all of them. Besides the
    sums a cell keeps its row count, its greatest row cost and its heaviest row's job name, so that a branch's
    "heaviest row" picks equal those over the rows themselves.
    """
    from tallyspark.sinks.files import stored

    cube = priced.groupBy(*_CUBE_KEYS).agg(
        F.sum("cost").alias("cost"), F.sum("jobs_priced_cost").alias("jobs_priced_cost"),
        F.sum("usage_quantity").alias("usage_quantity"), F.bool_or("photon").alias("photon"),
        F.count(F.lit(1)).alias("_rows"), F.max("cost").alias("_max_cost"),
        F.max(F.struct("cost", "job_name")).alias("_top_name"), F.max("job_name").alias("job_name"),
        F.max("notebook_path").alias("notebook_path"))
    return stored(cube, "usage-cube")


def _heaviest(value: str) -> Column:
    """The value of a cube key on its heaviest row; equal costs go to the greatest value, as `top_by`."""
    return F.max(F.struct("_max_cost", value))[value]


def interactive_job_slice(cube: DataFrame) -> DataFrame:
    """Job-shaped cost that ran on shared clusters, with the heaviest job of each cluster."""
    return (
        cube.where((F.col("product") == "ALL_PURPOSE") & F.col("job_id").isNotNull())
        .groupBy("cluster_id", "charge_month")
        .agg(F.sum("cost").alias("job_shaped_cost"),
             F.sum("jobs_priced_cost").alias("job_shaped_jobs_priced_cost"),
             _heaviest("job_id").alias("top_job_id"),
             F.max("_top_name")["job_name"].alias("top_job_name"),
             _heaviest("run_as").alias("top_job_owner"))
    )


def _warehouse_queries(history: DataFrame, start: str, end: str) -> DataFrame:
    return history.where(
        _in_window("start_time", start, end) & F.col("compute.warehouse_id").isNotNull()
    ).withColumn("warehouse_id", F.col("compute.warehouse_id"))


def warehouse_query_stats(history: DataFrame, start: str, end: str) -> DataFrame:
    return _warehouse_queries(history, start, end).groupBy("warehouse_id", _month("start_time")).agg(
        F.count("*").alias("query_count"),
        (100 * ratio(F.count_if("from_result_cache"), F.count("*"))).alias("cache_hit_pct"),
        F.count_if(F.col("spilled_local_bytes") > 0).alias("spill_query_count"),
        F.sum("spilled_local_bytes").alias("spilled_bytes"),
        F.sum("shuffle_read_bytes").alias("shuffle_bytes"),
    )


def warehouse_query_users(history: DataFrame, start: str, end: str) -> DataFrame:
    """Per-user duration with the warehouse's total beside it, and the mean gap between queries."""
    users = (
        _warehouse_queries(history, start, end).where(F.col("executed_by").isNotNull())
        .groupBy("warehouse_id", "executed_by", _month("start_time"))
        .agg(F.count("*").alias("query_count"), F.sum("total_duration_ms").alias("user_duration_ms"),
             F.timestamp_diff("MINUTE", F.min("start_time"), F.max("start_time")).alias("_minutes"))
    )
    whole = Window.partitionBy("warehouse_id", "charge_month")
    return users.select(
        "warehouse_id", "executed_by", "charge_month", "query_count", "user_duration_ms",
        F.sum("user_duration_ms").over(whole).alias("warehouse_duration_ms"),
        F.when(F.col("query_count") > 1, ratio(F.col("_minutes"), F.col("query_count") - 1))
        .alias("avg_interval_minutes"),
    )


def _with_utilization(rolled: DataFrame, util: DataFrame) -> DataFrame:
    """Attach cluster telemetry to usage already rolled up per cluster, keeping usage-row weights."""
    return rolled.join(util, ["cluster_id", "charge_month"], "left").withColumn(
        "_level", F.greatest("avg_cpu", "avg_mem"))


def _util_measures() -> list[Column]:
    weight = F.when(F.col("_level").isNotNull(), F.col("_rows"))
    mean = ratio(F.sum(F.col("_level") * F.col("_rows")), F.sum(weight))
    return [
        F.when(mean.isNotNull(), F.least(F.lit(100.0), mean)).alias("utilization_pct"),
        F.max("max_cpu").alias("max_cpu_pct"), F.max("max_mem").alias("max_mem_pct"),
        F.max("pct_time_high_cpu_wait").alias("pct_time_high_cpu_wait"),
        F.max("pct_time_high_mem_swap").alias("pct_time_high_mem_swap"),
        F.min("min_local_disk_free_bytes").alias("min_local_disk_free_bytes"),
        F.max("network_bytes").alias("network_bytes"),
    ]


def _usage_sums() -> list[Column]:
    """Sums of usage cube cells."""
    return [F.sum("cost").alias("billed_cost"), F.sum("usage_quantity").alias("native_quantity"),
            F.bool_or("photon").alias("photon")]


def efficiency_job(
    cube: DataFrame, util: DataFrame, runs: DataFrame, jobs: DataFrame, clusters: DataFrame,
    node_types: DataFrame,
) -> DataFrame:
    """Cost and health per job, runner and month."""
    rolled = (
        cube.where((F.col("product") == "JOBS") & F.col("job_id").isNotNull())
        .groupBy("job_id", "run_as", "cluster_id", "charge_month")
        .agg(*_usage_sums(), F.max("job_name").alias("job_name"), F.max("project").alias("project"),
             F.sum("_rows").alias("_rows"))
    )
    machines = cluster_meta(clusters).select("cluster_id", "worker_node_type", "policy_id", "tag_count").join(
        node_types.withColumnRenamed("node_type", "worker_node_type"), "worker_node_type", "left")
    jobs_grain = (
        _with_utilization(rolled, util).join(machines, "cluster_id", "left")
        .groupBy("job_id", "run_as", "charge_month")
        .agg(*[F.sum(c).alias(c) for c in ("billed_cost", "native_quantity")],
             F.bool_or("photon").alias("photon"),
             *[F.max(c).alias(c) for c in ("job_name", "project", "worker_node_type", "core_count",
                                           "policy_id", "tag_count")],
             *_util_measures())
    )
    failed = F.when(F.col("run_count") > 0, ratio(F.col("failed_runs"), F.col("run_count"))).otherwise(0.0)
    return (
        jobs_grain.join(runs, ["job_id", "charge_month"], "left").join(job_meta(jobs), "job_id", "left")
        .select(
            F.lit("job").alias("entity_type"), F.col("job_id").alias("entity_id"),
            F.coalesce("job_name", "job_id").alias("entity_name"),
            F.coalesce("run_as_user_name", "run_as").alias("owner_user"),
            F.col("project").alias("owner_project"), "charge_month", "billed_cost", "native_quantity",
            "utilization_pct", F.col("run_count").alias("activity_count"), "run_count",
            (F.col("billed_cost") * failed).alias("failed_cost"), "photon", "worker_node_type",
            "core_count", "max_cpu_pct", "max_mem_pct", "pct_time_high_cpu_wait",
            "pct_time_high_mem_swap", "min_local_disk_free_bytes", "network_bytes",
            "avg_run_seconds", "policy_id", "tag_count",
        )
    )


def efficiency_interactive(
    cube: DataFrame, util: DataFrame, clusters: DataFrame, node_types: DataFrame, jobs: DataFrame
) -> DataFrame:
    """Cost and health per shared cluster; its owner, else its heaviest spender."""
    rolled = (
        cube.where((F.col("product") == "ALL_PURPOSE") & F.col("cluster_id").isNotNull())
        .groupBy("cluster_id", "charge_month")
        .agg(*_usage_sums(), _heaviest("run_as").alias("_spender"),
             _heaviest("project").alias("owner_project"), F.sum("_rows").alias("_rows"))
    )
    machines = cluster_meta(clusters).join(
        node_types.withColumnRenamed("node_type", "worker_node_type"), "worker_node_type", "left")
    top_owner = job_meta(jobs).select(F.col("job_id").alias("top_job_id"),
                                      F.col("run_as_user_name").alias("_job_owner"))
    level = F.col("_level")
    return (
        _with_utilization(rolled, util).join(machines, "cluster_id", "left")
        .join(interactive_job_slice(cube), ["cluster_id", "charge_month"], "left")
        .join(top_owner, "top_job_id", "left")
        .select(
            F.lit("interactive").alias("entity_type"), F.col("cluster_id").alias("entity_id"),
            F.coalesce("cluster_name", "cluster_id").alias("entity_name"),
            F.coalesce("owned_by", "_spender").alias("owner_user"), "owner_project", "charge_month",
            "billed_cost", "native_quantity",
            F.when(level.isNotNull(), F.least(F.lit(100.0), level)).alias("utilization_pct"),
            "photon", "min_autoscale_workers", "max_autoscale_workers", "auto_termination_minutes",
            "worker_node_type", "core_count", "availability", F.col("max_cpu").alias("max_cpu_pct"),
            F.col("max_mem").alias("max_mem_pct"), "job_shaped_cost", "top_job_name",
            F.coalesce("_job_owner", "top_job_owner").alias("top_job_owner"),
            F.col("job_shaped_jobs_priced_cost").alias("jobs_priced_cost"),
            "pct_time_high_cpu_wait", "pct_time_high_mem_swap", "min_local_disk_free_bytes",
            "network_bytes", "policy_id", "tag_count",
        )
    )


def _warehouse_usage(cube: DataFrame, *keys: str) -> DataFrame:
    return (
        cube.where((F.col("product") == "SQL") & F.col("warehouse_id").isNotNull())
        .groupBy("warehouse_id", *keys, "charge_month")
        .agg(*_usage_sums(), F.max("project").alias("owner_project"))
    )


def efficiency_sql_warehouse(cube: DataFrame, stats: DataFrame, warehouses: DataFrame) -> DataFrame:
    return (
        _warehouse_usage(cube, "run_as").join(warehouse_meta(warehouses), "warehouse_id", "left")
        .join(stats, ["warehouse_id", "charge_month"], "left")
        .select(
            F.lit("sql_warehouse").alias("entity_type"), F.col("warehouse_id").alias("entity_id"),
            F.coalesce("warehouse_name", "warehouse_id").alias("entity_name"),
            F.col("run_as").alias("owner_user"), "owner_project", "charge_month", "billed_cost",
            "native_quantity", "photon", "cache_hit_pct", "query_count", "warehouse_type",
            "spill_query_count", "spilled_bytes", "shuffle_bytes", "tag_count", "auto_stop_minutes",
        )
    )


def efficiency_sql_warehouse_user(cube: DataFrame, users: DataFrame, warehouses: DataFrame) -> DataFrame:
    """Warehouse cost split over its users by query duration."""
    share = ratio(F.col("user_duration_ms"), F.col("warehouse_duration_ms"))
    name = F.coalesce("warehouse_name", "warehouse_id")
    return (
        _warehouse_usage(cube).join(users, ["warehouse_id", "charge_month"])
        .join(warehouse_meta(warehouses), "warehouse_id", "left")
        .select(
            F.lit("sql_warehouse_user").alias("entity_type"),
            F.concat("warehouse_id", F.lit(":"), "executed_by").alias("entity_id"),
            F.concat(name, F.lit(" ("), "executed_by", F.lit(")")).alias("entity_name"),
            F.col("executed_by").alias("owner_user"), "owner_project", "charge_month",
            (F.col("billed_cost") * share).alias("billed_cost"),
            F.col("query_count").alias("activity_count"), F.lit(False).alias("photon"), "query_count",
            "warehouse_type", "avg_interval_minutes", (100 * share).alias("duration_share_pct"),
            "tag_count", "auto_stop_minutes",
        )
    )


def efficiency_notebook(cube: DataFrame) -> DataFrame:
    return (
        cube.where(F.col("product").isin("INTERACTIVE", "NOTEBOOKS") & F.col("notebook_id").isNotNull())
        .groupBy("notebook_id", "run_as", "charge_month")
        .agg(*_usage_sums(), F.max("notebook_path").alias("_path"), F.max("project").alias("owner_project"),
             F.sum("jobs_priced_cost").alias("jobs_priced_cost"))
        .select(
            F.lit("notebook").alias("entity_type"), F.col("notebook_id").alias("entity_id"),
            F.coalesce("_path", "notebook_id").alias("entity_name"), F.col("run_as").alias("owner_user"),
            "owner_project", "charge_month", "billed_cost", "native_quantity", "photon", "jobs_priced_cost",
        )
    )


_RECORD = ("entity_type", "entity_id", "entity_name", "owner_user", "owner_project", "charge_month",
           "billed_cost", "native_quantity", "utilization_pct", "activity_count")
# Entity kinds a record may carry.
ENTITY_TYPES = ("job", "interactive", "sql_warehouse", "sql_warehouse_user", "notebook", "storage",
                "table", "query_pattern", "endpoint")


def to_efficiency_records(
    entities: DataFrame, provider: str, connector: str, unit: str | None = "DBU"
) -> DataFrame:
    """Typed entity rows as efficiency records: everything that is not identity becomes a JSON cause.

    Absent causes are left out of the JSON.
    """
    causes = [c for c in entities.columns if c not in _RECORD + ("native_unit",)]

    def col(name: str, kind: str) -> Column:
        value = F.col(name) if name in entities.columns else F.lit(None)
        return value.cast(kind).alias(name)

    native = F.col("native_unit") if "native_unit" in entities.columns else F.lit(unit)
    return entities.where(F.col("entity_type").isin(*ENTITY_TYPES)).select(
        *[col(c, "string") for c in _RECORD[:5]],
        F.coalesce(col("billed_cost", "decimal(20,6)"), F.lit(0)).cast("decimal(20,6)").alias("billed_cost"),
        col("native_quantity", "double"), native.cast("string").alias("native_unit"),
        col("utilization_pct", "double"), col("activity_count", "bigint"),
        (F.to_json(F.struct(*causes)) if causes else F.lit("{}")).alias("cause_detail"),
        F.lit(provider).alias("provider_name"), F.lit(connector).alias("x_source_connector"),
        F.date_format("charge_month", "yyyy-MM").alias("charge_month"),
    )


def efficiency_union(parts: list[DataFrame]) -> DataFrame:
    return to_efficiency_records(union_all(parts), "Databricks", "databricks")


# --- model serving --------------------------------------------------------------------------------
_SERVED_PRODUCTS = ("MODEL_SERVING", "AI_GATEWAY", "AI_FUNCTIONS", "VECTOR_SEARCH")


def endpoint_cost_month(usage: DataFrame, prices: DataFrame, start: str, end: str) -> DataFrame:
    rows = usage.where(
        F.col("usage_date").between(start, end)
        & F.col("billing_origin_product").isin(*_SERVED_PRODUCTS)
        & F.col("usage_metadata.endpoint_id").isNotNull())
    priced = _valid_price(rows, _index(price_windows(prices)), "sku_name", "_price")
    return priced.groupBy(F.col("usage_metadata.endpoint_id").alias("endpoint_id"), _month("usage_date")).agg(
        F.sum("usage_quantity").alias("dbu_quantity"),
        F.sum(F.col("usage_quantity") * F.coalesce("_price", F.lit(0.0))).alias("billed_cost"),
        F.max(F.size("custom_tags")).alias("tag_count"),
    )


def served_entities(served: DataFrame) -> DataFrame:
    flat = served.select(
        "served_entity_id", "endpoint_id", "endpoint_name", "entity_type", "entity_name", "entity_version",
        F.coalesce("custom_model_config.compute_type", "feature_spec_config.compute_type").alias("workload_type"),
        F.col("foundation_model_config.min_provisioned_throughput").cast("double").alias("min_provisioned_throughput"),
        F.col("foundation_model_config.max_provisioned_throughput").cast("double").alias("max_provisioned_throughput"),
        "change_time")
    return latest_by_key(flat, ["served_entity_id"], "change_time",
                         [c for c in flat.columns if c not in ("served_entity_id", "change_time")])


def endpoint_requests_month(requests: DataFrame, start: str, end: str) -> DataFrame:
    tokens_in = F.coalesce("input_token_count", F.lit(0))
    tokens_out = F.coalesce("output_token_count", F.lit(0))
    bad = F.col("status_code") >= 400
    return requests.where(_in_window("request_time", start, end)).groupBy(
        "served_entity_id", "requester",
        F.try_element_at("usage_context", F.lit("project")).alias("usage_context_project"),
        _month("request_time"),
    ).agg(
        F.count("*").alias("request_count"), F.sum(tokens_in).alias("input_tokens"),
        F.sum(tokens_out).alias("output_tokens"), F.count_if(bad).alias("error_request_count"),
        F.sum(F.when(bad, tokens_in).otherwise(0)).alias("error_input_tokens"),
        F.sum(F.when(bad, tokens_out).otherwise(0)).alias("error_output_tokens"),
        F.lit(0).cast("bigint").alias("total_duration_ms"),
    )


def ai_usage_rows(requests: DataFrame, served: DataFrame | None, cost: DataFrame) -> DataFrame:
    """Requests with what served them and what the endpoint cost.

    Without a served-entity table every row keeps its tokens and an 'unknown' serving mode.
    """
    if served is None:
        served = requests.sparkSession.createDataFrame(
            [], "served_entity_id string, endpoint_id string, endpoint_name string, entity_type string, "
                "entity_name string, entity_version string, workload_type string, "
                "min_provisioned_throughput double, max_provisioned_throughput double")
    kind = F.col("entity_type")
    mode = (
        F.when(F.col("min_provisioned_throughput") > 0, "provisioned_throughput")
        .when(kind == "EXTERNAL_MODEL", "external").when(kind == "FOUNDATION_MODEL", "pay_per_token")
        .when(kind.isin("CUSTOM_MODEL", "FEATURE_SPEC"), "provisioned_compute").otherwise("unknown")
    )
    cost = cost.select("endpoint_id", "charge_month", F.col("billed_cost").alias("endpoint_billed_cost"),
                       F.col("dbu_quantity").alias("endpoint_dbu_quantity"),
                       F.col("tag_count").alias("endpoint_tag_count"))
    joined = requests.join(served, "served_entity_id", "left").withColumn(
        "endpoint_id", F.coalesce("endpoint_id", "served_entity_id"))
    return joined.join(cost, ["endpoint_id", "charge_month"], "left").select(
        "endpoint_id", "endpoint_name", "served_entity_id", F.col("entity_name").alias("model_name"),
        F.col("entity_version").alias("model_version"), kind.alias("model_kind"), mode.alias("serving_mode"),
        "requester", "usage_context_project", F.lit(None).cast("boolean").alias("scale_to_zero_enabled"),
        F.lit(None).cast("string").alias("workload_size"), "workload_type", "min_provisioned_throughput",
        "max_provisioned_throughput", "charge_month", "request_count", "error_request_count",
        "input_tokens", "output_tokens", "error_input_tokens", "error_output_tokens", "total_duration_ms",
        "endpoint_billed_cost", "endpoint_dbu_quantity", "endpoint_tag_count",
    )


def endpoint_efficiency(rows: DataFrame) -> DataFrame:
    """AI usage folded to endpoint-months: counts add up, fanned-out endpoint facts are taken once."""
    facts = ("endpoint_name", "serving_mode", "scale_to_zero_enabled", "workload_type", "workload_size")
    folded = rows.groupBy("endpoint_id", "charge_month").agg(
        *[F.max(c).alias(c) for c in facts],
        F.sum("request_count").alias("request_count"),
        F.sum("error_request_count").alias("error_request_count"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum(F.col("error_input_tokens") + F.col("error_output_tokens")).alias("error_tokens"),
        F.coalesce(F.max("endpoint_billed_cost"), F.lit(0.0)).alias("billed_cost"),
        F.coalesce(F.max("endpoint_dbu_quantity"), F.lit(0.0)).alias("_dbu"),
        F.max("endpoint_tag_count").alias("tag_count"), F.countDistinct("model_name").alias("model_count"),
    )
    total = F.col("input_tokens") + F.col("output_tokens")
    return folded.select(
        F.lit("endpoint").alias("entity_type"), F.col("endpoint_id").alias("entity_id"),
        F.col("endpoint_name").alias("entity_name"), "charge_month", "billed_cost",
        F.nullif("_dbu", F.lit(0.0)).alias("native_quantity"), F.col("request_count").alias("activity_count"),
        "serving_mode", "input_tokens", "output_tokens", total.alias("total_tokens"), "error_tokens",
        "request_count", "error_request_count", "model_count", "scale_to_zero_enabled", "workload_type",
        "workload_size", "tag_count",
        F.round(100 * ratio(F.col("error_request_count"), F.col("request_count")), 2).alias("error_rate_pct"),
        F.when((F.col("serving_mode") == "pay_per_token") & (total > 0) & (F.col("billed_cost") != 0),
               F.round(F.col("billed_cost") * F.col("error_tokens") / total, 2)).alias("failed_cost"),
    )


def delta_table_inventory(detail: DataFrame, as_of_month: str, n: int | None = None) -> DataFrame:
    """The n largest tables of the current snapshot; codec and file count are what can be acted on."""
    largest = top_rows(detail.where(F.col("table_type") != "VIEW"), n,
                       F.col("size_in_bytes").desc(), F.col("table_name"))
    return largest.select(
        F.lit("table").alias("entity_type"), F.col("table_name").alias("entity_id"),
        F.col("table_name").alias("entity_name"), F.lit(as_of_month).cast("date").alias("charge_month"),
        F.col("size_in_bytes").cast("double").alias("native_quantity"), F.lit("bytes").alias("native_unit"),
        "num_files", F.col("codec").alias("compression_codec"),
    )


def compute_instance_month(
    nodes: DataFrame, clusters: DataFrame, jobs: DataFrame, start: str, end: str
) -> DataFrame:
    """Which cluster ran on which instance each month, and who owns it.

    Node samples collapse to (cluster, instance, month) before the names are looked up.
    """
    seen = nodes.where(_in_window("start_time", start, end)).groupBy(
        "cluster_id", "instance_id", _month("start_time")
    ).agg(F.bool_or("driver").alias("is_driver"), F.min("node_type").alias("node_type"))
    names = cluster_meta(clusters).select(
        "cluster_id", "cluster_name", "owned_by",
        F.nullif(F.regexp_extract("cluster_name", "^job-([0-9]+)-run-", 1), F.lit("")).alias("job_id"))
    return (
        seen.join(names, "cluster_id", "left").join(job_meta(jobs), "job_id", "left")
        .select(F.lit("Databricks").alias("provider_name"), "charge_month", "cluster_id", "cluster_name",
                F.coalesce("run_as_user_name", "owned_by").alias("owner_user"), "instance_id",
                "is_driver", "node_type")
    )


def driver_health_month(history: DataFrame, start: str, end: str) -> DataFrame:
    return history.where(_in_window("start_time", start, end)).groupBy(
        F.lit("Databricks").alias("provider_name"), _month("start_time"), "client_driver",
        "client_application", "executed_by",
    ).agg(F.count("*").alias("query_count"))
