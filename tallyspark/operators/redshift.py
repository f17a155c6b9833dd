"""Warehouse system-log telemetry to efficiency records, observability facts and driver health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.labels import REDSHIFT_SERVICES, S3_SERVICE, driver_support_status
from tallyspark.operators.frame import (
    broadcast_single, exact_percentiles, max_by_present, month_start, ratio, top_rows,
)

_GB = 1024.0**3
# Scan targets that are not tables.
_PSEUDO_TABLES = ("Internal Worktable", "S3", "Runtime Filter")


def _within(c: str, start: str, end: str) -> Column:
    return (F.col(c) >= F.lit(start).cast("timestamp")) & (
        F.col(c) < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp"))


def _blank_null(c: str) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _month_of(c: str) -> Column:
    return month_start(F.to_date(c)).alias("charge_month")


def driver_health_month(connections: DataFrame, start: str, end: str) -> DataFrame:
    return connections.where(
        (F.col("event") == "initiating session") & _within("recordtime", start, end)
    ).groupBy(
        F.lit("AWS").alias("provider_name"), _month_of("recordtime"),
        _blank_null("driver_version").alias("client_driver"),
        _blank_null("application_name").alias("client_application"),
        _blank_null("username").alias("executed_by"),
    ).agg(F.count("*").alias("query_count"))


def snowflake_driver_health(queries: DataFrame, sessions: DataFrame, start: str, end: str) -> DataFrame:
    """Queries per client and user, with the client's support status.

    Queries are counted per session before the join, so the fact side shrinks first.
    """
    per_session = queries.where(_within("start_time", start, end)).groupBy(
        "session_id", "user_name", _month_of("start_time")).agg(F.count("*").alias("_n"))
    known = sessions.where(F.col("client_application_id").isNotNull()).select(
        "session_id", "client_application_id")
    return (
        per_session.join(known, "session_id")
        .groupBy(F.lit("Snowflake").alias("provider_name"), "charge_month",
                 F.col("client_application_id").alias("client_driver"),
                 F.lit(None).cast("string").alias("client_application"),
                 F.col("user_name").alias("executed_by"))
        .agg(F.sum("_n").alias("query_count"))
        .withColumn("support_status", driver_support_status(F.col("client_driver")))
    )


def _user_queries(queries: DataFrame, start: str, end: str) -> DataFrame:
    return queries.where(_within("starttime", start, end) & (F.col("userid") > 1))


def cluster_activity(
    queries: DataFrame, summary: DataFrame, wlm: DataFrame, scaling: DataFrame, start: str, end: str
) -> DataFrame:
    """One row: query counts, spills, queue waits and scaling seconds of the window."""
    q = _user_queries(queries, start, end).select("query")
    waits = wlm.where(_within("queue_start_time", start, end)).join(q, "query", "left_semi")
    spilled = summary.where(F.col("is_diskbased") == "t").select("query").distinct().join(q, "query", "left_semi")
    seconds = F.timestamp_diff("SECOND", F.col("start_time"), F.col("end_time"))
    pieces = [
        q.agg(F.count("*").alias("query_count")),
        exact_percentiles(waits, [], "total_queue_time",
                          {"wlm_queue_wait_us_p95": 0.95, "wlm_queue_wait_us_p99": 0.99}),
        waits.agg(ratio(F.avg("total_queue_time"), F.nullif(F.avg("total_exec_time"), F.lit(0.0)))
                  .alias("wlm_wait_to_exec_ratio")),
        spilled.agg(F.count("*").alias("disk_spill_query_count")),
        scaling.where(_within("start_time", start, end)).agg(
            F.coalesce(F.sum(seconds), F.lit(0)).alias("concurrency_scaling_active_seconds")),
        queries.agg(F.min("starttime").alias("earliest_retained_query_ts")),
    ]
    out = pieces[0]
    for piece in pieces[1:]:
        out = out.crossJoin(broadcast_single(piece))
    return out


def measurable_window(activity: DataFrame, start: str, end: str, min_detail_days: int = 14) -> DataFrame:
    """How far log retention covers the window; what the logs cannot know is NULL, not zero."""
    earliest = F.to_date("earliest_retained_query_ts")
    lost = earliest.isNull() | (earliest > F.lit(end).cast("date"))
    partial = ~lost & (earliest > F.lit(start).cast("date"))

    def known(c: str, kind: str) -> Column:
        return F.when(~lost, F.col(c)).cast(kind).alias(c)

    days = F.when(partial, F.date_diff(F.lit(end).cast("date"), earliest) + 1)
    return activity.select(
        known("query_count", "bigint"),
        F.when(~lost, F.col("wlm_queue_wait_us_p95") / 1000.0).alias("wlm_queue_wait_ms_p95"),
        F.when(~lost, F.col("wlm_queue_wait_us_p99") / 1000.0).alias("wlm_queue_wait_ms_p99"),
        known("wlm_wait_to_exec_ratio", "double"), known("disk_spill_query_count", "bigint"),
        known("concurrency_scaling_active_seconds", "double"),
        F.when(partial, earliest.cast("string")).alias("activity_measured_since"),
        lost.alias("activity_window_unmeasurable"),
        F.when(lost, "unmeasurable").when(partial, "partial").otherwise("full").alias("coverage"),
        (~lost & (days.isNull() | (days >= min_detail_days))).alias("detail_measurable"),
    )


def retention_ledger(logs: dict[str, tuple[DataFrame, str]], start: str, end: str, days: int = 7) -> DataFrame:
    """What each system log still holds of a window, and what all of them hold together (table '*').

    Per log: covered_from / covered_to, the days of its earliest and latest record (null without records).
    Every row: the window's days, capped_from (the first day that logs kept `days` days can reach, at most the
    window's start), effective_from / effective_to (window and coverage intersected; null if they do not meet),
    truncated (coverage starts after the window does, or does not meet it) and complete (the window is covered whole).
    '*' intersects all logs; one log without records leaves it uncovered.
    """
    per_log = [
        frame.agg(F.lit(name).alias("log_table"), F.to_date(F.min(column)).alias("covered_from"), F.to_date(F.max(column)).alias("covered_to"))
        for name, (frame, column) in logs.items()]
    ledger = per_log[0]
    for part in per_log[1:]:
        ledger = ledger.unionByName(part)
    complete = F.count("covered_from") == F.count(F.lit(1))
    together = ledger.agg(
        F.lit("*").alias("log_table"), F.when(complete, F.max("covered_from")).alias("covered_from"),
        F.when(complete, F.min("covered_to")).alias("covered_to"))
    rows = ledger.unionByName(together)
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    lo, hi = F.greatest(first, F.col("covered_from")), F.least(last, F.col("covered_to"))
    meets = F.col("covered_from").isNotNull() & (lo <= hi)
    return rows.select(
        "log_table", "covered_from", "covered_to", first.alias("window_from"), last.alias("window_to"),
        F.greatest(first, F.date_sub(last, days - 1)).alias("capped_from"),
        F.when(meets, lo).alias("effective_from"), F.when(meets, hi).alias("effective_to"),
        (~meets | (F.col("covered_from") > first)).alias("truncated"),
        (meets & (lo == first) & (hi == last)).alias("complete"))


def capped_window(start: str, end: str, days: int = 7) -> tuple[str, str]:
    """System logs are kept for a week: never ask for more."""
    import datetime as dt

    floor = dt.date.fromisoformat(end) - dt.timedelta(days=days - 1)
    return max(dt.date.fromisoformat(start), floor).isoformat(), end


def query_patterns(
    queries: DataFrame, wlm: DataFrame, report: DataFrame, users: DataFrame, start: str, end: str,
    min_seconds: int = 0, top_n: int | None = None, prefix: int | None = None,
    context_header: tuple[int, str, int] | None = None,
) -> DataFrame:
    """Query shapes with their spill and skew distribution, the heaviest *top_n* if that is given.

    A shape is the whole text, or its first *prefix* characters. With *context_header* (user, header,
    first character of the body) that user's queries with the header are keyed on the text after it.
    With *top_n* the shapes are chosen first and only their queries reach the detail tables.
    """
    text = F.col("querytxt")
    shape = text if prefix is None else F.substring(text, 1, prefix)
    if context_header is not None:
        header_user, header, body_at = context_header
        body = F.substr(text, F.lit(body_at)) if prefix is None else F.substring(text, body_at, prefix)
        shape = F.when((F.col("userid") == header_user) & text.startswith(header), body).otherwise(shape)
    seconds = F.timestamp_diff("SECOND", F.col("starttime"), F.col("endtime"))
    base = (
        _user_queries(queries, start, end).withColumn("_seconds", seconds)
        .where(F.col("_seconds") >= min_seconds)
        .withColumn("qry_md5", F.md5(F.trim(shape)))
    )
    patterns = base.groupBy("qry_md5").agg(
        F.count("*").alias("run_count"), F.sum("_seconds").alias("_total"),
        F.max_by(F.struct(F.col("query").alias("sample_query_id"), F.col("starttime").alias("last_seen_at"),
                          F.trim("querytxt").alias("sample_query_text"), "userid"),
                 F.struct("starttime", "query")).alias("_sample"))
    top = top_rows(patterns, top_n, F.col("_total").desc(), F.col("qry_md5"))
    candidates = base.select("query", "userid", "qry_md5").join(top.select("qry_md5"), "qry_md5", "left_semi")
    on_disk = F.col("is_diskbased") == "t"
    spill = report.join(candidates.select("query"), "query", "left_semi").groupBy("query").agg(
        F.max(on_disk.cast("double")).alias("_spilled"),
        F.sum(F.when(on_disk, F.col("bytes")).otherwise(0)).alias("_spill"),
        F.sum("workmem").alias("_workmem"), F.max("rows_out").alias("_most"), F.min("rows_out").alias("_least"),
        F.sum("rows_out").alias("_rows"), F.count("rows_out").alias("_slices"))
    waits = wlm.select("query", "total_exec_time", "total_queue_time")
    skew = F.when(F.col("_rows") > 0,
                  ratio((F.col("_most") - F.col("_least")) * F.col("_slices"), F.col("_rows"))).otherwise(0.0)

    def mean(c: str, scale: float) -> Column:
        return F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))) / scale

    runs = candidates.join(waits, "query", "left").join(spill, "query", "left").groupBy("qry_md5").agg(
        mean("total_exec_time", 60e6).alias("avg_exec_min"), mean("total_queue_time", 60e6).alias("avg_queue_min"),
        mean("_spilled", 1).alias("pct_runs_spilling"), mean("_spill", _GB).alias("avg_disk_spill_gb"),
        mean("_workmem", _GB).alias("avg_workmem_gb"), F.avg(skew).alias("avg_skew_ratio"),
        F.max(skew).alias("max_skew_ratio"), mean("_slices", 1).alias("avg_slices_in_use"))
    names = users.select(F.col("usesysid").alias("userid"), "usename")
    heaviest = (
        candidates.groupBy("qry_md5", "userid").agg(F.count("*").alias("_n")).join(names, "userid")
        .groupBy("qry_md5", "usename").agg(F.sum("_n").alias("_n"))
        .groupBy("qry_md5").agg(max_by_present(F.col("usename"), F.col("_n")).alias("top_user")))
    return (
        runs.join(top, "qry_md5").join(heaviest, "qry_md5", "left").select("*", "_sample.*")
        .join(names, "userid", "left")
        .select(
            "qry_md5", "sample_query_id", "last_seen_at", "sample_query_text",
            F.col("usename").alias("sample_query_owner"), "run_count",
            (F.col("_total") / 60.0).alias("total_run_min"), "avg_exec_min", "avg_queue_min",
            "pct_runs_spilling", "avg_disk_spill_gb", "avg_workmem_gb", "avg_skew_ratio", "max_skew_ratio",
            "avg_slices_in_use", "top_user")
    )


def pattern_records(patterns: DataFrame, cluster: str, month: str) -> DataFrame:
    owner = F.coalesce("sample_query_owner", "top_user")
    return patterns.select(
        F.lit("query_pattern").alias("entity_type"),
        F.concat(F.lit(cluster + ":"), "qry_md5").alias("entity_id"),
        F.coalesce(F.concat(F.lit("Query "), F.col("sample_query_id").cast("string")),
                   F.concat(F.lit("Query pattern "), F.substring("qry_md5", 1, 12))).alias("entity_name"),
        owner.alias("owner_user"), F.lit(month).cast("date").alias("charge_month"),
        F.col("run_count").alias("activity_count"), owner.alias("query_owner"),
        *[c for c in patterns.columns if c not in ("qry_md5", "sample_query_owner", "top_user")])


def user_activity(
    queries: DataFrame, metrics: DataFrame, report: DataFrame, users: DataFrame, start: str, end: str,
    compute_cost: float, top_n: int | None = None,
) -> DataFrame:
    """Heaviest users with their share of all execution time; the total is taken before the cut."""
    q = _user_queries(queries, start, end).select("query", "userid")
    key = ["query", "userid"]
    spill = report.join(q, key, "left_semi").groupBy(*key).agg(
        (F.sum(F.when(F.col("is_diskbased") == "t", F.col("bytes")).otherwise(0)) / _GB).alias("_spill"))
    sums = {
        "exec_microseconds": "query_execution_time", "queue_microseconds": "query_queue_time",
        "cpu_microseconds": "query_cpu_time", "blocks_read": "query_blocks_read",
        "temp_blocks_to_disk": "query_temp_blocks_to_disk", "scan_rows": "scan_row_count",
        "spectrum_scan_rows": "spectrum_scan_row_count", "spectrum_scan_mb": "spectrum_scan_size_mb"}
    per_user = (
        q.join(metrics, key).join(spill, key, "left").groupBy("userid")
        .agg(F.countDistinct("query").alias("query_count"),
             *[F.sum(src).alias(name) for name, src in sums.items()],
             F.sum(F.coalesce("_spill", F.lit(0.0))).alias("spill_gb"))
    )
    named = per_user.join(users.withColumnRenamed("usesysid", "userid"), "userid").groupBy(
        F.col("usename").alias("username")).agg(
        *[F.sum(c).alias(c) for c in ("query_count", *sums, "spill_gb")])
    total = broadcast_single(named.agg(F.sum("exec_microseconds").alias("total_exec_microseconds")))
    top = top_rows(named, top_n, F.col("exec_microseconds").desc(), F.col("username"))
    share = ratio(F.col("exec_microseconds"), F.nullif("total_exec_microseconds", F.lit(0)))
    return top.crossJoin(total).select(
        "*", (100 * share).alias("duration_share_pct"),
        F.coalesce(share * compute_cost, F.lit(0.0)).alias("billed_cost"))


def spectrum_table_usage(scans: DataFrame, start: str, end: str) -> DataFrame:
    """Scanned and returned data per external table.

    Distinct queries are counted by aggregating to (table, query) first, which spreads a hot table.
    """
    per_query = scans.where(_within("starttime", start, end)).groupBy("external_table_name", "query").agg(
        F.sum("s3_scanned_bytes").alias("_scanned"), F.sum("s3query_returned_bytes").alias("_returned"))
    return per_query.groupBy("external_table_name").agg(
        F.count("*").alias("scan_count"), (F.sum("_scanned") / _GB).alias("scanned_gb"),
        (F.sum("_returned") / _GB).alias("returned_gb"))


def allocate_spectrum_cost(tables: DataFrame, spectrum_cost: float | None, complete: bool) -> DataFrame:
    """Divide the bill by scanned volume, but only when the window was fully observed."""
    usable = complete and spectrum_cost is not None and spectrum_cost > 0
    if not usable:
        empty = F.lit(None)
        return tables.select("*", empty.cast("double").alias("spectrum_allocated_cost"),
                             empty.cast("double").alias("spectrum_allocation_pct"),
                             empty.cast("string").alias("spectrum_allocation_status"))
    total = broadcast_single(tables.agg(
        F.sum(F.when(F.col("scanned_gb") > 0, F.col("scanned_gb"))).alias("_total")))
    share = F.when(F.col("scanned_gb") > 0, ratio(F.col("scanned_gb"), F.col("_total")))
    return tables.crossJoin(total).select(
        *tables.columns, (share * spectrum_cost).alias("spectrum_allocated_cost"),
        (100 * share).alias("spectrum_allocation_pct"),
        F.when(share.isNotNull(), "allocated").alias("spectrum_allocation_status"))


def _table_scans(scans: DataFrame, start: str, end: str) -> DataFrame:
    return scans.where(
        _within("starttime", start, end) & (F.col("userid") > 1)
        & ~F.col("perm_table_name").isin(*_PSEUDO_TABLES))


def _non_negative(c: str) -> Column:
    return F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))


def table_workload_share(scans: DataFrame, wlm: DataFrame, start: str, end: str) -> DataFrame:
    """Each query's execution time spread over the tables it scanned: by bytes, else rows, else evenly."""
    per_pair = _table_scans(scans, start, end).groupBy("query", F.col("tbl").alias("table_id")).agg(
        F.sum(_non_negative("bytes")).alias("scan_bytes"),
        F.sum(_non_negative("rows_pre_filter")).alias("rows_pre_filter"),
        F.sum(_non_negative("rows_out")).alias("rows_returned"), F.max("starttime").alias("last_access_at"))
    per_query = per_pair.groupBy("query").agg(
        F.sum("scan_bytes").alias("_bytes"), F.sum("rows_pre_filter").alias("_rows"), F.count("*").alias("_tables"))
    weight = (
        F.when(F.col("_bytes") > 0, ratio(F.col("scan_bytes"), F.col("_bytes")))
        .when(F.col("_rows") > 0, ratio(F.col("rows_pre_filter"), F.col("_rows")))
        .otherwise(ratio(F.lit(1), F.col("_tables"))))
    time = F.coalesce(F.col("total_exec_time").cast("double"), F.lit(0.0))
    return (
        per_pair.join(per_query, "query").join(wlm.select("query", "total_exec_time"), "query", "left")
        .groupBy("table_id")
        .agg(F.count("*").alias("query_count"), F.max("last_access_at").alias("last_access_at"),
             F.sum("scan_bytes").alias("scan_bytes"), F.sum("rows_pre_filter").alias("rows_pre_filter"),
             F.sum("rows_returned").alias("rows_returned"),
             (F.sum(time * weight) / 1e6).alias("weighted_exec_seconds"))
    )


def table_inventory_rows(
    tables: DataFrame, workload: DataFrame, owners: DataFrame, as_of: str, cluster: str, month: str,
    top_n: int | None = None,
) -> DataFrame:
    """Largest tables with their workload, owner and idle days."""
    largest = top_rows(tables, top_n, F.col("size_mb").desc_nulls_last(), F.col("table_id"))
    total = broadcast_single(workload.agg(F.sum("weighted_exec_seconds").alias("_total")))
    owned = owners.select(F.col("schemaname").alias("schema_name"), F.col("tablename").alias("table_name"),
                          F.col("tableowner").alias("owner_user"))
    name = F.concat_ws(".", "db_name", "schema_name", "table_name")
    work = F.coalesce("weighted_exec_seconds", F.lit(0.0))
    return (
        largest.join(workload, "table_id", "left").join(owned, ["schema_name", "table_name"], "left").crossJoin(total)
        .select(
            F.lit("table").alias("entity_type"), F.concat(F.lit(cluster + ":"), name).alias("entity_id"),
            name.alias("entity_name"), "owner_user", F.lit(month).cast("date").alias("charge_month"),
            F.col("size_mb").cast("double").alias("native_quantity"), F.lit("MB").alias("native_unit"),
            F.col("query_count").alias("activity_count"), "encoded", "diststyle",
            F.col("unsorted").alias("unsorted_pct"), F.col("stats_off").alias("stats_off_pct"), "tbl_rows",
            F.to_date("last_access_at").alias("last_access_date"),
            F.date_diff(F.lit(as_of).cast("date"), F.to_date("last_access_at")).alias("days_since_last_access"),
            F.col("weighted_exec_seconds").alias("table_weighted_exec_seconds"),
            F.when(F.col("_total") > 0, 100 * ratio(work, F.col("_total"))).alias("table_compute_share_pct"),
            (F.col("scan_bytes") / _GB).alias("table_scan_gb"),
            F.col("rows_pre_filter").alias("table_rows_pre_filter"),
            F.col("rows_returned").alias("table_rows_returned"))
    )


COST_PARTS = ("compute", "concurrency_scaling", "storage", "spectrum_scan")


def cluster_cost_breakdown(bill: DataFrame, start: str, end: str) -> DataFrame:
    """Billed usage-mix cost per cluster, one column per part; parts without cost are NULL.

    The partition column is filtered together with the timestamp, so whole months are skipped.
    """
    cluster = F.regexp_extract("resource_id", ":cluster:([^:]+)$", 1)
    rows = bill.where(
        F.col("service_name").isin(*REDSHIFT_SERVICES) & F.col("resource_id").contains(":cluster:")
        & F.col("charge_month").between(start[:7], end[:7]) & _within("charge_period_start", start, end))
    cost = [F.sum(F.when(F.col("x_cost_subcategory") == p, F.col("effective_cost"))) for p in COST_PARTS]
    return rows.groupBy(cluster.alias("cluster_id")).agg(
        *[F.nullif(c, F.lit(0)).alias(f"{p}_cost") for c, p in zip(cost, COST_PARTS)])


def reserved_coverage(clusters: DataFrame, reservations: DataFrame) -> DataFrame:
    """On-demand and reserved node-hours of a 30-day month, from two inventory snapshots."""
    active = broadcast_single(reservations.agg(
        F.coalesce(F.sum(F.when(F.col("state") == "active", F.col("node_count"))), F.lit(0)).alias("_active")))
    hours = 24 * 30
    return clusters.crossJoin(active).select(
        "cluster_id",
        (F.greatest(F.col("node_count") - F.col("_active"), F.lit(0)) * hours).cast("double").alias("on_demand_node_hours"),
        (F.least("_active", "node_count") * hours).cast("double").alias("reserved_node_hours"))


def capacity_metrics(points: DataFrame, start: str, end: str) -> DataFrame:
    """CPU and disk averages and peaks over the last 14 days of the window."""
    first = F.greatest(F.lit(start).cast("date"), F.date_sub(F.lit(end).cast("date"), 13))
    day = F.to_date("point_time")
    cpu, disk = F.col("metric") == "CPUUtilization", F.col("metric") == "PercentageDiskSpaceUsed"
    return points.where(day.between(first, F.lit(end).cast("date"))).groupBy("cluster_id").agg(
        F.avg(F.when(cpu, F.col("average"))).alias("cpu_avg_pct"),
        F.max(F.when(cpu, F.col("maximum"))).alias("cpu_max_pct"),
        F.avg(F.when(disk, F.col("average"))).alias("disk_avg_pct"),
        F.max(F.when(disk, F.col("maximum"))).alias("disk_max_pct"),
        first.cast("string").alias("measured_since"), F.lit(end).alias("measured_until"))


def redshift_cluster_row(
    activity: DataFrame, cost: DataFrame, reserved: DataFrame, capacity: DataFrame, month: str,
    spectrum_allocated: bool = False, window_capped: bool = False,
) -> DataFrame:
    """One efficiency row per billed cluster from its cost, activity, capacity and reservations."""
    total = None
    for part in COST_PARTS:
        value = F.coalesce(F.col(f"{part}_cost").cast("double"), F.lit(0.0))
        total = value if total is None else total + value
    capped = capacity.select(
        "cluster_id", F.col("cpu_avg_pct").alias("cluster_cpu_utilization_avg_pct"),
        F.col("cpu_max_pct").alias("cluster_cpu_utilization_max_pct"),
        F.col("disk_avg_pct").alias("cluster_disk_space_used_avg_pct"),
        F.col("disk_max_pct").alias("cluster_disk_space_used_max_pct"),
        F.col("measured_since").alias("capacity_metrics_measured_since"),
        F.col("measured_until").alias("capacity_metrics_measured_until"))
    facts = activity.drop("coverage", "detail_measurable")
    joined = (
        cost.join(reserved, "cluster_id", "left").join(capped, "cluster_id", "left")
        .crossJoin(broadcast_single(facts)))
    causes = [c for c in joined.columns if c not in ("cluster_id", "activity_window_unmeasurable", *[
        f"{p}_cost" for p in COST_PARTS])]
    return joined.select(
        F.lit("sql_warehouse").alias("entity_type"), F.col("cluster_id").alias("entity_id"),
        F.col("cluster_id").alias("entity_name"), F.lit(month).cast("date").alias("charge_month"),
        total.alias("billed_cost"), F.col("query_count").alias("activity_count"),
        *[(F.lit(None) if p == "spectrum_scan" and spectrum_allocated else F.col(f"{p}_cost")).cast("double")
          .alias(f"{p}_cost") for p in COST_PARTS if p != "spectrum_scan"],
        (F.lit(None) if spectrum_allocated else F.col("spectrum_scan_cost")).cast("double").alias("spectrum_scan_cost"),
        *causes, F.when(F.col("activity_window_unmeasurable"), True).alias("activity_window_unmeasurable"),
        F.lit(True if window_capped else None).cast("boolean").alias("activity_window_capped"))


def table_usage_daily(scans: DataFrame, start: str, end: str) -> DataFrame:
    """Scan facts per day and table."""
    pairs = _table_scans(scans, start, end).groupBy(
        F.to_date("starttime").alias("snapshot_date"), F.col("tbl").alias("table_id"), "query"
    ).agg(F.count("*").alias("_steps"), F.sum(_non_negative("bytes")).alias("_bytes"),
          F.sum(_non_negative("rows_pre_filter")).alias("_pre"), F.sum(_non_negative("rows_out")).alias("_out"),
          F.min("starttime").alias("_first"), F.max("starttime").alias("_last"))
    return pairs.groupBy("snapshot_date", "table_id").agg(
        F.count("*").alias("query_count"), F.sum("_steps").alias("scan_step_count"),
        F.sum("_bytes").alias("scan_bytes"), F.sum("_pre").alias("rows_pre_filter"),
        F.sum("_out").alias("rows_returned"), F.min("_first").alias("first_scan_at"),
        F.max("_last").alias("last_scan_at"))


def external_query_daily(detail: DataFrame, start: str, end: str) -> DataFrame:
    """Object-store scan facts per day, external table and location."""
    sums = {"total_partitions": "total_partitions", "qualified_partitions": "qualified_partitions",
            "scanned_files": "scanned_files", "source_rows": "returned_rows", "source_bytes": "returned_bytes",
            "s3_listing_milliseconds": "s3list_time", "partition_catalog_milliseconds": "get_partition_time"}
    keys = ["usage_date", "source_type", "external_table", "file_location", "file_format"]
    per_query = detail.where(_within("start_time", start, end) & (F.col("source_type") == "S3")).groupBy(
        F.to_date("start_time").alias("usage_date"), "source_type",
        _blank_null("table_name").alias("external_table"), _blank_null("file_location").alias("file_location"),
        _blank_null("file_format").alias("file_format"), "query_id",
    ).agg(F.count("*").alias("_segments"), F.sum(F.coalesce("duration", F.lit(0))).alias("_us"),
          *[F.sum(F.coalesce(src, F.lit(0))).alias(name) for name, src in sums.items()])
    return per_query.groupBy(*keys).agg(
        F.count("*").alias("query_count"), F.sum("_segments").alias("segment_count"),
        (F.sum("_us") / 1e6).alias("duration_seconds"), *[F.sum(c).alias(c) for c in sums])


def external_table_catalog(tables: DataFrame, snapshot_at: Column | None = None) -> DataFrame:
    return tables.select(
        (F.current_timestamp() if snapshot_at is None else snapshot_at).alias("snapshot_at"),
        "redshift_database_name", F.col("schemaname").alias("external_schema"),
        F.col("tablename").alias("external_table"), "tabletype", F.col("location").alias("table_location"),
        "input_format", "output_format", "serialization_lib", "compressed",
        F.col("parameters").alias("table_parameters"))


def s3_tiering_signal(bill: DataFrame, start: str, end: str) -> DataFrame:
    """Storage buckets with positive cost, and whether any of their charges mentions tiering."""
    text = F.lower(F.concat_ws(" ", F.coalesce("charge_description", F.lit("")), F.coalesce("sku_id", F.lit(""))))
    tiered = text.contains("intelligent-tiering") | text.contains("intelligent tiering")
    return (
        bill.where((F.col("service_name") == S3_SERVICE) & F.col("resource_id").isNotNull()
                   & F.col("charge_month").between(start[:7], end[:7])
                   & _within("charge_period_start", start, end))
        .groupBy("resource_id", _month_of("charge_period_start"))
        .agg(F.min("resource_name").alias("entity_name"), F.sum("billed_cost").alias("billed_cost"),
             F.bool_or(tiered).alias("_tiered"))
        .where(F.col("billed_cost") > 0)
        .select(F.lit("storage").alias("entity_type"), F.col("resource_id").alias("entity_id"), "entity_name",
                "charge_month", "billed_cost",
                F.when(F.col("_tiered"), "intelligent_tiering").otherwise("standard").alias("storage_class"))
    )


def policy_config_snapshot(clusters: DataFrame, parameters: DataFrame, month: str) -> DataFrame:
    """Control-plane settings per cluster; an absent parameter is unknown, not false."""
    ssl = parameters.where(F.col("parameter_name") == "require_ssl").groupBy("parameter_group").agg(
        F.max(F.lower("parameter_value")).alias("_ssl"))
    return clusters.join(ssl, "parameter_group", "left").select(
        F.lit(month).alias("snapshot_month"), "cluster_id", F.col("cluster_id").alias("cluster_name"), "encrypted",
        F.col("is_public").alias("publicly_accessible"),
        F.col("snapshot_days").cast("bigint").alias("automated_snapshot_retention_days"),
        (F.col("_ssl") == "true").alias("require_ssl"), F.col("tag_total").cast("bigint").alias("tag_count"))
