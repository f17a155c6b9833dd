"""Rule pools over efficiency records, evaluated together in one pass.

A rule is a predicate with a detail text, a recoverable amount and a confidence. All rules of a
pool become one array of structs per record; matching entries are exploded. The input is
scanned once however many rules there are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.frame import month_date

# Default thresholds a configuration file may override.
DEFAULT_THRESHOLDS = {
    "max_auto_termination_minutes": 60,
    "max_warehouse_auto_stop_minutes": 30,
    "min_redshift_snapshot_retention_days": 7,
    "low_traffic_endpoint_requests": 100,
    "underutilized_pct": 20,
}

# Keys a source may deliver inside cause_detail, by type.
CAUSE_KEYS: dict[str, tuple[str, ...]] = {
    "string": (
        "worker_node_type", "availability", "storage_class", "compression_codec", "top_job_name",
        "top_job_owner", "warehouse_type", "serving_mode", "workload_type", "workload_size",
        "activity_measured_since", "diststyle", "encoded", "spectrum_allocation_status", "policy_id",
    ),
    "boolean": ("photon", "scale_to_zero_enabled"),
    "bigint": (
        "min_autoscale_workers", "max_autoscale_workers", "auto_termination_minutes", "num_files",
        "query_count", "spill_query_count", "request_count", "total_tokens",
        "disk_spill_query_count", "tbl_rows", "run_count", "days_since_last_access",
        "spectrum_scan_count", "tag_count", "auto_stop_minutes",
    ),
    "double": (
        "failed_cost", "pct_runs_underutilized", "core_count", "max_cpu_pct", "max_mem_pct",
        "job_shaped_cost", "cache_hit_pct", "spilled_bytes", "shuffle_bytes",
        "pct_time_high_cpu_wait", "pct_time_high_mem_swap", "min_local_disk_free_bytes",
        "network_bytes", "avg_run_seconds", "avg_interval_minutes", "duration_share_pct",
        "jobs_priced_cost", "compute_cost", "concurrency_scaling_cost", "spectrum_scan_cost",
        "wlm_queue_wait_ms_p95", "wlm_queue_wait_ms_p99", "on_demand_node_hours",
        "reserved_node_hours", "unsorted_pct", "stats_off_pct", "pct_runs_spilling",
        "avg_disk_spill_gb", "avg_skew_ratio", "max_skew_ratio", "spectrum_scanned_gb",
        "spectrum_returned_gb", "spectrum_allocated_cost", "spectrum_allocation_pct",
    ),
}


def unpack_cause_detail(records: DataFrame) -> DataFrame:
    """Efficiency records with every cause key as a typed column; a missing key stays NULL.

    The JSON text is parsed once per row. Whole numbers written as '3.0' still read as 3.
    """
    keys = [(kind, key) for kind, names in CAUSE_KEYS.items() for key in names]
    # Text fields of one struct: a field read is a slot access, a map read would search its keys.
    shape = ", ".join(f"{key} string" for _, key in keys)
    parsed = records.withColumn("_cause", F.from_json("cause_detail", shape))
    out = [F.col(c) for c in records.columns if c != "charge_month"]
    out.append(month_date("charge_month").alias("charge_month"))
    for kind, key in keys:
        text = F.col(f"_cause.{key}")
        if kind == "bigint":
            text = F.coalesce(text.try_cast("bigint"), F.round(text.try_cast("double")).try_cast("bigint"))
        elif kind != "string":
            text = text.try_cast(kind)
        out.append(text.alias(key))
    return parsed.select(*out)


@dataclass(frozen=True)
class WasteRule:
    category: str
    lens: str
    applies: Callable[[dict], Column]
    detail: Callable[[dict], Column]
    recoverable: Callable[[dict], Column]
    high_confidence: Callable[[dict], Column] | bool = False
    providers: tuple[str, ...] = ()
    entity_types: tuple[str, ...] = ()
    thresholds: tuple[str, ...] = ()


@dataclass(frozen=True)
class BlockedRule:
    """Known pattern whose telemetry no source delivers; listed, never evaluated."""

    category: str
    lens: str
    providers: tuple[str, ...] = ()
    entity_types: tuple[str, ...] = ()
    requires: tuple[str, ...] = field(default=())


# --- text helpers ---------------------------------------------------------------------------
def _c(name: str) -> Column:
    return F.col(name)


def _txt(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _whole(c: Column) -> Column:
    return F.round(c).cast("bigint").cast("string")


def _tenth(c: Column) -> Column:
    return F.round(c, 1).cast("decimal(30,1)").cast("string")


def _hundredth(c: Column) -> Column:
    """Two digits, but a trailing zero second digit is not written."""
    return F.regexp_replace(F.round(c, 2).cast("decimal(30,2)").cast("string"), r"(\.\d)0$", "$1")


def _or(c: Column, default) -> Column:
    return F.coalesce(c, F.lit(default))


def _cents(c: Column) -> Column:
    return F.round(c, 2).cast("double")


def _share_of_bill(factor: str) -> Callable[[dict], Column]:
    """Exact decimal share of the billed cost."""
    return lambda t: _cents(_c("billed_cost") * F.lit(factor).cast("decimal(4,2)"))


def _zero(t: dict) -> Column:
    return F.lit(0.0)


_ENTITY = "entity_type"


def _is(*kinds: str) -> Column:
    return _c(_ENTITY).isin(*kinds)


def _unused_bill(factor: float = 1.0) -> Callable[[dict], Column]:
    def amount(t: dict) -> Column:
        value = _c("billed_cost").cast("double") * (1 - _c("utilization_pct") / 100.0)
        return _cents(value * factor if factor != 1.0 else value)

    return amount


def _util_text(*before) -> Callable[[dict], Column]:
    return lambda t: _txt(*[b() if callable(b) else b for b in before],
                          "util ", _whole(_c("utilization_pct")), "%")


def _long_enough() -> Column:
    """Single runs of a job must last five minutes before node signals mean anything."""
    return (_c(_ENTITY) != "job") | _or(_c("avg_run_seconds") >= 300, False)


def _node_suffix() -> Column:
    run = F.when(
        _is("job") & _c("avg_run_seconds").isNotNull(),
        _txt(", avg run ", _tenth(_c("avg_run_seconds") / 60.0), " min"),
    )
    return _txt(_or(_txt(" — ", _c("worker_node_type")), ""), _or(run, ""))


def _pressure_detail(t: dict) -> Column:
    return _txt(
        F.when(_or(_c("pct_time_high_cpu_wait"), 0.0) >= 0.1,
               _txt(_whole(_c("pct_time_high_cpu_wait") * 100), "% time with elevated CPU wait"))
        .when(_or(_c("pct_time_high_mem_swap"), 0.0) >= 0.1,
              _txt(_whole(_c("pct_time_high_mem_swap") * 100), "% of sampled time swapping"))
        .otherwise(_txt(_tenth(_c("min_local_disk_free_bytes") / 1e9), " GB local disk free (low)")),
        _node_suffix(),
    )


def _spectrum_detail(t: dict) -> Column:
    scanned, returned = _c("spectrum_scanned_gb"), _c("spectrum_returned_gb")
    return _txt(
        _tenth(scanned), " GB scanned",
        F.when((_or(returned, 0.0) > 0) & (scanned > 0),
               _txt(", ", _whole(100 * F.try_divide(returned, scanned)), "% returned (pruning efficiency)"))
        .otherwise(""),
        " across ", _or(_c("spectrum_scan_count"), 0).cast("string"), " queries",
        F.when(_c("spectrum_allocated_cost").isNotNull(),
               _txt(", allocated Spectrum charge $", _hundredth(_c("spectrum_allocated_cost"))))
        .otherwise(""),
    )


def _scaling_share() -> Column:
    extra = _c("concurrency_scaling_cost")
    return F.try_divide(extra, _c("compute_cost") + extra)


_DBX, _AWS = ("Databricks",), ("AWS",)
_INTERACTIVE, _WAREHOUSE, _TABLE = ("interactive",), ("sql_warehouse",), ("table",)
_SHARED_USER, _PATTERN, _SERVED = ("sql_warehouse_user",), ("query_pattern",), ("endpoint",)

WASTE_RULES: tuple[WasteRule, ...] = (
    WasteRule(
        "underutilized", "WASTE",
        lambda t: _c("utilization_pct") <= t["underutilized_pct"],
        _util_text(), _unused_bill(),
        lambda t: _or(_c("pct_runs_underutilized"), 0.0) >= 0.8,
        thresholds=("underutilized_pct",)),
    WasteRule(
        "idle", "WASTE",
        lambda t: (_c("activity_count") == 0) & (_c("billed_cost") > 0),
        lambda t: _txt("no measured activity", _or(_txt(
            " (measured since ", _c("activity_measured_since"), ", not the full billing period)"), "")),
        lambda t: _cents(_c("billed_cost")), True),
    WasteRule(
        "job_low_utilization", "WASTE",
        lambda t: _is("job") & (_c("utilization_pct") > 20) & (_c("utilization_pct") < 60),
        lambda t: _txt("util ", _whole(_c("utilization_pct")), "%", F.when(
            _c("max_mem_pct").isNotNull() | _c("max_cpu_pct").isNotNull(),
            _txt(" (peak cpu ", _whole(_or(_c("max_cpu_pct"), 0.0)), "%, mem ",
                 _whole(_or(_c("max_mem_pct"), 0.0)), "%)")).otherwise("")),
        _unused_bill(0.5), providers=_DBX, entity_types=("job",)),
    WasteRule(
        "possible_memory_pressure", "WASTE",
        lambda t: _is("job", "interactive") & _long_enough() & (
            (_or(_c("pct_time_high_cpu_wait"), 0.0) >= 0.1)
            | (_or(_c("pct_time_high_mem_swap"), 0.0) >= 0.1)
            | _or(_c("min_local_disk_free_bytes") < 10_000_000_000, False)),
        _pressure_detail, _zero, providers=_DBX, entity_types=("job", "interactive")),
    WasteRule(
        "possible_heavy_shuffle", "WASTE",
        lambda t: _is("job", "interactive") & _long_enough() & (_c("network_bytes") >= 500_000_000_000),
        lambda t: _txt(F.round(_c("network_bytes") / 1e9).cast("decimal(30,1)").cast("string"),
                       " GB network I/O this month", _node_suffix()),
        _zero, providers=_DBX, entity_types=("job", "interactive")),
    WasteRule(
        "placement", "OPPORTUNITY",
        lambda t: _is("interactive") & (_or(_c("job_shaped_cost"), 0.0) > 0),
        lambda t: _txt(_or(_c("top_job_name"), "a job"), ", owner ", _or(_c("top_job_owner"), "unknown"),
                       " → jobs compute"),
        lambda t: _cents(F.greatest(
            _c("job_shaped_cost") - F.coalesce("jobs_priced_cost", "job_shaped_cost"), F.lit(0.0))),
        providers=_DBX, entity_types=_INTERACTIVE),
    WasteRule(
        "failed", "WASTE",
        lambda t: _or(_c("failed_cost"), 0.0) > 0,
        lambda t: F.lit("→ fix errors, reduce retries"),
        lambda t: _cents(_c("failed_cost")), True),
    WasteRule(
        "photon_no_gain", "WASTE",
        lambda t: ~_is("interactive") & _or(_c("photon"), False) & (_c("utilization_pct") < 80),
        _util_text("photon, "),
        # Photon's list premium on jobs compute is 2.9x.
        lambda t: _cents(_c("billed_cost").cast("double") * (1 - 1 / 2.9)), providers=_DBX),
    WasteRule(
        "photon_on_interactive_cluster", "WASTE",
        lambda t: _is("interactive") & _or(_c("photon"), False),
        lambda t: F.lit("photon enabled on exploratory cluster"),
        _share_of_bill("0.5"), providers=_DBX, entity_types=_INTERACTIVE),
    WasteRule(
        "missing_autotermination", "WASTE",
        lambda t: _is("interactive") & _c("auto_termination_minutes").isNull(),
        lambda t: F.lit("no auto-termination policy"),
        _share_of_bill("0.15"), providers=_DBX, entity_types=_INTERACTIVE),
    WasteRule(
        "autoscale_misconfigured", "WASTE",
        lambda t: _is("interactive") & (_c("utilization_pct") <= 20) & (
            _c("max_autoscale_workers") >= 3 * F.greatest(_c("min_autoscale_workers"), F.lit(1))),
        lambda t: _txt("autoscale ", _c("min_autoscale_workers").cast("string"), "-",
                       _c("max_autoscale_workers").cast("string"), " workers, util ",
                       _whole(_c("utilization_pct")), "%"),
        _unused_bill(0.5), providers=_DBX, entity_types=_INTERACTIVE),
    WasteRule(
        "oversized_nodes", "WASTE",
        lambda t: _is("interactive") & (_c("core_count") >= 16) & (_c("utilization_pct") <= 20),
        lambda t: _txt(_c("worker_node_type"), " (", _c("core_count").cast("int").cast("string"),
                       " cores), util ", _whole(_c("utilization_pct")), "%"),
        _unused_bill(0.5), providers=_DBX, entity_types=_INTERACTIVE),
    WasteRule(
        "graviton_price_opportunity", "OPPORTUNITY",
        lambda t: _is("interactive") & _c("worker_node_type").rlike(r"^[a-z][0-9]+[a-z]*\.")
        & ~_c("worker_node_type").rlike(r"^[a-z][0-9]+g[a-z]*\."),
        lambda t: _txt(_c("worker_node_type"), " (no Graviton/ARM generation detected)"),
        _share_of_bill("0.15"), providers=_DBX, entity_types=_INTERACTIVE),
    WasteRule(
        "on_demand_only", "OPPORTUNITY",
        lambda t: _is("interactive") & (_c("availability") == "ON_DEMAND"),
        lambda t: F.lit("100% on-demand"),
        _share_of_bill("0.5"), providers=_DBX, entity_types=_INTERACTIVE),
    WasteRule(
        "sql_warehouse_low_cache_reuse", "WASTE",
        lambda t: _is("sql_warehouse") & (_c("cache_hit_pct") < 5) & (_c("query_count") > 1000),
        lambda t: _txt("cache hit ", _tenth(_c("cache_hit_pct")), "%, ",
                       _c("query_count").cast("string"), " queries"),
        _share_of_bill("0.25"), providers=_DBX, entity_types=_WAREHOUSE),
    WasteRule(
        "sql_warehouse_disk_spill", "WASTE",
        lambda t: _is("sql_warehouse") & (_c("query_count") > 0)
        & (F.try_divide(_c("spill_query_count").cast("double"), _c("query_count")) >= 0.02),
        lambda t: _txt(_c("spill_query_count").cast("string"), " of ", _c("query_count").cast("string"),
                       " queries spilled to disk",
                       _or(_txt(" (", _tenth(_c("spilled_bytes") / 1e9), " GB)"), "")),
        _zero, providers=_DBX, entity_types=_WAREHOUSE),
    WasteRule(
        "sql_warehouse_user_concentration", "OPPORTUNITY",
        lambda t: _is("sql_warehouse_user") & (_c("duration_share_pct") >= 40),
        lambda t: _txt(_whole(_c("duration_share_pct")), "% of warehouse spend, ",
                       _c("query_count").cast("string"), " queries"),
        _share_of_bill("0.20"), entity_types=_SHARED_USER),
    WasteRule(
        "sql_warehouse_high_frequency_workload", "OPPORTUNITY",
        lambda t: _is("sql_warehouse_user") & (_c("warehouse_type") == "SERVERLESS")
        & (_c("avg_interval_minutes") <= 60) & (_c("query_count") >= 20),
        lambda t: _txt("runs every ~", _whole(_c("avg_interval_minutes")), " min, ",
                       _c("query_count").cast("string"), " queries this month"),
        _share_of_bill("0.5"), providers=_DBX, entity_types=_SHARED_USER),
    WasteRule(
        "sql_warehouse_serverless_pricing_gap", "OPPORTUNITY",
        lambda t: _is("sql_warehouse") & (_c("warehouse_type") == "SERVERLESS") & (_c("query_count") > 1000),
        lambda t: _txt("serverless, ", _c("query_count").cast("string"), " queries this month"),
        _zero, providers=_DBX, entity_types=_WAREHOUSE),
    WasteRule(
        "notebook_could_move_to_jobs", "OPPORTUNITY",
        lambda t: _is("notebook"),
        lambda t: _txt("owner ", _or(_c("owner_user"), "unknown"), " → jobs compute"),
        lambda t: _cents(F.greatest(
            _c("billed_cost").cast("double")
            - F.coalesce(_c("jobs_priced_cost"), _c("billed_cost").cast("double")), F.lit(0.0))),
        providers=_DBX, entity_types=("notebook",)),
    WasteRule(
        "endpoint_scale_to_zero_disabled", "WASTE",
        lambda t: _is("endpoint") & ~_c("scale_to_zero_enabled")
        & (_c("request_count") < t["low_traffic_endpoint_requests"]),
        lambda t: _txt(_c("request_count").cast("string"), " request(s), scale-to-zero off"),
        _zero, providers=_DBX, entity_types=_SERVED, thresholds=("low_traffic_endpoint_requests",)),
    WasteRule(
        "endpoint_oversized_workload", "OPPORTUNITY",
        lambda t: _is("endpoint") & _c("workload_type").isin("GPU_MEDIUM", "GPU_LARGE")
        & (_c("request_count") < t["low_traffic_endpoint_requests"]),
        lambda t: _txt(_c("workload_type"), ", ", _c("request_count").cast("string"), " request(s)"),
        _zero, providers=_DBX, entity_types=_SERVED, thresholds=("low_traffic_endpoint_requests",)),
    WasteRule(
        "s3_intelligent_tiering", "OPPORTUNITY",
        lambda t: _is("storage") & (_or(_c("storage_class"), "standard") != "intelligent_tiering"),
        lambda t: _txt("storage_class=", _or(_c("storage_class"), "standard")),
        _share_of_bill("0.35"), providers=_AWS, entity_types=("storage",)),
    WasteRule(
        "snappy_to_zstd_compression", "WASTE",
        lambda t: _is("table") & (_c("compression_codec") == "snappy"),
        lambda t: _txt("compression_codec=snappy, ", _or(_c("num_files"), 0).cast("string"), " files"),
        _zero, True, providers=_DBX, entity_types=_TABLE),
    WasteRule(
        "redshift_concurrency_scaling_overage", "OPPORTUNITY",
        lambda t: _is("sql_warehouse")
        & (_c("compute_cost") + _c("concurrency_scaling_cost") > 0) & (_scaling_share() >= 0.15),
        lambda t: _txt("concurrency scaling $", _whole(_c("concurrency_scaling_cost")), " (",
                       _whole(100 * _c("concurrency_scaling_cost")
                              / F.nullif(_c("compute_cost") + _c("concurrency_scaling_cost"), F.lit(0.0))),
                       "% of compute+scaling spend)"),
        lambda t: _cents(_c("concurrency_scaling_cost")), providers=_AWS, entity_types=_WAREHOUSE),
    WasteRule(
        "redshift_ri_coverage_gap", "OPPORTUNITY",
        lambda t: _is("sql_warehouse") & (_c("on_demand_node_hours") > 0),
        lambda t: _txt(_whole(_c("on_demand_node_hours")), " on-demand node-hours this month (vs ",
                       _whole(_or(_c("reserved_node_hours"), 0.0)), " reserved)"),
        lambda t: _cents(_or(_c("compute_cost"), 0.0) * F.try_divide(
            _c("on_demand_node_hours"),
            _c("on_demand_node_hours") + _or(_c("reserved_node_hours"), 0.0)) * 0.5),
        providers=_AWS, entity_types=_WAREHOUSE),
    WasteRule(
        "redshift_spectrum_scan_cost", "OPPORTUNITY",
        lambda t: _is("sql_warehouse") & (_c("spectrum_scan_cost") > 0),
        lambda t: _txt("Spectrum scan $", _whole(_c("spectrum_scan_cost")),
                       " this month — verify partition pruning/columnar source format"),
        lambda t: _cents(_c("spectrum_scan_cost") * 0.3), providers=_AWS, entity_types=_WAREHOUSE),
    WasteRule(
        "redshift_disk_spill_queries", "WASTE",
        lambda t: _is("sql_warehouse") & (_c("query_count") > 0)
        & (F.try_divide(_c("disk_spill_query_count").cast("double"), _c("query_count")) >= 0.02),
        lambda t: _txt(_c("disk_spill_query_count").cast("string"), " of ",
                       _c("query_count").cast("string"), " queries spilled to disk"),
        _zero, providers=_AWS, entity_types=_WAREHOUSE),
    WasteRule(
        "redshift_wlm_queue_wait", "OPPORTUNITY",
        lambda t: _is("sql_warehouse") & (_c("wlm_queue_wait_ms_p95") >= 5000),
        lambda t: _txt("p95 queue wait ", _tenth(_c("wlm_queue_wait_ms_p95") / 1000.0), "s",
                       _or(_txt(", p99 ", _tenth(_c("wlm_queue_wait_ms_p99") / 1000.0), "s"), "")),
        _zero, providers=_AWS, entity_types=_WAREHOUSE),
    WasteRule(
        "redshift_query_pattern_high_spill", "WASTE",
        lambda t: _is("query_pattern") & (_c("run_count") >= 3) & (_c("pct_runs_spilling") >= 0.5),
        lambda t: _txt(_whole(_c("pct_runs_spilling") * 100), "% of ", _c("run_count").cast("string"),
                       " runs spilled, avg ", _hundredth(_or(_c("avg_disk_spill_gb"), 0.0)), " GB"),
        _zero, providers=_AWS, entity_types=_PATTERN),
    WasteRule(
        "redshift_query_pattern_skew", "WASTE",
        lambda t: _is("query_pattern") & (_c("run_count") >= 3) & (_c("avg_skew_ratio") >= 2.0),
        lambda t: _txt("avg skew ", _tenth(_c("avg_skew_ratio")), "x, max ",
                       _tenth(F.coalesce("max_skew_ratio", "avg_skew_ratio")), "x over ",
                       _c("run_count").cast("string"), " runs"),
        _zero, providers=_AWS, entity_types=_PATTERN),
    WasteRule(
        "redshift_stale_compression_encoding", "WASTE",
        lambda t: _is("table") & (_c("encoded") == "N"),
        lambda t: _txt("encoding disabled, ", _or(_c("tbl_rows"), 0).cast("string"), " rows"),
        _zero, True, providers=_AWS, entity_types=_TABLE),
    WasteRule(
        "redshift_table_maintenance_stale", "WASTE",
        lambda t: _is("table")
        & ((_or(_c("unsorted_pct"), 0.0) >= 20) | (_or(_c("stats_off_pct"), 0.0) >= 20)),
        lambda t: _txt("unsorted ", _whole(_or(_c("unsorted_pct"), 0.0)), "%, stats off ",
                       _whole(_or(_c("stats_off_pct"), 0.0)), "% — VACUUM/ANALYZE due"),
        _zero, providers=_AWS, entity_types=_TABLE),
    WasteRule(
        "redshift_table_unused", "WASTE",
        lambda t: _is("table") & (_c("days_since_last_access") >= 90),
        lambda t: _txt("not queried in ", _c("days_since_last_access").cast("string"), " days"),
        # Managed storage at 0.024 $/GB-month; the table size is in MB.
        lambda t: _cents(_or(_c("native_quantity"), 0.0) / 1024.0 * 0.024),
        providers=_AWS, entity_types=_TABLE),
    WasteRule(
        "redshift_spectrum_table_scan", "OPPORTUNITY",
        lambda t: _is("table") & (_c("spectrum_scanned_gb") >= 1),
        _spectrum_detail,
        lambda t: _cents(_or(_c("spectrum_allocated_cost"), 0.0) * 0.3),
        lambda t: _c("spectrum_allocated_cost").isNull(), providers=_AWS, entity_types=_TABLE),
)

BLOCKED_WASTE_RULES = (
    BlockedRule("classic_notebook_attribution", "WASTE", _DBX, (),
                ("notebook attach and command audit events",)),
    BlockedRule("missing_delta_optimization", "WASTE", _DBX, _TABLE,
                ("table OPTIMIZE/VACUUM history",)),
)


def _fire(records: DataFrame, keep: list[str], entries: list[Column]) -> DataFrame:
    fired = F.filter(F.array(*entries), lambda x: x.isNotNull())
    return records.select(*keep, F.explode(fired).alias("_hit")).select(*keep, "_hit.*")


def waste_record(
    records: DataFrame, thresholds: dict[str, int] | None = None, rules=WASTE_RULES
) -> DataFrame:
    """One row per (entity, month, matching rule), from unpacked efficiency records."""
    t = {**DEFAULT_THRESHOLDS, **(thresholds or {})}
    entries = []
    for r in rules:
        sure = r.high_confidence
        flag = F.lit(sure) if isinstance(sure, bool) else sure(t)
        entries.append(F.when(r.applies(t), F.struct(
            F.lit(r.category).alias("waste_category"), F.lit(r.lens).alias("lens"),
            r.detail(t).alias("detail"), r.recoverable(t).alias("recoverable_cost"),
            F.when(flag, "high").otherwise("candidate").alias("confidence"))))
    keep = ["provider_name", "charge_month", "entity_type", "entity_id", "entity_name",
            "owner_user", "owner_project", "billed_cost"]
    if len(rules) == 1:
        # A rule alone is a filter: its parts on plain columns are applied before the causes are unpacked.
        records = records.where(rules[0].applies(t))
    return _fire(records, keep, entries)


# --- policies ---------------------------------------------------------------------------------
@dataclass(frozen=True)
class PolicyRule:
    category: str
    entity_type: str
    compliant: Callable[[dict], Column]
    detail: Callable[[dict], Column]
    unmeasured: Callable[[], Column] | None = None
    thresholds: tuple[str, ...] = ()


def _minutes_detail(column: str, limit: str, verb: str, absent: str) -> Callable[[dict], Column]:
    def text(t: dict) -> Column:
        minutes = _c(column)
        base = _txt(f"auto-{verb} after ", minutes.cast("string"), " min")
        return (F.when(minutes.isNull(), absent)
                .when(minutes <= t[limit], base)
                .otherwise(_txt(base, f", over the {t[limit]} min policy")))

    return text


def _tag_rule(category: str, kind: str) -> PolicyRule:
    def text(t: dict) -> Column:
        tags = _c("tag_count")
        return (F.when(tags.isNull(), "tag telemetry unavailable").when(tags == 0, "no tags set")
                .otherwise(_txt(tags.cast("string"), " tag(s) set")))

    return PolicyRule(category, kind, lambda t: _c("tag_count") > 0, text,
                      lambda: _c("tag_count").isNull())


POLICY_RULES: tuple[PolicyRule, ...] = (
    PolicyRule(
        "auto_terminate", "interactive",
        lambda t: _c("auto_termination_minutes") <= t["max_auto_termination_minutes"],
        _minutes_detail("auto_termination_minutes", "max_auto_termination_minutes", "terminate",
                        "no auto-termination policy set"),
        thresholds=("max_auto_termination_minutes",)),
    PolicyRule(
        "autoscaling", "interactive",
        lambda t: _c("max_autoscale_workers") > _c("min_autoscale_workers"),
        lambda t: _or(_txt("autoscale ", _c("min_autoscale_workers").cast("string"), "-",
                           _c("max_autoscale_workers").cast("string"), " workers"),
                      "fixed-size cluster, no autoscale range")),
    PolicyRule(
        "cluster_policy_assigned", "interactive",
        lambda t: _c("policy_id").isNotNull(),
        lambda t: _or(_txt("policy ", _c("policy_id")), "no cluster policy assigned")),
    _tag_rule("cluster_tagging", "interactive"),
    _tag_rule("warehouse_tagging", "sql_warehouse"),
    PolicyRule(
        "warehouse_auto_stop", "sql_warehouse",
        lambda t: _c("auto_stop_minutes") <= t["max_warehouse_auto_stop_minutes"],
        _minutes_detail("auto_stop_minutes", "max_warehouse_auto_stop_minutes", "stop",
                        "auto-stop telemetry unavailable"),
        lambda: _c("auto_stop_minutes").isNull(), ("max_warehouse_auto_stop_minutes",)),
    _tag_rule("endpoint_tagging", "endpoint"),
)

BLOCKED_POLICY_RULES = (
    BlockedRule("query_tagging", "", (), (), ("a statement-level tag column in the query history",)),
)


def _flag_rule(category: str, column: str, want: bool, texts: tuple[str, str, str]) -> PolicyRule:
    absent, good, bad = texts

    def ok(t: dict) -> Column:
        return _c(column) if want else ~_c(column)

    return PolicyRule(
        category, "redshift_cluster", ok,
        lambda t: F.when(_c(column).isNull(), absent).when(ok(t), good).otherwise(bad),
        lambda: _c(column).isNull())


def _retained() -> Column:
    return _c("automated_snapshot_retention_days")


def _snapshot_rules() -> tuple[PolicyRule, ...]:
    return (
        _flag_rule("redshift_encryption", "encrypted", True, (
            "encryption telemetry unavailable", "encryption enabled", "cluster is not encrypted")),
        _flag_rule("redshift_public_access", "publicly_accessible", False, (
            "public-access telemetry unavailable", "not publicly accessible",
            "cluster is publicly accessible")),
        _flag_rule("redshift_enhanced_vpc_routing", "enhanced_vpc_routing", True, (
            "enhanced VPC routing telemetry unavailable", "enhanced VPC routing enabled",
            "enhanced VPC routing disabled")),
        PolicyRule(
            "redshift_snapshot_retention", "redshift_cluster",
            lambda t: _retained() >= t["min_redshift_snapshot_retention_days"],
            lambda t: _or(_txt(_retained().cast("string"), " day(s) retained"),
                          "snapshot-retention telemetry unavailable"),
            lambda: _retained().isNull(), ("min_redshift_snapshot_retention_days",)),
        _flag_rule("redshift_require_ssl", "require_ssl", True, (
            "require_ssl telemetry unavailable", "require_ssl=true", "require_ssl=false")),
        _tag_rule("redshift_cluster_tagging", "redshift_cluster"),
    )


SNAPSHOT_POLICY_RULES = _snapshot_rules()


def _policy_entry(r: PolicyRule, t: dict) -> Column:
    unmeasured = r.unmeasured() if r.unmeasured else F.lit(False)
    return F.when(_c(_ENTITY) == r.entity_type, F.struct(
        F.lit(r.category).alias("policy_category"),
        F.when(unmeasured, "not_applicable").when(r.compliant(t), "compliant")
        .otherwise("non_compliant").alias("status"),
        r.detail(t).alias("detail")))


def policy_record(
    records: DataFrame, snapshots: DataFrame, thresholds: dict[str, int] | None = None
) -> DataFrame:
    """One row per (entity, month, applicable policy), from records and cluster snapshots."""
    t = {**DEFAULT_THRESHOLDS, **(thresholds or {})}
    keep = ["provider_name", "charge_month", "entity_type", "entity_id", "entity_name",
            "owner_user", "owner_project"]
    # Kinds without a policy are left out before their causes are unpacked.
    governed = records.where(F.col(_ENTITY).isin(*sorted({r.entity_type for r in POLICY_RULES})))
    from_records = _fire(governed, keep, [_policy_entry(r, t) for r in POLICY_RULES])
    clusters = snapshots.select(
        "*", F.lit(None).cast("string").alias("owner_user"),
        F.lit(None).cast("string").alias("owner_project"),
        F.lit("redshift_cluster").alias("entity_type"), F.col("cluster_id").alias("entity_id"),
        F.coalesce("cluster_name", "cluster_id").alias("entity_name"),
        month_date("snapshot_month").alias("charge_month"),
    ).withColumn("provider_name", F.lit("AWS"))
    from_snapshots = _fire(clusters, keep, [_policy_entry(r, t) for r in SNAPSHOT_POLICY_RULES])
    return from_records.unionByName(from_snapshots)


def policy_summary_month(policies: DataFrame) -> DataFrame:
    return policies.groupBy("charge_month", "policy_category", "status").agg(
        F.count("*").alias("entity_count"))
