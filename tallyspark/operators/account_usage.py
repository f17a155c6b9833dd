"""Warehouse account-usage analytics: KPIs, cost mix, idle and hidden waste, query economics.

Operators take the source views by name. Windows end at the newest metering day, which callers
resolve once (`resolve_as_of`) so that every window is a literal the scan can push down.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.operators.frame import broadcast_single, exact_avg, ratio, ranked, top_rows, union_all, wide

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Prices:
    credit: float = 4.00
    storage_per_tb: float = 23.0


# Warehouse and service names as the source spells them.
AI_WAREHOUSES = ("ML_TRAINING", "CORTEX_AI", "CORTEX_SEARCH", "CORTEX_AGENTS")
AI_QUERY_WAREHOUSES = ("CORTEX_AI", "CORTEX_SEARCH", "CORTEX_AGENTS", "ML_TRAINING", "DATA_SCIENCE")
AI_SERVICES = (
    "CORTEX_AI_FUNCTIONS", "CORTEX_SEARCH", "AI_SERVICES", "CORTEX_ANALYST", "DOCUMENT_AI",
    "SNOWFLAKE_INTELLIGENCE", "CORTEX_AGENTS", "CORTEX_GUARDRAILS",
)
SERVERLESS_SERVICES = (
    "AUTOMATIC_CLUSTERING", "AUTO_CLUSTERING", "SNOWPIPE", "PIPE", "SNOWPIPE_STREAMING",
    "SERVERLESS_TASK", "SERVERLESS_ALERTS", "REPLICATION", "SEARCH_OPTIMIZATION", "MATERIALIZED_VIEW",
    "QUERY_ACCELERATION", "SNOWPARK_CONTAINER_SERVICES", "HYBRID_TABLE_REQUESTS",
    "OPENFLOW_COMPUTE_BYOC", "OPENFLOW_COMPUTE_SNOWFLAKE", "POSTGRES_COMPUTE", "POSTGRES_COMPUTE_HA",
    "WAREHOUSE_METERING", "WAREHOUSE_METERING_READER",
)
KPI_SERVERLESS = (
    "AUTOMATIC_CLUSTERING", "SNOWPIPE", "SERVERLESS_TASK", "REPLICATION", "SEARCH_OPTIMIZATION",
    "MATERIALIZED_VIEW", "QUERY_ACCELERATION", "SNOWPARK_CONTAINER_SERVICES",
)
STORAGE_SERVICES = (
    "FAILSAFE_RECOVERY", "ARCHIVE_STORAGE_RETRIEVAL_FILE_PROCESSING", "ARCHIVE_STORAGE_WRITE",
    "STORAGE_LIFECYCLE_POLICY_EXECUTION",
)
SERVICE_USERS = ("ETL_SERVICE", "ML_PIPELINE", "DBT_RUNNER")

_GB, _TB = 1024.0**3, 1024.0**4


def as_of(tables: Tables) -> DataFrame:
    return tables["warehouse_metering_history"].agg(F.max(F.to_date("start_time")).alias("as_of"))


def resolve_as_of(tables: Tables) -> dt.date:
    """The newest metering day as one driver-side value; today when nothing was metered."""
    return as_of(tables).first()[0] or dt.date.today()


def _day(value: dt.date) -> Column:
    return F.lit(value).cast("timestamp")


def _month_floor(value: dt.date, back: int = 0) -> dt.date:
    months = value.year * 12 + value.month - 1 - back
    return dt.date(months // 12, months % 12 + 1, 1)


def _since(value: dt.date, days: int) -> Column:
    return F.col("start_time") >= _day(value - dt.timedelta(days=days))


def _between_days(start: str, end: str) -> Column:
    return (F.col("start_time") >= F.lit(start).cast("timestamp")) & (
        F.col("start_time") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp"))


def _credits(name: str = "credits_used") -> Column:
    return F.sum(F.col(name)).cast("double")


def _round2(c: Column) -> Column:
    return F.round(c.cast("double"), 2)


def _money_columns(total: Column, p: Prices) -> list[Column]:
    return [_round2(total).alias("credits"), _round2(total.cast("double") * p.credit).alias("cost_usd")]


def _sum_when(c: str, cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, F.col(c))).cast("double"), F.lit(0.0))


def _cross(frames: list[DataFrame]) -> DataFrame:
    """Side by side one-row frames."""
    out = frames[0]
    for f in frames[1:]:
        out = out.crossJoin(broadcast_single(f))
    return out


def _latest_storage(tables: Tables) -> DataFrame:
    row = F.struct("storage_bytes", "stage_bytes", "failsafe_bytes")
    newest = tables["storage_usage"].agg(F.max_by(row, F.struct("usage_date", row)).alias("s"))
    return newest.select(*[F.coalesce(F.col(f"s.{c}"), F.lit(0)).cast("double").alias(c)
                           for c in ("storage_bytes", "stage_bytes", "failsafe_bytes")])


def _warehouses(tables: Tables) -> DataFrame:
    return tables["warehouse_metering_history"].where(F.col("warehouse_id") > 0)


def _category() -> Column:
    s = F.col("service_type")
    return (
        F.when(s.isin(*AI_SERVICES), "AI & ML").when(s.isin(*SERVERLESS_SERVICES), "Serverless Compute")
        .when(s.isin(*STORAGE_SERVICES), "Storage").when(s == "DATA_TRANSFER", "Data Transfer")
        .otherwise("Other")
    )


def _warehouse_category() -> Column:
    return F.when(F.col("warehouse_name").isin(*AI_WAREHOUSES), "AI & ML").otherwise("Managed Compute")


def kpi_summary(tables: Tables, day: dt.date, p: Prices = Prices()) -> DataFrame:
    month, year = _month_floor(day), dt.date(day.year, 1, 1)
    this_month, this_year = F.col("start_time") >= _day(month), F.col("start_time") >= _day(year)
    wh = tables["warehouse_metering_history"].agg(
        _sum_when("credits_used", this_month).alias("wh"),
        _sum_when("credits_used", this_month & F.col("warehouse_name").isin(*AI_WAREHOUSES)).alias("ai"),
        _sum_when("credits_used", this_year).alias("wh_ytd"),
        F.countDistinct("warehouse_name").alias("warehouses"))
    svc = tables["metering_history"].agg(
        _sum_when("credits_used", this_month).alias("svc"),
        _sum_when("credits_used", this_month & F.col("service_type").isin(*KPI_SERVERLESS)).alias("serverless"),
        _sum_when("credits_used", this_year).alias("svc_ytd"))
    queries = tables["query_history"].agg(F.count_if(F.col("execution_status") == "SUCCESS").alias("queries"))
    load = tables["warehouse_load_history"].agg(F.coalesce(F.avg("avg_running"), F.lit(0.0)).alias("running"))
    storage = _latest_storage(tables).select(
        F.round((F.col("storage_bytes") + F.col("stage_bytes")) / _TB, 2).alias("storage_tb"))
    total = F.col("wh") + F.col("svc")
    storage_cost = F.round(F.col("storage_tb") * p.storage_per_tb, 0)
    return _cross([wh, svc, queries, load, storage]).select(
        F.round(total, 0).alias("total_credits"),
        F.round(total * p.credit + storage_cost, 0).alias("total_cost"),
        F.round((F.col("wh") - F.col("ai")) * p.credit, 0).alias("compute_cost"),
        F.round(F.col("serverless") * p.credit, 0).alias("serverless_compute_cost"),
        F.lit(day.strftime("%B %Y")).alias("month_label"), "warehouses", "queries",
        F.round(F.col("running") * 100, 1).alias("avg_utilization_pct"), "storage_tb",
        storage_cost.alias("storage_cost"),
        F.round((F.col("wh_ytd") + F.col("svc_ytd")) * p.credit + storage_cost * day.month, 0).alias("ytd_cost"),
    )


def cost_breakdown(tables: Tables, day: dt.date, p: Prices = Prices()) -> DataFrame:
    """Current-month cost in six categories; services nobody listed are 'Other'."""
    this_month = F.col("start_time") >= _day(_month_floor(day))
    parts = [
        tables["warehouse_metering_history"].where(this_month).groupBy(_warehouse_category().alias("label"))
        .agg((_credits() * p.credit).alias("cost")),
        tables["metering_history"].where(this_month).groupBy(_category().alias("label"))
        .agg((_credits() * p.credit).alias("cost")),
        _latest_storage(tables).select(
            F.lit("Storage").alias("label"),
            ((F.col("storage_bytes") + F.col("stage_bytes") + F.col("failsafe_bytes")) / _TB
             * p.storage_per_tb).alias("cost")),
    ]
    labels = ("Managed Compute", "Serverless Compute", "AI & ML", "Storage", "Data Transfer", "Other")
    spark = tables["storage_usage"].sparkSession
    zero = spark.createDataFrame([(x, 0.0) for x in labels], "label string, cost double")
    return union_all([*parts, zero]).groupBy("label").agg(F.sum("cost").alias("cost"))


def _title(c: str) -> Column:
    return F.initcap(F.replace(F.col(c), F.lit("_"), F.lit(" ")))


def ai_cost_breakdown(tables: Tables, day: dt.date, p: Prices = Prices()) -> DataFrame:
    this_month = F.col("start_time") >= _day(_month_floor(day))
    services = tables["metering_history"].where(this_month & F.col("service_type").isin(*AI_SERVICES)).groupBy(
        F.lit("service").alias("source"), _title("service_type").alias("label")).agg((_credits() * p.credit).alias("cost"))
    houses = tables["warehouse_metering_history"].where(
        this_month & F.col("warehouse_name").isin(*AI_WAREHOUSES)).groupBy(
        F.lit("warehouse").alias("source"), _title("warehouse_name").alias("label")).agg((_credits() * p.credit).alias("cost"))
    return services.unionByName(houses)


def serverless_cost_breakdown(tables: Tables, day: dt.date, p: Prices = Prices()) -> DataFrame:
    wanted = (*KPI_SERVERLESS, "DATA_TRANSFER")
    return tables["metering_history"].where(
        (F.col("start_time") >= _day(_month_floor(day))) & F.col("service_type").isin(*wanted)
    ).groupBy(_title("service_type").alias("label")).agg((_credits() * p.credit).alias("cost"))


def _table_label() -> Column:
    return F.concat_ws(".", "table_catalog", "table_schema", "table_name")


def _gb(c: str) -> Column:
    return _round2(F.col(c) / _GB)


def top_tables_storage(tables: Tables, n: int | None = None) -> DataFrame:
    total = F.col("active_bytes") + F.col("time_travel_bytes") + F.col("failsafe_bytes")
    rows = top_rows(tables["table_storage_metrics"].where(F.col("table_name").isNotNull()), n,
                    total.desc(), _table_label())
    return rows.select(_table_label().alias("table_name"), _gb("active_bytes").alias("active_gb"),
                       _gb("time_travel_bytes").alias("time_travel_gb"), _gb("failsafe_bytes").alias("failsafe_gb"),
                       _round2(total / _GB).alias("total_gb"))


def top_tables(tables: Tables, n: int | None = None) -> DataFrame:
    held = F.col("active_bytes") + F.col("time_travel_bytes") + F.col("failsafe_bytes")
    rows = top_rows(
        tables["table_storage_metrics"].where(F.col("table_name").isNotNull() & (held > 0)), n,
        (held + F.col("retained_for_clone_bytes")).desc(), _table_label())
    return rows.select(_table_label().alias("object_name"), _gb("active_bytes").alias("active_gb"),
                       _gb("time_travel_bytes").alias("time_travel_gb"), _gb("failsafe_bytes").alias("failsafe_gb"),
                       _gb("retained_for_clone_bytes").alias("clone_gb"), F.col("is_transient").alias("transient"))


def _attributed(tables: Tables, day: dt.date, days: int, *columns: str) -> DataFrame:
    """Recent queries with their attributed credits; credits are summed per query first."""
    q = tables["query_history"].where(_since(day, days)).select("query_id", "user_name", *columns)
    a = tables["query_attribution_history"].select("query_id", F.col("credits_attributed_compute").alias("_credits"))
    return q.join(a, "query_id")


def top_users_hidden_waste(
    tables: Tables, day: dt.date, n: int | None = None, p: Prices = Prices()
) -> DataFrame:
    """Users carrying most of the hidden waste, each with their larger of compute and AI waste."""
    per = _attributed(tables, day, 30, "warehouse_name").groupBy("user_name", "warehouse_name").agg(
        F.sum("_credits").cast("double").alias("c"))
    spend = per.groupBy("user_name").agg((F.sum("c") * p.credit).alias("tco_by_user")).where(
        F.col("tco_by_user") > 0)
    waste = hidden_waste_compute(tables, day, p).groupBy("warehouse_name").agg(F.sum("wasted_cost_usd").alias("w"))
    totals = per.groupBy("warehouse_name").agg(F.sum("c").alias("t"))
    compute = (
        per.join(totals, "warehouse_name").join(waste, "warehouse_name")
        .groupBy("user_name")
        .agg(F.sum(ratio(F.col("c"), F.nullif("t", F.lit(0.0))) * F.col("w")).alias("attributed_waste"),
             F.max_by("warehouse_name", F.struct("c", "warehouse_name")).alias("place"))
        .withColumn("service_type", F.lit("Compute")))
    parts = [compute]
    ai_total = hidden_waste_ai(tables).agg(F.sum("wasted_cost_usd").alias("w")).where(F.col("w") > 0)
    ai_users = per.where(F.col("warehouse_name").isin(*AI_QUERY_WAREHOUSES)).groupBy("user_name").agg(
        F.sum("c").alias("c"))
    grand = ai_users.agg(F.sum("c").alias("t"))
    parts.append(
        ai_users.crossJoin(broadcast_single(grand)).crossJoin(broadcast_single(ai_total)).select(
            "user_name", (ratio(F.col("c"), F.nullif("t", F.lit(0.0))) * F.col("w")).alias("attributed_waste"),
            F.lit("AI warehouses").alias("place"), F.lit("AI & ML").alias("service_type")))
    best = ranked(union_all(parts), ["user_name"],
                  [F.col("attributed_waste").desc_nulls_last(), F.col("service_type")])
    top = top_rows(best, n, F.col("attributed_waste").desc_nulls_last(), F.col("user_name"))
    comment = F.when(F.col("service_type") == "AI & ML",
                     F.concat(F.lit("Oversized model usage on "), "place")).otherwise(
        F.concat(F.lit("High idle/spill on "), "place"))
    return top.join(spend, "user_name", "left").select(
        "user_name", F.round("tco_by_user", 0).alias("tco_by_user"),
        F.round("attributed_waste", 0).alias("attributed_waste"), "service_type", comment.alias("comment"))


def tco_monthly_trend_and_forecast(
    tables: Tables, day: dt.date, p: Prices = Prices(), history: int = 6, ahead: int = 6
) -> DataFrame:
    """Complete months normalized to 30 days, then a straight line through them for the next months."""
    first, last = _month_floor(day, history), _month_floor(day)
    window = (F.col("start_time") >= _day(first)) & (F.col("start_time") < _day(last))

    def monthly(name: str, alias: str) -> DataFrame:
        return tables[name].where(window).groupBy(F.trunc(F.to_date("start_time"), "MM").alias("month")).agg(
            _credits().alias(alias))

    storage = _latest_storage(tables).select((F.round(
        (F.col("storage_bytes") + F.col("stage_bytes") + F.col("failsafe_bytes")) / _TB, 2)
        * p.storage_per_tb).alias("_storage"))
    both = monthly("warehouse_metering_history", "w").join(monthly("metering_history", "s"), "month", "full")
    total = F.coalesce("w", F.lit(0.0)) + F.coalesce("s", F.lit(0.0))
    # At most *history* rows from here on.
    actual = both.crossJoin(broadcast_single(storage)).select(
        "month", total.alias("total_credits"),
        ((total * p.credit + F.col("_storage")) * (30.0 / F.dayofmonth(F.last_day("month")))).alias("tco"),
        F.lit("Actual").alias("type"))
    numbered = actual.withColumn("_x", F.row_number().over(Window.orderBy("month")) - 1)
    line = numbered.agg(F.regr_slope("tco", "_x").alias("b"), F.regr_intercept("tco", "_x").alias("a"),
                        F.max("month").alias("m"), F.count("*").alias("n"))
    step = F.explode(F.sequence(F.lit(1), F.lit(ahead)))
    forecast = line.where(F.col("n") > 0).select("*", step.alias("i")).select(
        F.add_months("m", F.col("i")).alias("month"), F.lit(0.0).alias("total_credits"),
        F.greatest(F.col("a") + F.col("b") * (F.col("n") - 1 + F.col("i")), F.lit(0.0)).alias("tco"),
        F.lit("Forecast").alias("type"))
    return actual.unionByName(forecast)


def tco_by_month(tables: Tables, day: dt.date, p: Prices = Prices()) -> DataFrame:
    trend = tco_monthly_trend_and_forecast(tables, day, p)
    return trend.where(F.col("type") == "Actual").select("month", "tco")


def _top_then_days(daily: DataFrame, name: str, n: int | None) -> DataFrame:
    """Days of the n heaviest names, or of all without a number."""
    if n is None:
        return daily
    totals = daily.groupBy(name).agg(F.sum("daily_credits").alias("_total"))
    top = top_rows(totals, n, F.col("_total").desc(), F.col(name)).select(name)
    return daily.join(top, name, "left_semi")


def top_users_daily_credits(
    tables: Tables, day: dt.date, n: int | None = None, user_type: str = "all"
) -> DataFrame:
    name = F.col("user_name")
    service = name.endswith("_SVC") | name.isin(*SERVICE_USERS)
    rows = _attributed(tables, day, 21, "start_time").where(F.col("_credits") > 0)
    if user_type == "service":
        rows = rows.where(service)
    elif user_type == "adhoc":
        rows = rows.where(~service)
    daily = rows.groupBy("user_name", F.to_date("start_time").alias("usage_date")).agg(
        F.sum("_credits").cast("double").alias("daily_credits"))
    return _top_then_days(daily, "user_name", n)


def warehouse_daily_credits(tables: Tables, day: dt.date, n: int | None = None) -> DataFrame:
    daily = _warehouses(tables).where(_since(day, 21)).groupBy(
        "warehouse_name", F.to_date("start_time").alias("usage_date")).agg(_credits().alias("daily_credits"))
    return _top_then_days(daily, "warehouse_name", n)


def warehouse_heatmap(tables: Tables, day: dt.date, p: Prices = Prices(), n: int | None = None) -> DataFrame:
    return warehouse_daily_credits(tables, day, n).select(
        F.col("warehouse_name").alias("object_name"), F.col("usage_date").alias("date"),
        _round2(F.col("daily_credits") * p.credit).alias("cost_usd"))


def warehouse_spend_filtered(
    tables: Tables, start: str, end: str, rollup: str = "day", p: Prices = Prices()
) -> DataFrame:
    if rollup not in ("day", "week", "month", "year"):
        raise ValueError(f"unknown rollup {rollup}")
    return _warehouses(tables).where(_between_days(start, end)).groupBy(
        F.to_date(F.date_trunc(rollup, "start_time")).alias("period"), "warehouse_name"
    ).agg(*_money_columns(F.sum("credits_used"), p))


def warehouse_summary_filtered(tables: Tables, start: str, end: str, p: Prices = Prices()) -> DataFrame:
    return _warehouses(tables).where(_between_days(start, end)).groupBy("warehouse_name").agg(
        *_money_columns(F.sum("credits_used"), p))


def _load(tables: Tables, cond: Column | None = None) -> DataFrame:
    rows = tables["warehouse_load_history"]
    rows = rows if cond is None else rows.where(cond)
    return rows.groupBy("warehouse_name").agg(
        exact_avg("avg_running").alias("_running"), exact_avg("avg_queued_load").alias("_queued"))


def idle_warehouses(
    tables: Tables, start: str | None = None, end: str | None = None, p: Prices = Prices()
) -> DataFrame:
    cond = _between_days(start, end) if start and end else None
    metered = _warehouses(tables) if cond is None else _warehouses(tables).where(cond)
    spent = metered.groupBy("warehouse_name").agg(_credits().alias("_c")).where(F.col("_c") >= 10)
    running = F.coalesce("_running", F.lit(0.0))
    return spent.join(_load(tables, cond), "warehouse_name", "left").select(
        F.col("warehouse_name").alias("object_name"), *_money_columns(F.col("_c"), p),
        F.round(running, 3).alias("avg_running"),
        F.round(F.coalesce("_queued", F.lit(0.0)), 3).alias("avg_queued_load"),
        F.when((running < 0.15) & (F.col("_c") >= 100), "BLOCKER")
        .when((running < 0.30) & (F.col("_c") >= 25), "WARN").otherwise("INFO").alias("severity"))


def hidden_waste_compute(tables: Tables, day: dt.date, p: Prices = Prices()) -> DataFrame:
    """Warehouses billed while mostly idle; size from metering, else from the newest query."""
    if "hidden_waste_compute" in tables:
        return tables["hidden_waste_compute"].select(
            "warehouse_name", "waste_type", "idle_hours", "actual_cost_usd", "wasted_credits",
            "wasted_cost_usd", "recommendation", "size")
    recent = _since(day, 30)
    metering = tables["warehouse_metering_history"].where(recent)
    keys, size = ["warehouse_name"], F.lit("UNKNOWN")
    if "warehouse_size" in metering.columns:
        keys, size = ["warehouse_name", "warehouse_size"], F.coalesce("warehouse_size", F.lit("UNKNOWN"))
    spent = metering.groupBy(*keys).agg(_credits().alias("_c")).where(F.col("_c") >= 10)
    joined = spent.join(_load(tables, recent), "warehouse_name", "left")
    queries = tables.get("query_history")
    if len(keys) == 1 and queries is not None and "warehouse_size" in queries.columns:
        sizes = queries.where(recent & F.col("warehouse_size").isNotNull()).groupBy("warehouse_name").agg(
            F.max_by("warehouse_size", F.struct("start_time", "warehouse_size")).alias("_size"))
        joined, size = joined.join(sizes, "warehouse_name", "left"), F.coalesce("_size", F.lit("UNKNOWN"))
    running = F.coalesce("_running", F.lit(0.0))
    idle = running < 0.10
    wasted = F.col("_c") * F.coalesce(1 - F.col("_running"), F.lit(0.5))
    return joined.where(running < 0.50).select(
        "warehouse_name", F.when(idle, "idle_running").otherwise("oversized").alias("waste_type"),
        F.round(F.col("_c") * (1 - running), 1).alias("idle_hours"),
        _round2(F.col("_c") * p.credit).alias("actual_cost_usd"), _round2(wasted).alias("wasted_credits"),
        _round2(wasted * p.credit).alias("wasted_cost_usd"),
        F.when(idle, "Enable auto-suspend (60s); consider X-Small for dev")
        .otherwise("Scale down warehouse size; review concurrent usage").alias("recommendation"),
        size.alias("size"))


def hidden_waste_storage(tables: Tables, p: Prices = Prices(), n: int | None = None) -> DataFrame:
    if "hidden_waste_storage" in tables:
        return tables["hidden_waste_storage"].select(
            "object_name", "waste_type", "size_gb", "days_since_access", "actual_cost_usd",
            "monthly_cost_usd", "recommendation")
    kept = F.col("time_travel_bytes") + F.col("failsafe_bytes")
    rows = top_rows(tables["table_storage_metrics"].where(F.col("table_name").isNotNull() & (kept > _GB)), n,
                    kept.desc(), _table_label())
    cost = _round2(kept / _TB * p.storage_per_tb)
    return rows.select(
        _table_label().alias("object_name"),
        F.when(F.col("failsafe_bytes") > F.col("active_bytes"), "failsafe_excess")
        .when(F.col("time_travel_bytes") > F.col("active_bytes"), "time_travel_excess")
        .otherwise("stale_data").alias("waste_type"),
        _round2(kept / _GB).alias("size_gb"), F.lit(None).cast("bigint").alias("days_since_access"),
        cost.alias("monthly_cost_usd"), cost.alias("actual_cost_usd"),
        F.lit("Review data retention policy; shorten time-travel window").alias("recommendation"))


_AI_WASTE = ("waste_pattern string, function_name string, model_name string, task_type string, calls_30d bigint, "
             "actual_cost_usd double, wasted_credits double, wasted_cost_usd double, recommendation string")


def hidden_waste_ai(tables: Tables) -> DataFrame:
    spark = tables["warehouse_metering_history"].sparkSession
    empty = spark.createDataFrame([], _AI_WASTE)
    if "hidden_waste_ai" not in tables:
        return empty
    return tables["hidden_waste_ai"].select(*empty.columns)


def hidden_waste_summary(tables: Tables, day: dt.date, p: Prices = Prices()) -> DataFrame:
    def total(df: DataFrame, column: str, name: str) -> DataFrame:
        return df.agg(F.coalesce(F.sum(column), F.lit(0.0)).cast("double").alias(name))

    recent = _since(day, 30)
    frames = [
        total(hidden_waste_compute(tables, day, p), "wasted_cost_usd", "c"),
        total(hidden_waste_storage(tables, p), "monthly_cost_usd", "s"),
        total(hidden_waste_ai(tables), "wasted_cost_usd", "a"),
        total(tables["warehouse_metering_history"].where(recent), "credits_used", "w"),
        total(tables["metering_history"].where(recent), "credits_used", "m"),
    ]
    yearly = F.col("s") * 12
    whole = F.round(F.col("c") + yearly + F.col("a"), 0)
    spend = (F.col("w") + F.col("m")) * p.credit
    return _cross(frames).select(
        F.round("c", 0).alias("compute"), F.round(yearly, 0).alias("storage_annual"), F.round("a", 0).alias("ai"),
        whole.alias("total"), F.round(spend, 0).alias("spend_30d"),
        F.round(whole / F.greatest(spend, F.lit(1.0)) * 100, 1).alias("waste_pct"))


def queue_pressure(tables: Tables, start: str | None = None, end: str | None = None) -> DataFrame:
    rows = tables["query_history"].where(F.col("warehouse_name").isNotNull())
    if start and end:
        rows = rows.where(_between_days(start, end))
    queued = rows.groupBy(F.col("warehouse_name").alias("object_name")).agg(
        F.sum("queued_overload_time").alias("_q"), F.count("*").alias("queries"))
    return queued.where(F.col("_q") > 0).select(
        "object_name", F.round(F.col("_q") / 1000.0, 1).alias("queued_seconds"), "queries")


def warehouse_cost_efficiency(tables: Tables, p: Prices = Prices()) -> DataFrame:
    credits = tables["query_attribution_history"].groupBy("query_id").agg(
        F.sum("credits_attributed_compute").cast("double").alias("_c"), F.count("*").alias("_copies"))
    rows = tables["query_history"].where(
        (F.col("execution_status") == "SUCCESS") & F.col("warehouse_name").isNotNull())
    # A query attributed several times counts its bytes and cache share once per attribution row.
    copies = F.coalesce("_copies", F.lit(1))
    zero = F.lit(0)
    spill = (F.coalesce(wide(rows, "bytes_spilled_to_local_storage"), zero)
             + F.coalesce(wide(rows, "bytes_spilled_to_remote_storage"), zero))
    agg = rows.join(credits, "query_id", "left").groupBy("warehouse_name").agg(
        F.countDistinct("query_id").alias("queries"), F.sum(F.coalesce("_c", F.lit(0.0))).alias("_credits"),
        F.sum(F.coalesce(wide(rows, "bytes_scanned"), zero) * copies).alias("_scan"), F.sum(spill * copies).alias("_spill"),
        ratio(F.sum(F.coalesce("percentage_scanned_from_cache", F.lit(0.0)) * copies), F.sum(copies)).alias("_cache"))
    c = F.col("_credits")
    return agg.where(c > 0).select(
        F.col("warehouse_name").alias("object_name"), *_money_columns(c, p), "queries",
        _round2(F.col("_scan") / _TB).alias("scanned_tb"),
        _round2(ratio(c, F.nullif(F.col("_scan") / _TB, F.lit(0.0)))).alias("credits_per_tb"),
        _round2(ratio(1000 * c, F.col("queries"))).alias("credits_per_1k_queries"),
        F.round("_cache", 1).alias("avg_cache_pct"), _round2(F.col("_spill") / _GB).alias("spilled_gb"))


def query_attributed_cost(tables: Tables, n: int | None = None, p: Prices = Prices()) -> DataFrame:
    total = _credits("credits_attributed_compute")
    per = tables["query_attribution_history"].where(F.col("query_parameterized_hash").isNotNull()).groupBy(
        F.col("query_parameterized_hash").alias("object_name")).agg(
        F.count("*").alias("queries"), total.alias("_c"),
        F.sum(F.coalesce("credits_used_query_acceleration", F.lit(0))).alias("_q"), F.min("warehouse_name").alias("warehouse"))
    return top_rows(per.where(F.col("_c") >= 1), n, F.col("_c").desc(), F.col("object_name")).select(
        "object_name", "queries", *_money_columns(F.col("_c"), p), _round2(F.col("_q")).alias("qas_credits"), "warehouse")


def expensive_query_patterns(tables: Tables, n: int | None = None) -> DataFrame:
    rows = tables["query_history"].where((F.col("execution_status") == "SUCCESS") & F.col("query_hash").isNotNull())
    per = rows.groupBy(F.col("query_hash").alias("object_name")).agg(
        F.count("*").alias("queries"), F.sum(wide(rows, "bytes_scanned")).alias("_b"),
        F.sum(wide(rows, "bytes_spilled_to_remote_storage")).alias("_r"), F.max("total_elapsed_time").alias("_e"),
        F.min("warehouse_name").alias("warehouse"))
    heavy = (F.col("queries") >= 3) & ((F.col("_b") > _TB) | (F.col("_r") > 0) | (F.col("_e") > 300_000))
    return top_rows(per.where(heavy), n, F.col("_b").desc(), F.col("object_name")).select(
        "object_name", "queries", _round2(F.col("_b") / _TB).alias("tb_scanned"),
        _round2(F.col("_r") / _GB).alias("gb_remote_spill"), F.round(F.col("_e") / 1000.0, 1).alias("max_elapsed_sec"),
        "warehouse")


def cache_reuse_opportunity(tables: Tables, n: int | None = None) -> DataFrame:
    shape = F.coalesce("query_parameterized_hash", "query_hash")
    rows = tables["query_history"].where(
        (F.col("execution_status") == "SUCCESS") & (F.col("query_type") == "SELECT") & shape.isNotNull())
    per = rows.groupBy(shape.alias("object_name")).agg(
        F.count("*").alias("queries"), F.sum(wide(rows, "bytes_scanned")).alias("_b"),
        F.avg(F.coalesce("percentage_scanned_from_cache", F.lit(0.0))).alias("_c"),
        F.countDistinct("warehouse_name").alias("warehouses"))
    weak = (F.col("queries") >= 5) & (F.col("_c") < 40)
    return top_rows(per.where(weak), n, F.col("_b").desc(), F.col("object_name")).select(
        "object_name", "queries", _round2(F.col("_b") / _TB).alias("tb_scanned"),
        F.round("_c", 1).alias("avg_cache_pct"), "warehouses")


def storage_trend(tables: Tables) -> DataFrame:
    def tb(c: str, name: str) -> Column:
        return F.round(F.coalesce(F.col(c), F.lit(0)) / _TB, 3).alias(name)

    return tables["storage_usage"].select(
        F.col("usage_date").alias("date"), tb("storage_bytes", "table_tb"), tb("stage_bytes", "stage_tb"),
        tb("failsafe_bytes", "failsafe_tb"), tb("hybrid_table_storage_bytes", "hybrid_tb"),
        tb("archive_storage_cool_bytes", "archive_cool_tb"), tb("archive_storage_cold_bytes", "archive_cold_tb"))


def unattributed_spend(tables: Tables, p: Prices = Prices()) -> DataFrame:
    """Warehouses without an owner or a cost-center tag."""
    spend = _warehouses(tables).groupBy("warehouse_name").agg(_credits().alias("_c"))
    missing = F.lit("<missing>")
    if "tag_references" not in tables:
        return spend.select(F.col("warehouse_name").alias("object_name"), *_money_columns(F.col("_c"), p),
                            missing.alias("owner"), missing.alias("cost_center"))

    def tagged(*names: str) -> Column:
        return F.max(F.when(F.col("tag_name").isin(*names), F.col("tag_value")))

    tags = tables["tag_references"].where(F.col("domain") == "WAREHOUSE").groupBy(
        F.col("object_name").alias("warehouse_name")).agg(
        tagged("owner", "business_owner", "team").alias("_o"), tagged("cost_center", "costcenter").alias("_cc"))
    return spend.join(tags, "warehouse_name", "left").where(F.col("_o").isNull() | F.col("_cc").isNull()).select(
        F.col("warehouse_name").alias("object_name"), *_money_columns(F.col("_c"), p),
        F.coalesce("_o", missing).alias("owner"), F.coalesce("_cc", missing).alias("cost_center"))


def spend_by_warehouse(tables: Tables, p: Prices = Prices()) -> DataFrame:
    return _warehouses(tables).groupBy("warehouse_name").agg(*_money_columns(F.sum("credits_used"), p))


def top_warehouses_by_cost(tables: Tables, n: int | None = None, p: Prices = Prices()) -> DataFrame:
    per = _warehouses(tables).groupBy(F.col("warehouse_name").alias("object_name")).agg(_credits().alias("_c"))
    return top_rows(per.where(F.col("_c") > 0), n, F.col("_c").desc(), F.col("object_name")).select(
        "object_name", *_money_columns(F.col("_c"), p))


def spend_by_day(tables: Tables, start: str | None = None, end: str | None = None, p: Prices = Prices()) -> DataFrame:
    rows = _warehouses(tables)
    if start:
        rows = rows.where(F.col("start_time") >= F.lit(start).cast("timestamp"))
    if end:
        rows = rows.where(F.col("start_time") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp"))
    return rows.groupBy(F.to_date("start_time").alias("date")).agg(*_money_columns(F.sum("credits_used"), p))


def ai_spend_summary(tables: Tables, day: dt.date, p: Prices = Prices()) -> DataFrame:
    this_month = F.col("start_time") >= _day(_month_floor(day))
    wh = tables["warehouse_metering_history"].agg(F.round(_sum_when(
        "credits_used", this_month & F.col("warehouse_name").isin(*AI_WAREHOUSES)), 0).alias("w"))
    svc = tables["metering_history"].agg(F.round(_sum_when(
        "credits_used", this_month & F.col("service_type").isin(*AI_SERVICES)), 0).alias("s"))
    total = F.col("w") + F.col("s")
    return _cross([wh, svc]).select(total.alias("ai_credits"), F.round(total * p.credit, 0).alias("ai_cost"))


def ai_service_metering(tables: Tables, p: Prices = Prices()) -> DataFrame:
    per = tables["metering_history"].groupBy("service_type", "name").agg(
        _credits().alias("_c"), F.min("entity_type").alias("entity_type"))
    return per.where(F.col("_c") > 0).select(
        F.concat("service_type", F.lit(":"), "name").alias("object_name"), *_money_columns(F.col("_c"), p), "entity_type")


def ai_spend_by_day(tables: Tables, p: Prices = Prices()) -> DataFrame:
    return tables["metering_history"].groupBy(F.to_date("start_time").alias("date")).agg(
        *_money_columns(F.sum("credits_used"), p))


_METRICS = "array<struct<key:struct<metric:string>,value:bigint>>"


def ai_function_usage(tables: Tables, p: Prices = Prices()) -> DataFrame:
    """Calls and tokens per function and model, from flat columns or from the metrics JSON array."""
    rows = tables["cortex_ai_functions_usage_history"]
    if "calls" not in rows.columns:
        parsed = rows.withColumn("_m", F.from_json("metrics", _METRICS))

        def tokens(kind: str) -> Column:
            hits = F.filter("_m", lambda x: x["key"]["metric"] == kind)
            return F.coalesce(F.aggregate(hits, F.lit(0).cast("bigint"), lambda a, x: a + x["value"]), F.lit(0))

        rows = parsed.select("function_name", "model_name", "credits", "user_id", F.lit(1).alias("calls"),
                             tokens("input").alias("tokens_sent"), tokens("output").alias("tokens_received"))
    per = rows.groupBy("function_name", "model_name").agg(
        _credits("credits").alias("_c"), *[F.sum(c).alias(c) for c in ("calls", "tokens_sent", "tokens_received")],
        F.countDistinct("user_id").alias("users"))
    return per.where(F.col("_c") > 0).select(
        F.concat("function_name", F.lit(":"), "model_name").alias("object_name"), *_money_columns(F.col("_c"), p),
        "calls", "tokens_sent", "tokens_received", "users")


def _object_cost(rows: DataFrame, keys: list[str], p: Prices, credit: str, *extra: Column) -> DataFrame:
    per = rows.groupBy(*keys).agg(_credits(credit).alias("_c"), *extra)
    return per.where(F.col("_c") > 0)


def ai_search_daily(tables: Tables, p: Prices = Prices()) -> DataFrame:
    keys = ["database_name", "schema_name", "service_name", "consumption_type"]
    per = _object_cost(tables["cortex_search_daily_usage_history"], keys, p, "credits", F.sum("tokens").alias("tokens"))
    return per.select(F.concat_ws(".", *keys[:3]).alias("object_name"), "consumption_type",
                      *_money_columns(F.col("_c"), p), "tokens")


def serverless_optimization_spend(tables: Tables, p: Prices = Prices()) -> DataFrame:
    keys = ["database_name", "schema_name", "table_name"]
    per = _object_cost(tables["automatic_clustering_history"], keys, p, "credits_used")
    return per.select(F.concat_ws(".", *keys).alias("object_name"), F.lit("AUTOMATIC_CLUSTERING").alias("service_type"),
                      *_money_columns(F.col("_c"), p))


def serverless_task_costs(tables: Tables, p: Prices = Prices()) -> DataFrame:
    keys = ["database_name", "schema_name", "task_name"]
    per = _object_cost(tables["serverless_task_history"], keys, p, "credits_used")
    return per.select(F.concat_ws(".", *keys).alias("object_name"), *_money_columns(F.col("_c"), p))


def snowpipe_cost(tables: Tables, p: Prices = Prices()) -> DataFrame:
    def num(c: str, kind: str = "double") -> Column:
        return F.sum(F.col(c).try_cast(kind))

    per = tables["pipe_usage_history"].groupBy(F.col("pipe_name").alias("object_name")).agg(
        num("credits_used").alias("_c"), num("bytes_inserted").alias("_b"), num("files_inserted", "bigint").alias("files"))
    return per.where(F.col("_c") > 0).select(
        "object_name", *_money_columns(F.col("_c"), p), _round2(F.col("_b") / _GB).alias("gb_inserted"), "files")


def data_transfer_drivers(tables: Tables) -> DataFrame:
    keys = ["transfer_type", "source_cloud", "source_region", "target_cloud", "target_region"]
    rows = tables["data_transfer_history"]
    per = rows.groupBy(*keys).agg(F.sum(wide(rows, "bytes_transferred")).alias("_b"))
    name = F.concat("transfer_type", F.lit(":"), "source_cloud", F.lit("/"), "source_region", F.lit("->"),
                    "target_cloud", F.lit("/"), "target_region")
    return per.where(F.col("_b") > 0).select(
        name.alias("object_name"), F.round(F.col("_b") / _TB, 3).alias("tb_transferred"))


def executive_cost_trend(tables: Tables, p: Prices = Prices()) -> DataFrame:
    return tables["metering_daily_history"].groupBy(
        F.col("service_type").alias("object_name"), F.col("usage_date").alias("date")).agg(
        *_money_columns(F.sum("credits_used"), p))


def all_service_cost_profile(tables: Tables, p: Prices = Prices()) -> DataFrame:
    per = tables["metering_daily_history"].groupBy(F.col("service_type").alias("object_name")).agg(_credits().alias("_c"))
    return per.where(F.col("_c") > 0).select("object_name", *_money_columns(F.col("_c"), p))


def cost_breakdown_monthly(tables: Tables, day: dt.date, months: int = 12, p: Prices = Prices()) -> DataFrame:
    first = _month_floor(day, months)
    recent = F.col("start_time") >= _day(first)

    def monthly(name: str, category: Column) -> DataFrame:
        return tables[name].where(recent).groupBy(
            F.trunc(F.to_date("start_time"), "MM").alias("_m"), category.alias("category")).agg(
            (_credits() * p.credit).alias("cost_usd"))

    held = (F.col("storage_bytes") + F.col("stage_bytes") + F.col("failsafe_bytes")).cast("double") / _TB
    storage = tables["storage_usage"].where(F.col("usage_date") >= F.lit(first)).groupBy(
        F.trunc("usage_date", "MM").alias("_m"), F.lit("Storage").alias("category")).agg(
        (F.avg(held) * p.storage_per_tb).alias("cost_usd"))
    parts = [monthly("warehouse_metering_history", _warehouse_category()), monthly("metering_history", _category()), storage]
    return union_all(parts).groupBy(F.date_format("_m", "yyyy-MM").alias("month"), "category").agg(
        _round2(F.sum("cost_usd")).alias("cost_usd"))


def warehouse_cost_profile(tables: Tables, p: Prices = Prices()) -> DataFrame:
    spent = _warehouses(tables).groupBy("warehouse_name").agg(_credits().alias("_c")).where(F.col("_c") > 0)
    return spent.join(_load(tables), "warehouse_name", "left").select(
        F.col("warehouse_name").alias("object_name"), *_money_columns(F.col("_c"), p),
        F.round(F.coalesce("_running", F.lit(0.0)) * 100, 1).alias("avg_running_pct"),
        F.round(F.coalesce("_queued", F.lit(0.0)), 3).alias("avg_queued_load"))


def warehouse_load_profile(tables: Tables, day: dt.date, days: int = 7) -> DataFrame:
    return tables["warehouse_load_history"].where(_since(day, days)).groupBy(
        F.to_date("start_time").alias("date"), F.col("warehouse_name").alias("object_name")).agg(
        F.round(exact_avg("avg_running"), 3).alias("avg_running"),
        F.round(exact_avg("avg_queued_load"), 3).alias("avg_queued_load"))


def leaderboard_snapshot(tables: Tables, day: dt.date | None = None, p: Prices = Prices()) -> dict[str, DataFrame]:
    """Every overview frame from one set of inputs and one as-of day.

    Callers that materialize several of them should persist the shared metering views first.
    """
    day = day or resolve_as_of(tables)
    return {
        "kpi_summary": kpi_summary(tables, day, p),
        "cost_breakdown": cost_breakdown(tables, day, p),
        "ai_cost_breakdown": ai_cost_breakdown(tables, day, p),
        "serverless_cost_breakdown": serverless_cost_breakdown(tables, day, p),
        "top_tables_storage": top_tables_storage(tables),
        "top_users_hidden_waste": top_users_hidden_waste(tables, day, p=p),
        "tco_trend": tco_monthly_trend_and_forecast(tables, day, p),
        "hidden_waste_compute": hidden_waste_compute(tables, day, p),
        "hidden_waste_storage": hidden_waste_storage(tables, p),
        "hidden_waste_ai": hidden_waste_ai(tables),
        "hidden_waste_summary": hidden_waste_summary(tables, day, p),
        "ai_spend_summary": ai_spend_summary(tables, day, p),
        "cost_breakdown_monthly": cost_breakdown_monthly(tables, day, p=p),
    }
