"""Read-side spend analytics over published views: shares, drills, movers, forecasts, allocation.

Inputs are already aggregated (month, day or resource grain). Ranges are inclusive months.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.labels import REDSHIFT_SERVICES, fold_tag_key
from tallyspark.operators.frame import (
    broadcast_single, max_by_present, ratio, sum_if, top_rows, union_all,
)

# How finely each service's bill can be split below the resource.
TIERS = {
    "dedicated": ("JOBS", "DLT", "MODEL_SERVING", "NOTEBOOKS"),
    "shared_subgrain": ("SQL", *REDSHIFT_SERVICES),
    "shared_no_subgrain": ("ALL_PURPOSE", "INTERACTIVE", "SHARED_SERVERLESS_COMPUTE"),
}
UNALLOCATED = "Unallocated (no query telemetry)"
OTHER = "Other"


def in_range(df: DataFrame, start: str, end: str) -> DataFrame:
    return df.where(F.col("charge_month").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def _month(value: str) -> Column:
    return F.lit(value).cast("date")


def _prior(value: str) -> str:
    first = dt.date.fromisoformat(value).replace(day=1)
    return (first - dt.timedelta(days=1)).replace(day=1).isoformat()


def _at(column: str, month: str) -> Column:
    """Sum of a column in one month, zero when absent."""
    return F.coalesce(sum_if(F.col(column), F.col("charge_month") == _month(month)), F.lit(0)).cast("double")


def _pct(delta: Column, base: Column) -> Column:
    return F.when(base != 0, 100 * ratio(delta, base))


# --- attribution ---------------------------------------------------------------------------------
def service_share(services: DataFrame, start: str, end: str) -> DataFrame:
    per = in_range(services, start, end).groupBy("service_name").agg(F.sum("gross_cost").alias("gross_cost"))
    total = broadcast_single(per.agg(F.sum("gross_cost").alias("_total")))
    return per.crossJoin(total).where(F.col("gross_cost") != 0).select(
        "service_name", "gross_cost", _pct(F.col("gross_cost"), F.col("_total")).alias("share_pct"))


def resource_rank(resources: DataFrame, service: str, start: str, end: str) -> DataFrame:
    return in_range(resources, start, end).where(F.col("service_name") == service).groupBy(
        "resource_name", "resource_id", "resource_type", "sub_account_id", "region_id"
    ).agg(F.sum("gross_cost").alias("gross_cost")).orderBy(F.col("gross_cost").desc_nulls_last())


def billing_tier(service: Column) -> Column:
    out = F.lit("unclassified")
    for tier, names in TIERS.items():
        out = F.when(service.isin(*names), tier).otherwise(out)
    return out


def allocate_cost_to_users(cost: DataFrame, shares: DataFrame) -> DataFrame:
    """Monthly cost split by each user's share of the month, plus what telemetry cannot explain.

    *cost*: (charge_month, cost). *shares*: (charge_month, owner_user, share, note). The rows add
    up to the whole cost.
    """
    per_user = shares.groupBy("charge_month", "owner_user").agg(
        (F.max("share") / 100.0).alias("_share"), F.max("note").alias("note"))
    whole = F.sum("_share").over(Window.partitionBy("charge_month"))
    monthly = cost.groupBy("charge_month").agg(F.sum("cost").cast("double").alias("_cost"))
    split = per_user.withColumn("_whole", whole).join(monthly, "charge_month").withColumn(
        "_part", F.col("_cost") * ratio(F.col("_share"), F.nullif("_whole", F.lit(0.0))))
    total = monthly.agg(F.coalesce(F.sum("_cost"), F.lit(0.0)).alias("_total"))
    users = split.groupBy("owner_user").agg(F.sum("_part").alias("allocated_cost"), F.max("note").alias("note"))
    named = users.crossJoin(broadcast_single(total)).select(
        "owner_user", "allocated_cost",
        (100 * ratio(F.col("allocated_cost"), F.nullif("_total", F.lit(0.0)))).alias("duration_share_pct"), "note")
    explained = split.agg(F.coalesce(F.sum("_part"), F.lit(0.0)).alias("_known"))
    rest = total.crossJoin(broadcast_single(explained)).select(
        F.lit(UNALLOCATED).alias("owner_user"),
        F.greatest(F.lit(0.0), F.col("_total") - F.col("_known")).alias("allocated_cost"),
        F.lit(None).cast("double").alias("duration_share_pct"),
        F.lit("No measured query activity").alias("note"))
    return named.unionByName(rest)


def tag_key_rank(tag_keys: DataFrame, tags: DataFrame, start: str, end: str) -> DataFrame:
    costs = in_range(tag_keys, start, end).groupBy("tag_key_normalized").agg(
        F.array_join(F.array_sort(F.collect_set("tag_key_variants")), " · ").alias("tag_key_variants"),
        F.sum("net_cost").alias("net_cost"))
    values = in_range(tags, start, end).groupBy(fold_tag_key(F.col("tag_key")).alias("tag_key_normalized")).agg(
        F.countDistinct("tag_value").alias("tag_value_count"))
    return costs.join(values, "tag_key_normalized")


def tag_value_rank(tags: DataFrame, folded_key: str, start: str, end: str, n: int | None = None) -> DataFrame:
    per = in_range(tags, start, end).where(fold_tag_key(F.col("tag_key")) == folded_key).groupBy("tag_value").agg(
        F.sum("gross_cost").alias("net_cost"))
    return top_rows(per, n, F.col("net_cost").desc_nulls_last(), F.col("tag_value"))


def redshift_tag_rank(
    sku_tags: DataFrame, resources: DataFrame, start: str, end: str, folded_key: str | None = None, n: int | None = None
) -> DataFrame:
    """Folded tag keys of one service family's SKUs, or the top values of one key."""
    scope = resources.where(F.col("service_name").isin(*REDSHIFT_SERVICES)).select("sku_id").distinct()
    rows = in_range(sku_tags, start, end).join(scope, "sku_id", "left_semi").withColumn(
        "tag_key_normalized", fold_tag_key(F.col("tag_key")))
    if folded_key is None:
        return rows.groupBy("tag_key_normalized").agg(F.sum("net_cost").alias("net_cost"))
    per = rows.where(F.col("tag_key_normalized") == folded_key).groupBy("tag_value").agg(
        F.sum("net_cost").alias("net_cost"))
    return top_rows(per, n, F.col("net_cost").desc(), F.col("tag_value"))


# --- months and forecasts ---------------------------------------------------------------------------
def bill_months(view: DataFrame, start: str, end: str, services: tuple[str, ...] | None = None) -> DataFrame:
    """Month totals of a whole bill view, or of some services of the service view."""
    rows = in_range(view, start, end)
    if services is not None:
        rows = rows.where(F.col("service_name").isin(*services))
    return rows.groupBy("charge_month").agg(*[F.sum(c).alias(c) for c in ("net_cost", "list_cost", "savings")])


def _scoped_days(daily: DataFrame, services: tuple[str, ...]) -> DataFrame:
    """Daily charges of a scope with the forecast anchor beside them; one row per day."""
    days = daily.where(F.col("service_name").isin(*services)).groupBy("charge_day").agg(
        F.coalesce(F.sum("gross_cost"), F.lit(0)).cast("double").alias("cost"))
    newest = broadcast_single(days.agg(F.date_sub(F.max("charge_day"), 1).alias("last_day")))
    return days.crossJoin(newest).withColumn("anchor", F.trunc("last_day", "MM")).withColumn(
        "charge_month", F.trunc("charge_day", "MM"))


def scoped_run_rate(daily: DataFrame, services: tuple[str, ...]) -> DataFrame:
    done = F.col("charge_day") <= F.col("last_day")
    current = _scoped_days(daily, services).where(F.col("charge_month") == F.col("anchor"))
    agg = current.groupBy("anchor").agg(
        sum_if(F.col("cost"), done).alias("_done"), F.count_if(done).alias("history_days"),
        F.sum("cost").alias("actual_to_date"))
    return agg.where(F.col("history_days") > 0).select(
        F.col("anchor").alias("charge_month"),
        F.round(ratio(F.col("_done"), F.col("history_days")) * F.dayofmonth(F.last_day("anchor")), 2).alias("forecast_cost"),
        "actual_to_date", "history_days")


def _last_months(monthly: DataFrame, n: int = 3) -> DataFrame:
    # One row per month: a global order over it is small.
    return top_rows(monthly, n, F.col("charge_month").desc())


def scoped_forecast(daily: DataFrame, services: tuple[str, ...]) -> DataFrame:
    """Flat outlook from the last three complete months; no rows without three of them."""
    closed = _scoped_days(daily, services).where(
        (F.col("charge_day") <= F.col("last_day")) & (F.col("charge_month") < F.col("anchor")))
    monthly = closed.groupBy("anchor", "charge_month").agg(F.sum("cost").alias("cost"))
    mean = _last_months(monthly).agg(F.max("anchor").alias("anchor"), F.avg("cost").alias("c"), F.count("*").alias("n"))
    return mean.where(F.col("n") >= 3).select("*", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("i")).select(
        F.add_months("anchor", F.col("i")).alias("charge_month"),
        F.greatest(F.lit(0.0), F.round("c", 2)).alias("forecast_cost"), F.col("n").alias("history_days"))


def cap_series(df: DataFrame, series: str, value: str, k: int = 8) -> DataFrame:
    """Keep the k-1 largest series and fold the rest into 'Other'; totals are preserved."""
    totals = df.groupBy(series).agg(F.sum(value).alias("_t"))
    # k rows at most leave this ordering.
    order = Window.orderBy(F.col("_t").desc_nulls_last(), F.col(series))
    top = top_rows(totals, k + 1, F.col("_t").desc_nulls_last(), F.col(series)).withColumn("_r", F.row_number().over(order))
    many = broadcast_single(top.agg(F.count("*").alias("_n")))
    keep = top.crossJoin(many).where((F.col("_n") <= k) | (F.col("_r") < k)).select(series, F.lit(True).alias("_keep"))
    joined = df.join(F.broadcast(keep), series, "left")
    others = [c for c in df.columns if c not in (series, value)]
    return joined.groupBy(F.when(F.col("_keep"), F.col(series)).otherwise(OTHER).alias(series), *others).agg(
        F.sum(value).alias(value))


def backing_monthly(storage: DataFrame, compute: DataFrame, start: str, end: str, cost: str = "net_cost") -> DataFrame:
    """Platform-mapped infrastructure cost per month and plane."""
    parts = []
    for view, name in ((storage, "Databricks Storage"), (compute, "Databricks Compute")):
        mapped = in_range(view.where(F.col("mapping") == "databricks"), start, end)
        parts.append(mapped.groupBy("charge_month", F.lit(name).alias("service_name")).agg(F.sum(cost).alias(cost)))
    return union_all(parts)


def backing_run_rate(backing: DataFrame, month: str, history_days: int) -> DataFrame:
    """Current month's mapped cost extended over the whole month."""
    now = backing.where(F.col("charge_month") == _month(month))
    days = F.dayofmonth(F.last_day(_month(month)))
    actual = F.coalesce(F.sum("net_cost"), F.lit(0)).cast("double")
    full = F.round(actual / history_days * days, 2) if history_days > 0 else F.lit(0.0)
    return now.agg(full.alias("forecast_cost"), (actual if history_days > 0 else F.lit(0.0)).alias("actual_to_date"))


def backing_trend(backing: DataFrame, anchor: str) -> DataFrame:
    """Mean of the last three mapped months before the anchor."""
    monthly = backing.where(F.col("charge_month") < _month(anchor)).groupBy("charge_month").agg(
        F.sum("net_cost").cast("double").alias("c"))
    return _last_months(monthly).agg(F.coalesce(F.avg("c"), F.lit(0.0)).alias("forecast_addition"))


def partial_month_remainder(forecast: DataFrame, months: DataFrame, min_days: int = 3) -> DataFrame:
    """What the run rate still expects this month, per provider, once it has some days of history."""
    latest = months.groupBy("provider_name").agg(F.max("charge_month").alias("charge_month"))
    rows = forecast.where(
        (F.col("forecast_kind") == "run_rate") & (F.col("history_days") >= min_days) & F.col("actual_to_date").isNotNull())
    return rows.join(latest, ["provider_name", "charge_month"]).select(
        "provider_name", "charge_month",
        F.round(F.col("forecast_cost") - F.col("actual_to_date"), 2).alias("remainder")).where(F.col("remainder") > 0)


def spend_pivot(view: DataFrame, dimension: str, months: list[str], cost: str = "net_cost") -> DataFrame:
    """Dimension x month matrix with a total; months are given, so no extra pass finds them."""
    rows = view.where(F.col("charge_month").isin(*[dt.date.fromisoformat(m) for m in months]))
    label = F.replace(F.col(dimension), F.lit("ENTERPRISE_"), F.lit(""))
    wide = rows.groupBy(label.alias("k")).pivot("charge_month", [dt.date.fromisoformat(m) for m in months]).agg(
        F.sum(cost).cast("double"))
    filled = [F.coalesce(F.col(f"`{m}`"), F.lit(0.0)) for m in months]
    total = filled[0]
    for c in filled[1:]:
        total = total + c
    return wide.select("k", *[c.alias(f"m_{m[:7].replace('-', '_')}") for c, m in zip(filled, months)],
                       total.alias("total"))


# --- month over month --------------------------------------------------------------------------------
def resource_delta(resources: DataFrame, column: str, value: str, month: str) -> DataFrame:
    prior = _prior(month)
    rows = resources.where((F.col(column) == value) & F.col("charge_month").isin(
        dt.date.fromisoformat(month), dt.date.fromisoformat(prior)))
    agg = rows.groupBy("resource_name", "resource_type", "sub_account_id").agg(
        _at("net_cost", month).alias("cur"), _at("net_cost", prior).alias("prev"),
        _at("consumed_quantity", month).alias("cur_q"), _at("consumed_quantity", prior).alias("prev_q"),
        F.max("consumed_unit").alias("unit"))
    delta = F.col("cur") - F.col("prev")
    return agg.select("*", delta.alias("delta"), (F.col("cur_q") - F.col("prev_q")).alias("qty_delta"),
                      _pct(delta, F.col("prev")).alias("pct"))


def sku_tag_delta(sku_tags: DataFrame, skus: DataFrame, sku: str, tag_key: str, month: str) -> DataFrame:
    """Two-month split of one SKU by a tag, with the part no tag value explains."""
    prior = _prior(month)
    pair = [_at("net_cost", month).alias("cur"), _at("net_cost", prior).alias("prev")]
    tagged = sku_tags.where((F.col("sku_id") == sku) & (F.col("tag_key") == tag_key)).where(
        F.col("charge_month").isin(dt.date.fromisoformat(month), dt.date.fromisoformat(prior))).groupBy(
        F.coalesce("tag_value", F.lit("(none)")).alias("tag_value")).agg(*pair)
    whole = skus.where(F.col("sku_id") == sku).agg(*pair)
    known = tagged.agg(F.coalesce(F.sum("cur"), F.lit(0.0)).alias("_c"), F.coalesce(F.sum("prev"), F.lit(0.0)).alias("_p"))
    rest = whole.crossJoin(broadcast_single(known)).select(
        F.lit("(unattributed)").alias("tag_value"), (F.col("cur") - F.col("_c")).alias("cur"),
        (F.col("prev") - F.col("_p")).alias("prev")).where(
        (F.round("cur", 2) != 0) | (F.round("prev", 2) != 0))
    return tagged.unionByName(rest).withColumn("delta", F.col("cur") - F.col("prev"))


def mom_totals(mom: DataFrame, month: str) -> DataFrame:
    def total(c: str, name: str) -> Column:
        return F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(name)

    return mom.where(F.col("charge_month") == _month(month)).agg(
        total("net_cost", "net"), total("cost_delta", "delta"), total("volume_effect", "vol"),
        total("rate_effect", "rate"), F.count("prev_cost").alias("comparable"))


def cost_subcategory_split(view: DataFrame, start: str, end: str) -> DataFrame:
    return in_range(view, start, end).groupBy("service_name", "cost_subcategory").agg(F.sum("net_cost").alias("net_cost"))


def credits_detail(view: DataFrame, start: str, end: str) -> DataFrame:
    return in_range(view, start, end).groupBy(
        "charge_month", "charge_description", "charge_category", "service_name").agg(
        F.sum("net_cost").alias("net_cost"), F.sum("line_count").alias("line_count"))


def latest_month_movers(mom: DataFrame, end: str, as_of: str, n: int | None = None) -> DataFrame:
    """Largest SKUs of the newest complete month, with their change."""
    done = mom.where((F.col("charge_month") <= _month(end)) & (F.col("charge_month") < F.trunc(_month(as_of), "MM")))
    newest = broadcast_single(done.agg(F.max("charge_month").alias("charge_month")))
    rows = done.join(newest, "charge_month", "left_semi")
    return top_rows(rows, n, F.col("net_cost").desc(), F.col("sku_id")).select(
        "sku_id", "charge_month", "net_cost", "cost_delta", "cost_pct_change")


def sku_compare(skus: DataFrame, month: str, n: int | None = None) -> DataFrame:
    """Two-month SKU comparison straight from the SKU view."""
    prior = _prior(month)
    rows = skus.where(F.col("charge_month").isin(dt.date.fromisoformat(month), dt.date.fromisoformat(prior)))
    per = rows.groupBy("sku_id").agg(
        max_by_present(F.col("sku_description"), F.col("net_cost")).alias("sku_description"),
        _at("net_cost", month).alias("net_cost"), _at("net_cost", prior).alias("_prev"))
    delta = F.col("net_cost") - F.col("_prev")
    return top_rows(per, n, F.col("net_cost").desc(), F.col("sku_id")).select(
        "sku_id", "sku_description", "net_cost", delta.alias("cost_delta"),
        _pct(delta, F.col("_prev")).alias("cost_pct_change"))


def service_movers(services: DataFrame, month: str, cost: str = "net_cost") -> DataFrame:
    prior = _prior(month)
    rows = services.where(F.col("charge_month").isin(dt.date.fromisoformat(month), dt.date.fromisoformat(prior)))
    per = rows.groupBy("provider_name", F.col("service_name").alias("driver")).agg(
        _at(cost, month).alias("_cur"), _at(cost, prior).alias("_prev"))
    delta = F.col("_cur") - F.col("_prev")
    return per.select("provider_name", "driver", delta.alias("cost_delta"),
                      _pct(delta, F.col("_prev")).alias("cost_pct_change"))


def sku_movers(mom: DataFrame, month: str) -> DataFrame:
    return mom.where((F.col("charge_month") == _month(month)) & F.col("cost_delta").isNotNull()).select(
        "provider_name", F.replace(F.col("sku_id"), F.lit("ENTERPRISE_"), F.lit("")).alias("driver"),
        F.col("cost_delta").cast("double").alias("cost_delta"), "cost_pct_change")


def _largest(movers: DataFrame, n: int | None) -> DataFrame:
    return top_rows(movers, n, F.abs("cost_delta").desc(), F.col("provider_name"), F.col("driver"))


def cross_provider_movers(
    services: DataFrame, mom: DataFrame, month: str, n: int | None = None, exclude_credits: bool = False,
    sku_provider: str = "Databricks",
) -> DataFrame:
    """Largest absolute changes over all providers, each at its natural grain."""
    by_service = service_movers(services.where(F.col("provider_name") != sku_provider), month,
                                "gross_cost" if exclude_credits else "net_cost")
    by_sku = sku_movers(mom.where(F.col("provider_name") == sku_provider), month)
    both = by_service.withColumn("type", F.lit("Service")).unionByName(by_sku.withColumn("type", F.lit("SKU")))
    return _largest(both, n)


def spend_alert(months: DataFrame, start: str, end: str, as_of: str) -> DataFrame:
    """Per provider: window net, and the newest complete month against the one before."""
    last_complete = _prior(as_of)
    month = min(dt.date.fromisoformat(end).replace(day=1).isoformat(), last_complete)
    prior = _prior(month)
    first = dt.date.fromisoformat(start).replace(day=1).isoformat()
    window = F.col("charge_month").between(_month(first), _month(end))
    agg = months.groupBy("provider_name").agg(
        F.coalesce(sum_if(F.col("net_cost"), window), F.lit(0)).cast("double").alias("window_net"),
        _at("net_cost", month).alias("cur_net"), _at("net_cost", prior).alias("prior_net"))
    silent = F.col("window_net") == 0
    return agg.select(
        "provider_name", "window_net", F.when(~silent, _month(month)).alias("cmp_month"),
        F.when(~silent, _month(prior)).alias("prior_month"), F.when(~silent, F.col("cur_net")).alias("cur_net"),
        F.when(~silent, F.col("prior_net")).alias("prior_net"))


def alert_movers(services: DataFrame, mom: DataFrame, month: str, n: int | None = None) -> DataFrame:
    """The n largest changes of each provider."""
    from tallyspark.operators.frame import ranked

    both = service_movers(services.where(F.col("provider_name") != "Databricks"), month).unionByName(
        sku_movers(mom.where(F.col("provider_name") == "Databricks"), month))
    return ranked(both, ["provider_name"], [F.abs("cost_delta").desc(), F.col("driver")], n)


# --- one warehouse family ------------------------------------------------------------------------------
def _cluster_bucket() -> Column:
    rid = F.col("resource_id")
    return (
        F.when(rid.contains(":cluster:"), F.regexp_extract(rid, ":cluster:(.+)$", 1))
        .when(rid.contains(":snapshot:"), "(snapshot storage)").otherwise("(other Redshift resource)"))


def redshift_spend_partition(resources: DataFrame, start: str, end: str) -> DataFrame:
    """Attributable spend by cluster, snapshots and other resources, down to the SKU."""
    rows = in_range(resources, start, end).where(
        F.col("service_name").isin(*REDSHIFT_SERVICES) & (F.col("resource_id") != "(none)")
        & ~F.col("resource_id").contains(":reserved-instances/"))
    return rows.groupBy(_cluster_bucket().alias("cluster"), "sku_id").agg(
        max_by_present(F.col("sku_description"), F.col("net_cost")).alias("description"),
        F.sum("net_cost").alias("net_cost"))


def cluster_components(clusters: DataFrame, start: str, end: str) -> DataFrame:
    return in_range(clusters, start, end).groupBy("cluster_id", "cost_subcategory").agg(
        F.sum("gross_cost").alias("gross_cost")).where(F.col("gross_cost") != 0)


def component_charges(clusters: DataFrame, cluster: str, component: str, start: str, end: str) -> DataFrame:
    rows = in_range(clusters, start, end).where(
        (F.col("cluster_id") == cluster) & (F.col("cost_subcategory") == component))
    return rows.groupBy("sku_id").agg(
        max_by_present(F.col("sku_description"), F.col("gross_cost")).alias("sku_description"),
        F.sum("gross_cost").alias("gross_cost"))


def spectrum_table_cost(entities: DataFrame, start: str, end: str) -> DataFrame:
    """Tables that received an allocated scan cost, with how much of the scan was returned."""
    rows = in_range(entities, start, end).where(
        (F.col("provider_name") == "AWS") & (F.col("entity_type") == "table")
        & (F.col("spectrum_allocation_status") == "allocated"))
    return rows.select(
        F.col("entity_name").alias("external_table"), "charge_month", F.col("spectrum_scan_count").alias("scans"),
        F.col("spectrum_scanned_gb").alias("scanned_gb"), F.col("spectrum_returned_gb").alias("returned_gb"),
        F.col("spectrum_allocated_cost").alias("allocated_cost"),
        F.round(100 * ratio(F.col("spectrum_returned_gb"), F.col("spectrum_scanned_gb")), 1).alias("return_pct"),
        F.round(F.col("spectrum_allocated_cost") * 0.3, 2).alias("estimated_recovery"))


def compute_heavy_tables(inventory: DataFrame) -> DataFrame:
    """Tables with measured workload, heaviest first; external scan rows are reported elsewhere."""
    rows = inventory.where(
        ~F.col("entity_id").contains(":spectrum:") & F.col("table_weighted_exec_seconds").isNotNull())
    return rows.select(
        F.col("entity_name").alias("table_name"), "owner_user",
        F.col("table_weighted_exec_seconds").alias("weighted_exec_seconds"),
        F.col("table_compute_share_pct").alias("compute_share_pct"), F.col("table_scan_gb").alias("scan_gb"),
        F.col("activity_count").alias("query_count"), F.col("table_rows_pre_filter").alias("rows_pre_filter"),
        F.col("table_rows_returned").alias("rows_returned"),
        F.round(100 * ratio(F.col("table_rows_returned"), F.col("table_rows_pre_filter")), 1).alias("return_pct"))


def capacity_state(clusters: DataFrame) -> DataFrame:
    """Capacity verdict per cluster row; missing CPU readings never become a verdict."""
    cpu, peak = F.col("cluster_cpu_utilization_avg_pct"), F.col("cluster_cpu_utilization_max_pct")
    queue = F.col("wlm_queue_wait_ms_p95")
    spill = F.coalesce(ratio(F.col("disk_spill_query_count"), F.nullif("activity_count", F.lit(0))), F.lit(0.0))
    scaling = F.coalesce(F.col("concurrency_scaling_active_seconds").cast("double"), F.lit(0.0))
    calm = (F.coalesce(queue, F.lit(0.0)) < 1000) & (spill < 0.01)
    pressed = (F.coalesce(queue, F.lit(0.0)) >= 5000) | (spill >= 0.02) | (scaling > 0)
    return clusters.select(
        "entity_id", cpu.alias("cpu_avg"), peak.alias("cpu_max"), queue.alias("queue_p95"),
        F.when(cpu.isNull(), "Insufficient capacity telemetry")
        .when((cpu < 25) & (peak < 50) & calm, "Likely underused")
        .when((peak >= 90) & pressed, "Likely constrained")
        .otherwise("Balanced / mixed").alias("state"))


def billed_vs_instrumented_clusters(resources: DataFrame, instrumented: DataFrame) -> DataFrame:
    """Every cluster on the bill or in telemetry, and which of the two knows it."""
    billed = resources.where(
        F.col("service_name").isin(*REDSHIFT_SERVICES) & F.col("resource_id").contains(":cluster:")
    ).select(F.regexp_extract("resource_id", ":cluster:(.+)$", 1).alias("cluster_id")).distinct().withColumn(
        "_b", F.lit(True))
    seen = instrumented.select(F.col("entity_id").alias("cluster_id")).distinct().withColumn("_i", F.lit(True))
    return billed.join(seen, "cluster_id", "full").select(
        "cluster_id", F.coalesce("_b", F.lit(False)).alias("is_billed"),
        F.coalesce("_i", F.lit(False)).alias("is_instrumented"))


# --- overview ----------------------------------------------------------------------------------------------
def total_cost_of_ownership(
    months: DataFrame, storage: DataFrame, compute: DataFrame, start: str, end: str
) -> DataFrame:
    """Platform bill plus the infrastructure mapped to it, per month."""
    own = in_range(months.where(F.col("provider_name") == "Databricks"), start, end).groupBy("charge_month").agg(
        F.sum("net_cost").cast("double").alias("platform_cost"))
    infra = backing_monthly(storage, compute, start, end).groupBy("charge_month").agg(
        F.sum(F.when(F.col("service_name") == "Databricks Storage", F.col("net_cost"))).cast("double").alias("storage_cost"),
        F.sum(F.when(F.col("service_name") == "Databricks Compute", F.col("net_cost"))).cast("double").alias("compute_cost"))
    zero = F.lit(0.0)
    parts = [F.coalesce(c, zero) for c in ("platform_cost", "storage_cost", "compute_cost")]
    return own.join(infra, "charge_month", "full").select(
        "charge_month", parts[0].alias("platform_cost"), parts[1].alias("storage_cost"),
        parts[2].alias("compute_cost"), (parts[0] + parts[1] + parts[2]).alias("total_cost"))


def headline_month(months: DataFrame, start: str, end: str, as_of: str) -> DataFrame:
    """Newest complete billed month of the range."""
    cap = min(dt.date.fromisoformat(end).replace(day=1).isoformat(), _prior(as_of))
    first = dt.date.fromisoformat(start).replace(day=1).isoformat()
    return in_range(months, first, cap).agg(F.max("charge_month").alias("headline_month"))


def credits_by_provider(credits: DataFrame, month: str) -> DataFrame:
    return credits.where(F.col("charge_month") == _month(month)).groupBy("provider_name").agg(
        F.sum("net_cost").alias("credits")).where(F.col("credits") != 0)


def provider_history(
    months: DataFrame, storage: DataFrame, compute: DataFrame, start: str, end: str, as_of: str,
    account_tco: DataFrame | None = None,
) -> DataFrame:
    """Monthly charges per provider, infrastructure counted with the platform that uses it.

    Where account-level ownership cost is known it replaces that provider's bill.
    """
    cap = min(dt.date.fromisoformat(end).replace(day=1).isoformat(), _prior(as_of))
    first = dt.date.fromisoformat(start).replace(day=1).isoformat()
    own = in_range(months, first, cap).select("charge_month", "provider_name", F.col("gross_cost").cast("double").alias("cost"))
    infra = backing_monthly(storage, compute, first, cap, "gross_cost").select(
        "charge_month", F.lit("Databricks").alias("provider_name"), F.col("gross_cost").cast("double").alias("cost"))
    parts = [own, infra]
    if account_tco is not None:
        parts[0] = own.where(F.col("provider_name") != "Snowflake")
        parts.append(account_tco.where(F.col("month").between(_month(start), _month(end))).select(
            F.col("month").alias("charge_month"), F.lit("Snowflake").alias("provider_name"), F.col("tco").alias("cost")))
    out = union_all(parts).groupBy("charge_month", "provider_name").agg(F.sum("cost").alias("cost"))
    return out.where(F.abs("cost") > 1e-9)


def home_movers(
    movers: DataFrame, storage: DataFrame, compute: DataFrame, month: str, n: int | None = None,
    account_compute: DataFrame | None = None,
) -> DataFrame:
    """Largest movers with mapped infrastructure as its own drivers; one slot kept for account compute."""
    prior = _prior(month)
    parts = [movers if account_compute is None else movers.where(F.col("provider_name") != "Snowflake")]

    def delta_row(rows: DataFrame, cost: str, provider: str, driver: str, kind: str) -> DataFrame:
        pair = rows.agg(_at(cost, month).alias("_c"), _at(cost, prior).alias("_p"))
        delta = F.col("_c") - F.col("_p")
        return pair.where(F.abs(delta) > 1e-9).select(
            F.lit(provider).alias("provider_name"), F.lit(driver).alias("driver"), delta.alias("cost_delta"),
            F.round(_pct(delta, F.col("_p")), 1).alias("cost_pct_change"), F.lit(kind).alias("type"))

    for view, kind in ((storage, "Storage"), (compute, "Compute")):
        mapped = view.where(F.col("mapping") == "databricks")
        parts.append(delta_row(mapped, "gross_cost", "Databricks", f"Databricks {kind}", kind))
    if account_compute is None:
        return _largest(union_all(parts), n)
    reserved = delta_row(account_compute, "cost", "Snowflake", "Compute", "Compute")
    return _largest(union_all(parts), None if n is None else n - 1).unionByName(reserved)


def managed_clusters(compute: DataFrame) -> DataFrame:
    return compute.where(F.col("mapping") == "databricks").groupBy("cluster_id", "cluster_name", "owner_user").agg(
        F.sum("net_cost").alias("net_cost"), F.countDistinct("instance_id").alias("instance_count"))


def pricing_trend(compute: DataFrame) -> DataFrame:
    return compute.where(F.col("mapping") == "databricks").groupBy("charge_month", "pricing_category").agg(
        F.sum("net_cost").alias("net_cost"))


def managed_storage(storage: DataFrame) -> DataFrame:
    return storage.where(F.col("mapping") == "databricks").groupBy(
        "bucket_name", "managed_name", "managed_kind", "mapping_confidence").agg(F.sum("net_cost").alias("net_cost"))


def subcategory_trend(storage: DataFrame) -> DataFrame:
    return storage.where(F.col("mapping") == "databricks").groupBy("charge_month", "cost_subcategory").agg(
        F.sum("net_cost").alias("net_cost"))
