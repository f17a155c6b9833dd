"""Provider-scoped spend views. Each takes the provider bill and returns one row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import labels
from tallyspark.functions.coerce import tag_map
from tallyspark.operators.frame import max_by_present, ratio, sum_if



def _net() -> Column:
    return F.sum("cost").alias("net_cost")


def _gross() -> Column:
    return sum_if(F.col("cost"), ~F.col("is_credit")).alias("gross_cost")


def _credit() -> Column:
    return sum_if(F.col("cost"), F.col("is_credit")).alias("credit_cost")


def _partial() -> Column:
    return F.bool_or("is_partial_period").alias("is_partial_period")


def _label(name: str, text: str, *fallbacks: str) -> Column:
    return F.coalesce(F.col(name), *[F.col(f) for f in fallbacks], F.lit(text)).alias(name)


def _sku() -> Column:
    return _label("sku_id", "(unknown)")


def _resource_labels() -> list[Column]:
    return [
        _label("resource_type", "(none)"),
        _label("resource_id", "(none)"),
        _label("resource_name", "(unattributed)", "resource_id"),
        _label("sub_account_id", "(none)"),
        _label("region_id", "(none)"),
    ]


def _with_currency(bill: DataFrame, keys: list[str], *flags: Column) -> DataFrame:
    """Bill totals per key. Text maxima cannot live in a hash aggregation buffer, so the charges are
    hashed down with the currency as a key first and only those few rows see the text maximum."""
    fine = bill.groupBy(*keys, "billing_currency").agg(
        _net(), _gross(), _credit(), F.sum("list_cost").alias("list_cost"), _partial(), *flags)
    names = [c for c in fine.columns if c not in (*keys, "billing_currency")]
    sums = [F.sum(c).alias(c) for c in ("net_cost", "gross_cost", "credit_cost", "list_cost")]
    other = [F.bool_or(c).alias(c) for c in names if c not in ("net_cost", "gross_cost", "credit_cost", "list_cost")]
    return fine.groupBy(*keys).agg(
        *sums, (F.sum("list_cost") - F.sum("net_cost")).alias("savings"), *other,
        F.max("billing_currency").alias("currency"))


def monthly_bill(bill: DataFrame) -> DataFrame:
    return _with_currency(bill, ["provider_name", "charge_month"])


def spend_by_service_month(bill: DataFrame) -> DataFrame:
    return _with_currency(
        bill, ["provider_name", "service_category", "service_name", "charge_month"],
        F.bool_or("x_effective_is_list").alias("effective_is_list"))


def _described(bill: DataFrame, keys: list[str], key_columns: list, sums: list[Column], unit: bool) -> DataFrame:
    """Sums per key with the heaviest charge's description, hashed down by description text first."""
    text = labels.strip_reservation_arn(F.col("charge_description")).alias("_text")
    extra = [F.col("consumed_unit").alias("_unit")] if unit else []
    fine = bill.groupBy(*key_columns, text, *extra).agg(F.max("cost").alias("_top"), *sums, _partial())
    added = [c for c in fine.columns if c not in (*keys, "_text", "_unit", "_top", "is_partial_period")]
    return fine.groupBy(*keys).agg(
        max_by_present(F.col("_text"), F.col("_top")).alias("sku_description"),
        *[F.sum(c).alias(c) for c in added],
        *([F.max("_unit").alias("consumed_unit")] if unit else []), _partial())


def spend_by_sku_month(bill: DataFrame) -> DataFrame:
    return _described(
        bill, ["provider_name", "service_name", "compute_family", "sku_id", "charge_month"],
        ["provider_name", "service_name",
         labels.compute_family(F.col("service_name")).alias("compute_family"), _sku(), "charge_month"],
        [_net(), F.sum("billed_cost").alias("billed_cost"), _gross(),
         F.sum("consumed_quantity").alias("consumed_quantity")], unit=True)


def spend_by_cost_subcategory_month(bill: DataFrame) -> DataFrame:
    return (
        bill.where(F.col("x_cost_subcategory").isNotNull())
        .groupBy("provider_name", "service_name",
                 F.col("x_cost_subcategory").alias("cost_subcategory"), "charge_month")
        .agg(_net(), _partial())
    )


def _few_share(rows: DataFrame, keys: list[str]) -> bool:
    """Whether fewer than two rows share a key on average."""
    found = rows.agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct(F.xxhash64(*keys)).alias("keys")).first()
    return 2 * found["keys"] > found["rows"]


def resource_month(bill: DataFrame, stored: bool = False) -> DataFrame:
    """Charges of a resource. They are combined by (key, text) before they move, then move once more by key. Where few charges
    share a key, that moves nearly all of them twice: they move to their key first and both steps follow there. A `stored` bill is
    measured for that."""
    keys = ["provider_name", "service_name", "compute_family", "sku_id", "resource_type", "resource_id",
            "resource_name", "sub_account_id", "region_id", "charge_month"]
    labelled = bill.select(
        "provider_name", "service_name", labels.compute_family(F.col("service_name")).alias("compute_family"), _sku(), *_resource_labels(),
        "charge_month", "charge_description", "consumed_unit", "cost", "is_credit", "is_partial_period", "consumed_quantity")
    if stored and _few_share(labelled, keys):
        labelled = labelled.repartition(*keys)
    return _described(
        labelled, keys, keys, [_net(), _gross(), F.sum("consumed_quantity").alias("consumed_quantity")], unit=True)


def redshift_cluster_cost_month(bill: DataFrame) -> DataFrame:
    return _described(
        bill.where(F.col("service_name").isin(*labels.REDSHIFT_SERVICES)),
        ["provider_name", "service_name", "cluster_id", "cost_subcategory", "sku_id", "charge_month"],
        ["provider_name", "service_name", labels.cluster_of(F.col("resource_id")).alias("cluster_id"),
         F.coalesce("x_cost_subcategory", F.lit("(unclassified)")).alias("cost_subcategory"), _sku(), "charge_month"],
        [_net(), _gross()], unit=False)


def exploded_tags(bill: DataFrame) -> DataFrame:
    """One row per (charge, tag): the base of every tag view."""
    others = [c for c in bill.columns if c != "tags"]
    return bill.select(*others, F.explode(tag_map(F.col("tags"))).alias("tag_key", "tag_value"))


def spend_by_sku_tag_month(bill: DataFrame) -> DataFrame:
    return exploded_tags(bill).groupBy(
        "provider_name", _sku(), "tag_key", "tag_value", "charge_month"
    ).agg(_net())


def spend_by_workspace_month(bill: DataFrame) -> DataFrame:
    return bill.groupBy("provider_name", _label("sub_account_id", "(none)"), "charge_month").agg(
        _net(), _gross(), _partial()
    )


def spend_by_tag_month(bill: DataFrame) -> DataFrame:
    return exploded_tags(bill).groupBy("tag_key", "tag_value", "provider_name", "charge_month").agg(
        _net(), _gross(), _partial()
    )


def _with_tag_flag(bill: DataFrame) -> DataFrame:
    return bill.withColumn("_tagged", F.size(tag_map(F.col("tags"))) > 0)


def _tag_split(zero_fill: bool) -> list[Column]:
    charge = ~F.col("is_credit")
    tagged = sum_if(F.col("cost"), charge & F.col("_tagged"))
    untagged = sum_if(F.col("cost"), charge & ~F.col("_tagged"))
    if zero_fill:
        tagged, untagged = F.coalesce(tagged, F.lit(0)), F.coalesce(untagged, F.lit(0))
    gross = sum_if(F.col("cost"), charge)
    return [
        gross.alias("gross_cost"),
        tagged.alias("tagged_cost"),
        untagged.alias("untagged_cost"),
        F.when(gross > 0, F.round(100 * ratio(tagged, gross), 1)).alias("tagged_pct"),
        _partial(),
    ]


def spend_tag_coverage_month(bill: DataFrame) -> DataFrame:
    return _with_tag_flag(bill).groupBy("provider_name", "charge_month").agg(_net(), *_tag_split(False))


def spend_untagged_by_service_month(bill: DataFrame) -> DataFrame:
    return (
        _with_tag_flag(bill)
        .groupBy("provider_name", _label("service_name", "(no service)"), "charge_month")
        .agg(*_tag_split(True))
    )


def spend_untagged_by_resource_month(bill: DataFrame) -> DataFrame:
    return (
        _with_tag_flag(bill)
        .where(~F.col("is_credit") & ~F.col("_tagged"))
        .groupBy("provider_name", _label("service_name", "(no service)"), _sku(),
                 *_resource_labels(), "charge_month")
        .agg(F.sum("cost").alias("untagged_cost"), _partial())
    )


def savings_summary_month(bill: DataFrame) -> DataFrame:
    listed, paid = F.sum("list_cost"), F.sum("cost")
    return bill.groupBy("provider_name", "charge_month").agg(
        listed.alias("list_cost"), paid.alias("effective_cost"), (listed - paid).alias("savings"),
        F.when(listed > 0, F.round(100 * ratio(listed - paid, listed), 1))
        .otherwise(0.0).alias("savings_pct"),
        F.bool_or("x_effective_is_list").alias("effective_is_list"), _partial(),
    )


def credits_month(bill: DataFrame) -> DataFrame:
    return (
        bill.where(F.col("charge_category").isin("Credit", "Adjustment"))
        .groupBy("provider_name", "charge_month", "charge_category",
                 _label("service_name", "(account-level)"),
                 _label("charge_description", "(no description)"))
        .agg(_net(), F.count("*").alias("line_count"), _partial())
    )


def spend_trend_daily(bill: DataFrame) -> DataFrame:
    return bill.groupBy("charge_day", "provider_name", "service_name").agg(_net(), _gross(), _partial())


def sku_month_over_month(bill: DataFrame) -> DataFrame:
    """Change against the SKU's previous present month, split into volume and rate effects."""
    monthly = bill.groupBy("provider_name", _sku(), "charge_month").agg(
        _net(), F.sum("consumed_quantity").alias("consumed_quantity"), _partial()
    )
    w = Window.partitionBy("provider_name", "sku_id").orderBy("charge_month")
    lagged = monthly.withColumn("prev_cost", F.lag("net_cost").over(w)).withColumn(
        "_prev_qty", F.lag("consumed_quantity").over(w)
    )
    cost, prev = F.col("net_cost"), F.col("prev_cost")
    qty, prev_qty = F.col("consumed_quantity"), F.col("_prev_qty")
    delta = cost - prev
    volume = F.when(prev_qty > 0, (qty - prev_qty) * ratio(prev, prev_qty))
    return lagged.select(
        "provider_name", "sku_id", "charge_month", "is_partial_period", "net_cost", "consumed_quantity",
        F.when(qty > 0, ratio(cost, qty)).alias("unit_rate"),
        "prev_cost",
        delta.alias("cost_delta"),
        F.when(prev > 0, F.round(100 * ratio(delta, prev), 1)).alias("cost_pct_change"),
        (qty - prev_qty).alias("qty_delta"),
        volume.alias("volume_effect"),
        F.when(prev.isNotNull(), delta.cast("double") - F.coalesce(volume, F.lit(0.0))).alias("rate_effect"),
    )


def commitment_summary_month(bill: DataFrame) -> DataFrame:
    return (
        bill.where(F.col("commitment_discount_id").isNotNull())
        .groupBy("provider_name", "charge_month", "commitment_discount_type",
                 "commitment_discount_category", "commitment_discount_status")
        .agg(F.sum("cost").alias("effective_cost"), F.sum("billed_cost").alias("billed_cost"),
             F.countDistinct("commitment_discount_id").alias("commitment_count"))
    )


def invoice_reconciliation_month(bill: DataFrame) -> DataFrame:
    return (
        bill.where(F.col("invoice_id").isNotNull())
        .groupBy("provider_name", "billing_account_id", "invoice_id", "charge_month")
        .agg(F.sum("billed_cost").alias("billed_cost"))
    )


def spend_by_tag_key_month(bill: DataFrame) -> DataFrame:
    """Charges per folded tag key with the spellings that fold into it.

    Two aggregations on one exploded scan: spelling/value grain first, then the key.
    """
    tags = exploded_tags(bill.where(~F.col("is_credit")))
    keys = ["provider_name", "charge_month", "tag_key_normalized"]
    fine = tags.groupBy(
        "provider_name", "charge_month",
        labels.fold_tag_key(F.col("tag_key")).alias("tag_key_normalized"), "tag_key", "tag_value",
    ).agg(_net())
    return fine.groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_set("tag_key")), " · ").alias("tag_key_variants"),
        F.countDistinct("tag_key").alias("variant_count"),
        F.sum("net_cost").alias("net_cost"),
        F.countDistinct("tag_value").alias("tag_value_count"),
    )


def ai_spend_month(bill: DataFrame) -> DataFrame:
    """AI product spend at resource and SKU grain, with the resource's project tag."""
    service = F.col("service_name")
    return (
        bill.where(labels.is_ai_charge(service, F.col("service_category")))
        .withColumn("_project", labels.tag_lookup(tag_map(F.col("tags")), "project"))
        .groupBy(
            "provider_name", "charge_month",
            labels.ai_product_family(service).alias("ai_product_family"), "service_name",
            _label("resource_type", "(none)"), _label("resource_id", "(none)"),
            _label("resource_name", "(unattributed)", "resource_id"), _sku(),
            _label("consumed_unit", "(unknown)"),
        )
        .agg(
            F.max("_project").alias("project_tag"), F.max("tags").alias("tags"), _net(), _gross(),
            F.sum("consumed_quantity").alias("consumed_quantity"), _partial(),
        )
    )


def spend_forecast_month(bill: DataFrame) -> DataFrame:
    """Landing estimate of the current month and a flat three-month outlook, per provider.

    The newest day is incomplete by assumption. Everything after the daily aggregate is tiny
    (days x providers), and the per-provider facts come from window aggregates over it rather
    than from joining it back to itself.
    """
    daily = bill.groupBy("provider_name", "charge_day").agg(_net())
    provider = Window.partitionBy("provider_name")
    days = daily.withColumn(
        "last_day", F.date_sub(F.max("charge_day").over(provider), 1)
    ).withColumn("charge_month", F.trunc("charge_day", "MM"))
    complete = F.col("charge_day") <= F.col("last_day")
    months = days.groupBy("provider_name", "last_day", "charge_month").agg(
        F.sum("net_cost").alias("actual"),
        sum_if(F.col("net_cost"), complete).alias("complete_cost"),
        F.sum(complete.cast("bigint")).alias("complete_days"),
    ).withColumn("anchor", F.trunc("last_day", "MM"))

    month_days = F.dayofmonth(F.last_day("anchor"))
    run_rate = months.where(F.col("charge_month") == F.col("anchor")).select(
        "provider_name", F.col("anchor").alias("charge_month"),
        F.lit("run_rate").alias("forecast_kind"),
        F.when(F.col("complete_days") > 0,
               F.round(ratio(F.col("complete_cost"), F.col("complete_days")) * month_days, 2))
        .alias("forecast_cost"),
        F.col("actual").cast("double").alias("actual_to_date"),
        F.col("complete_days").alias("history_days"),
    )

    closed = (F.col("charge_month") < F.col("anchor")) & (F.col("complete_days") > 0)
    order = Window.partitionBy("provider_name").orderBy(
        F.when(closed, F.col("charge_month")).desc_nulls_last()
    )
    used = closed & (F.col("_pos") <= 3)
    outlook = (
        months.withColumn("_pos", F.row_number().over(order))
        .groupBy("provider_name", "anchor")
        .agg(
            F.sum(used.cast("bigint")).alias("n"),
            sum_if(F.col("complete_cost"), used).alias("cost"),
            F.coalesce(sum_if(F.col("complete_days"), used), F.lit(0)).alias("history_days"),
        )
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(3))))
        .select(
            "provider_name", F.add_months("anchor", F.col("step")).alias("charge_month"),
            F.lit("trend").alias("forecast_kind"),
            F.when(F.col("n") >= 3,
                   F.greatest(F.lit(0.0), F.round(ratio(F.col("cost"), F.col("n")), 2)))
            .alias("forecast_cost"),
            F.lit(None).cast("double").alias("actual_to_date"),
            "history_days",
        )
    )
    return run_rate.unionByName(outlook)
