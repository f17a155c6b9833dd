"""AI token telemetry joined to the bill: endpoint, model, project and requester economics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.coerce import tag_map
from tallyspark.functions.labels import AI_CATEGORY, identity_kind, tag_lookup
from tallyspark.operators.frame import max_by_present, month_date, ratio

_ENDPOINT = ["provider_name", "endpoint_id", "charge_month"]
_TOKENS = ("input_tokens", "output_tokens", "total_tokens", "request_count", "error_request_count")


def ai_usage_typed(usage: DataFrame) -> DataFrame:
    return usage.select(
        "provider_name", month_date("charge_month").alias("charge_month"), "endpoint_id",
        "endpoint_name", "served_entity_id", "model_name", "model_version", "model_kind",
        "serving_mode", "requester", "usage_context_project", "scale_to_zero_enabled",
        "workload_size", "workload_type", "min_provisioned_throughput", "request_count",
        "error_request_count", "input_tokens", "output_tokens",
        (F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"),
        (F.col("error_input_tokens") + F.col("error_output_tokens")).alias("error_tokens"),
    )


def ai_endpoint_cost(bill: DataFrame) -> DataFrame:
    """Billed cost per endpoint-month and how its SKUs are metered."""
    sku = F.upper("sku_id")
    return (
        bill.where((F.col("service_category") == AI_CATEGORY) & F.col("resource_id").isNotNull())
        .groupBy("provider_name", F.col("resource_id").alias("endpoint_id"), "charge_month")
        .agg(
            F.sum("cost").alias("net_cost"),
            F.when(F.bool_or(sku.contains("ALL_PURPOSE")), "hourly_compute")
            .when(F.bool_or(sku.contains("MODEL_SERVING") | sku.contains("INFERENCE")),
                  "model_serving_sku")
            .otherwise("other").alias("billing_shape"),
            F.max(tag_lookup(tag_map(F.col("tags")), "project")).alias("endpoint_tag_project"),
        )
    )


def ai_endpoint_base(typed: DataFrame, cost: DataFrame) -> DataFrame:
    """Tokens and cost side by side; endpoints known to only one side are kept."""
    tokens = typed.groupBy(*_ENDPOINT).agg(
        F.max("endpoint_name").alias("_name"), F.max("serving_mode").alias("_mode"),
        F.bool_and("scale_to_zero_enabled").alias("scale_to_zero_enabled"),
        F.max("workload_type").alias("workload_type"),
        *[F.sum(c).alias(c) for c in (*_TOKENS, "error_tokens")],
        F.lit(True).alias("_measured"),
    )
    mode = F.col("_mode")
    basis = (
        F.when((mode == "pay_per_token") & F.col("billing_shape").eqNullSafe(F.lit("hourly_compute")),
               "unknown")
        .when(mode == "pay_per_token", "measured_tokens")
        .when(mode == "external", "external_passthrough")
        .when(mode.isin("provisioned_throughput", "provisioned_compute"), "unallocated")
        .otherwise("unknown")
    )
    return tokens.join(cost, _ENDPOINT, "full").select(
        "provider_name", "charge_month", "endpoint_id",
        F.coalesce("_name", F.when(F.col("billing_shape").isNotNull(), F.col("endpoint_id")))
        .alias("endpoint_name"),
        F.coalesce(mode, F.lit("unknown")).alias("serving_mode"),
        "scale_to_zero_enabled", "workload_type", "billing_shape", "endpoint_tag_project", "net_cost",
        *_TOKENS[:3], "error_tokens", *_TOKENS[3:],
        F.when(F.col("_measured"), "measured").otherwise("no_token_telemetry")
        .alias("token_coverage_status"),
        basis.alias("cost_allocation_basis"),
    )


def ai_usage_allocated(typed: DataFrame, base: DataFrame) -> DataFrame:
    """Each usage row's share of its endpoint's cost, by tokens, where tokens are what is billed."""
    facts = base.select(
        *_ENDPOINT, "cost_allocation_basis", "endpoint_tag_project",
        F.col("net_cost").alias("endpoint_net_cost"),
        F.col("total_tokens").alias("endpoint_total_tokens"),
    )
    cost = F.col("endpoint_net_cost").cast("double") * F.col("total_tokens")
    return typed.join(facts, _ENDPOINT).withColumn(
        "allocated_cost",
        F.when(F.col("cost_allocation_basis") == "measured_tokens",
               ratio(cost, F.col("endpoint_total_tokens"))),
    )


def _per_million(cost: Column, tokens: Column) -> Column:
    return F.when((F.col("cost_allocation_basis") == "measured_tokens") & (tokens > 0),
                  F.round(1e6 * ratio(cost, tokens), 4))


def endpoint_month(base: DataFrame) -> DataFrame:
    return base.select(
        "provider_name", "charge_month", "endpoint_id", "endpoint_name", "serving_mode",
        F.coalesce("workload_type", F.lit("(none)")).alias("workload_type"),
        "scale_to_zero_enabled", "cost_allocation_basis", "token_coverage_status", "net_cost",
        F.when(F.col("cost_allocation_basis") != "measured_tokens", F.col("net_cost"))
        .alias("unallocated_cost"),
        "input_tokens", "output_tokens", "total_tokens", "error_tokens", "request_count",
        "error_request_count",
        F.when(F.col("request_count") > 0,
               F.round(100 * ratio(F.col("error_request_count"), F.col("request_count")), 2))
        .alias("error_rate_pct"),
        _per_million(F.col("net_cost"), F.col("total_tokens")).alias("cost_per_million_tokens"),
    )


def _token_sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in _TOKENS] + [F.sum("allocated_cost").alias("allocated_cost")]


def _fan_counts() -> list[Column]:
    return [F.countDistinct("endpoint_id").alias("endpoint_count"),
            F.countDistinct("model_name").alias("model_count")]


def model_month(allocated: DataFrame) -> DataFrame:
    def known(name: str) -> Column:
        return F.coalesce(name, F.lit("(unknown)")).alias(name)

    return (
        allocated.groupBy("provider_name", "charge_month", "endpoint_id", "endpoint_name",
                          known("model_name"), known("model_version"), known("model_kind"),
                          "serving_mode", "cost_allocation_basis")
        .agg(*_token_sums())
        .withColumn("cost_per_million_tokens",
                    _per_million(F.col("allocated_cost"), F.col("total_tokens")))
    )


def project_month(allocated: DataFrame) -> DataFrame:
    context, tag = F.col("usage_context_project"), F.col("endpoint_tag_project")
    return allocated.groupBy(
        "provider_name", "charge_month",
        F.coalesce(context, tag, F.lit("(unattributed)")).alias("project_key"),
        F.when(context.isNotNull(), "usage_context").when(tag.isNotNull(), "endpoint_tag")
        .otherwise("none").alias("project_source"),
        "serving_mode", "cost_allocation_basis",
    ).agg(*_token_sums(), *_fan_counts())


def requester_month(allocated: DataFrame) -> DataFrame:
    raw = F.nullif(F.trim("requester"), F.lit(""))
    folded = F.lower(F.col("_raw"))
    keyed = allocated.withColumn("_raw", raw).select(
        "*", F.coalesce(folded, F.lit("(unattributed)")).alias("requester_key"),
        identity_kind(folded, "unattributed").alias("requester_kind"),
    )
    kind = F.col("requester_kind")
    return (
        keyed.groupBy("provider_name", "charge_month", "requester_key", "requester_kind",
                      "serving_mode", "cost_allocation_basis")
        .agg(max_by_present(F.col("_raw"), F.col("total_tokens")).alias("_shown"),
             *_token_sums(), *_fan_counts())
        .withColumn("requester_display",
                    F.when(kind == "service_principal",
                           F.concat(F.lit("Service principal "), F.substring("requester_key", 1, 8)))
                    .when(kind == "unattributed", "(no requester recorded)")
                    .otherwise(F.coalesce("_shown", "requester_key")))
        .drop("_shown")
    )
