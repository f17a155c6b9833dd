"""Read-side analytics over findings, policies, drivers, AI usage and the turn log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.functions.coerce import tag_map
from tallyspark.functions.labels import tag_lookup
from tallyspark.operators.frame import percentiles, ratio, sum_if, union_all
from tallyspark.operators.rules import WASTE_RULES

# Entities that cannot carry a utilization reading at all.
_NO_READING = ("sql_warehouse", "sql_warehouse_user", "query_pattern")


def best_action_per_entity(findings: DataFrame, by_lens: bool = True) -> DataFrame:
    """Best priced finding per entity and month: overlapping findings are not additive."""
    keys = ["charge_month", "entity_type", "entity_id"] + (["lens"] if by_lens else [])
    cost = F.coalesce(F.col("recoverable_cost").cast("double"), F.lit(0.0))
    pick = F.struct("waste_category", "confidence", "detail", "provider_name", "entity_name",
                    *([] if by_lens else ["lens"]))
    return findings.groupBy(*keys).agg(
        F.max_by(pick, F.struct(cost, "waste_category")).alias("_best"), F.max(cost).alias("potential_savings"),
        F.count("*").alias("findings")).select(*keys, "potential_savings", "findings", "_best.*")


def action_groups(findings: DataFrame, by_lens: bool = True) -> DataFrame:
    """Action potential per month, workload kind and lane."""
    best = best_action_per_entity(findings, by_lens)
    keys = ["charge_month", "entity_type"] + (["lens"] if by_lens else [])
    return best.groupBy(*keys).agg(
        F.sum("potential_savings").alias("potential_savings"), F.count("*").alias("entities"),
        F.coalesce(sum_if(F.col("potential_savings"), F.col("confidence") == "high"), F.lit(0.0)).alias("high_confidence"))


def action_potential_by_month(findings: DataFrame, by_lens: bool = True) -> DataFrame:
    keys = ["charge_month"] + (["lens"] if by_lens else [])
    return action_groups(findings, by_lens).groupBy(*keys).agg(F.sum("potential_savings").alias("potential_savings"))


def entity_findings(findings: DataFrame) -> DataFrame:
    """All findings; only the best of each entity, lane and month carries the potential amount."""
    estimate = F.coalesce(F.col("recoverable_cost").cast("double"), F.lit(0.0))
    w = Window.partitionBy("charge_month", "entity_type", "entity_id", "lens").orderBy(
        F.col("rule_estimate").desc(), F.col("waste_category").desc())
    return findings.withColumn("rule_estimate", estimate).withColumn("_r", F.row_number().over(w)).select(
        "charge_month", "provider_name", "entity_type", "entity_id", "lens", "waste_category", "detail", "rule_estimate",
        F.when(F.col("_r") == 1, F.col("rule_estimate")).otherwise(0.0).alias("potential_savings"))


def completed_months(findings: DataFrame, as_of: str) -> DataFrame:
    return findings.where(F.col("charge_month") < F.trunc(F.lit(as_of).cast("date"), "MM")).select("charge_month").distinct()


def mom_recoverable_delta(findings: DataFrame, as_of: str) -> DataFrame:
    """Change of each lane's potential between the two newest complete months."""
    done = findings.where(F.col("charge_month") < F.trunc(F.lit(as_of).cast("date"), "MM"))
    # One row per month: ordering it globally is small.
    months = done.select("charge_month").distinct().orderBy(F.col("charge_month").desc()).limit(2)
    bounds = months.agg(F.max("charge_month").alias("_last"), F.min("charge_month").alias("_prev"),
                        F.count("*").alias("_n")).where(F.col("_n") == 2)
    potential = action_potential_by_month(done)
    joined = potential.crossJoin(F.broadcast(bounds))
    zero = F.lit(0.0)
    cur = F.coalesce(sum_if(F.col("potential_savings"), F.col("charge_month") == F.col("_last")), zero)
    prev = F.coalesce(sum_if(F.col("potential_savings"), F.col("charge_month") == F.col("_prev")), zero)
    return joined.groupBy("lens").agg(F.round(cur - prev, 2).alias("recoverable_delta"))


def measurement_coverage(entities: DataFrame) -> DataFrame:
    """Entity-months with a reading, without one by nature, and without one for lack of telemetry."""
    absent = F.col("utilization_pct").isNull()
    never = F.col("entity_type").isin(*_NO_READING)
    return entities.groupBy("provider_name", "charge_month").agg(
        F.count("*").alias("total"), F.count("utilization_pct").alias("measured"),
        F.count_if(absent & never).alias("not_applicable"), F.count_if(absent & ~never).alias("unmeasured"),
        F.coalesce(F.bool_or(F.col("utilization_pct") >= 100), F.lit(False)).alias("pegged"))


def rule_scope(spark: SparkSession) -> DataFrame:
    """Each rule with every provider and entity kind it can be evaluated for ('' means any kind)."""
    rows = [(r.category, r.lens, p, k) for r in WASTE_RULES
            for p in (r.providers or ("AWS", "Databricks", "Snowflake")) for k in (r.entity_types or ("",))]
    return spark.createDataFrame(rows, "waste_category string, lens string, provider_name string, entity_type string")


def rule_coverage(findings: DataFrame, entities: DataFrame) -> DataFrame:
    """Every in-scope rule per provider-month: fired, clean, or no data to evaluate it on."""
    scope = F.broadcast(rule_scope(findings.sparkSession))
    cost = F.coalesce(F.col("recoverable_cost").cast("double"), F.lit(0.0))
    fired = findings.groupBy("provider_name", "charge_month", "waste_category").agg(
        F.count("*").alias("n"), F.sum(cost).alias("recoverable"))
    measured = entities.select("provider_name", "charge_month", "entity_type").distinct()
    months = measured.select("provider_name", "charge_month").distinct()
    grid = months.join(scope, "provider_name")
    seen = measured.withColumn("_seen", F.lit(True))
    return (
        grid.join(fired, ["provider_name", "charge_month", "waste_category"], "left")
        .join(seen, ["provider_name", "charge_month", "entity_type"], "left")
        .select("provider_name", "charge_month", "entity_type", "waste_category", "lens",
                F.when(F.col("n").isNotNull(), "fired")
                .when((F.col("entity_type") == "") | F.col("_seen"), "clean").otherwise("no data").alias("status"),
                F.coalesce("n", F.lit(0)).alias("entities"),
                F.when(F.col("recoverable") > 0, F.col("recoverable")).alias("recoverable"))
    )


def first_seen_context(best: DataFrame, resolution: DataFrame) -> DataFrame:
    keys = ["entity_type", "entity_id", "lens"]
    first = resolution.groupBy(*keys).agg(F.min("first_seen_month").alias("first_seen_month"))
    return best.join(first, keys, "left")


def recoverable_by_provider(
    findings: DataFrame, month: str, account_waste: DataFrame | None = None
) -> DataFrame:
    """Action potential per provider for one month; AWS counts warehouse findings only.

    Known account-level waste replaces that provider's finding-based total.
    """
    warehouse = F.col("waste_category").startswith("redshift_") | F.col("entity_type").isin(
        "sql_warehouse", "sql_warehouse_user")
    rows = findings.where((F.col("charge_month") == F.lit(month).cast("date"))
                          & ((F.col("provider_name") != "AWS") | warehouse))
    keys = ["provider_name", "entity_type", "entity_id", "lens"]
    best = rows.groupBy(*keys).agg(F.max(F.coalesce(F.col("recoverable_cost").cast("double"), F.lit(0.0))).alias("_p"))
    out = best.groupBy("provider_name").agg(F.sum("_p").alias("potential_savings"))
    if account_waste is None:
        return out
    own = account_waste.where(F.col("total") != 0).select(
        F.lit("Snowflake").alias("provider_name"), F.col("total").cast("double").alias("potential_savings"))
    return union_all([out.where(F.col("provider_name") != "Snowflake"), own])


# --- drivers and policies --------------------------------------------------------------------------------
def driver_staleness(drivers: DataFrame) -> DataFrame:
    """Driver family and version against the newest seen in the same provider, cluster and family."""
    pattern = r"(?s)^(.+?)[, ]+(\d+(?:\.\d+)+)$"
    text = F.trim("client_driver")
    has = text.rlike(pattern)
    parsed = drivers.select(
        "*", F.coalesce(F.when(has, F.trim(F.regexp_extract(text, pattern, 1))).otherwise(text), F.lit("")).alias("driver_family"),
        F.coalesce(F.when(has, F.regexp_extract(text, pattern, 2)), F.lit("")).alias("driver_version"),
    ).withColumn("cluster_id", F.coalesce("cluster_id", F.lit("")))
    key = F.transform(F.split("driver_version", r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(-1)))
    parsed = parsed.withColumn("_key", F.when(F.col("driver_version") != "", key))
    # The newest version per family is a small aggregate; the rows are not shuffled into one window.
    newest = parsed.groupBy("provider_name", "cluster_id", "driver_family").agg(
        F.max_by("driver_version", "_key").alias("newest_seen_version"), F.max("_key").alias("_newest"))
    joined = parsed.join(newest, ["provider_name", "cluster_id", "driver_family"])
    return joined.withColumn(
        "status", F.when(F.col("_key").isNull() | F.col("_newest").isNull(), "unknown")
        .when(F.col("_key") < F.col("_newest"), "behind").otherwise("current")
    ).withColumn("newest_seen_version", F.coalesce("newest_seen_version", F.lit(""))).drop("_key", "_newest")


def latest_policy_status(policies: DataFrame) -> DataFrame:
    """Newest evaluation of each entity and policy."""
    others = [c for c in policies.columns if c not in ("entity_id", "policy_category")]
    row = F.struct(*others)
    return policies.groupBy("entity_id", "policy_category").agg(
        F.max_by(row, F.struct("charge_month", row)).alias("_r")).select("entity_id", "policy_category", "_r.*")


def policy_compliance(policies: DataFrame) -> DataFrame:
    status = F.col("status")
    agg = latest_policy_status(policies).groupBy("policy_category").agg(
        F.count_if(status == "non_compliant").alias("non_compliant"), F.count_if(status == "compliant").alias("compliant"),
        F.count_if(status == "not_applicable").alias("not_evaluated"))
    return agg.withColumn("compliance_pct", 100 * ratio(
        F.col("compliant"), F.nullif(F.col("compliant") + F.col("non_compliant"), F.lit(0))))


# --- AI ---------------------------------------------------------------------------------------------------
def _product() -> Column:
    return F.coalesce("ai_product_family", F.lit("Unmapped AI product")).alias("product")


def ai_by_product(spend: DataFrame) -> DataFrame:
    return spend.groupBy(_product()).agg(F.sum("net_cost").alias("net_cost"), F.countDistinct("resource_id").alias("resources"))


def ai_by_resource(spend: DataFrame) -> DataFrame:
    return spend.groupBy("resource_name", _product(), "sku_id", "consumed_unit").agg(
        F.sum("net_cost").alias("net_cost"), F.sum("consumed_quantity").alias("consumed_quantity"))


def ai_by_tag(spend: DataFrame, folded_key: str = "project") -> DataFrame:
    value = F.coalesce(F.nullif(tag_lookup(tag_map(F.col("tags")), folded_key), F.lit("")), F.lit("(untagged)"))
    return spend.groupBy(value.alias("tag_value")).agg(F.sum("net_cost").alias("net_cost"))


def token_rollup(usage: DataFrame, label: str) -> DataFrame:
    """Tokens and allocated cost per label; cost stays NULL when no row of the label had one."""
    return usage.groupBy(label).agg(
        *[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "total_tokens", "request_count", "allocated_cost")],
        F.array_join(F.array_sort(F.collect_set("cost_allocation_basis")), ", ").alias("_b"),
        F.countDistinct("cost_allocation_basis").alias("_n"),
    ).withColumn("basis", F.when(F.col("_n") == 0, "—").when(F.col("_n") == 1, F.col("_b"))
                 .otherwise(F.concat(F.lit("mixed: "), F.col("_b")))).drop("_b", "_n")


def model_economics(models: DataFrame) -> DataFrame:
    """Unit cost per model from summed cost and the tokens that cost covers, never a sum of rates."""
    priced = F.col("allocated_cost").isNotNull()
    return models.groupBy("model_name", "model_kind", "serving_mode").agg(
        F.sum("total_tokens").alias("total_tokens"), F.sum("request_count").alias("request_count"),
        F.sum("allocated_cost").alias("allocated_cost"),
        (1e6 * ratio(F.sum("allocated_cost"), F.nullif(sum_if(F.col("total_tokens"), priced), F.lit(0))))
        .alias("cost_per_million_tokens"),
        F.countDistinct("endpoint_id").alias("endpoints"))


def endpoint_findings(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("entity_type") == "endpoint").groupBy("waste_category", "lens", "confidence").agg(
        F.countDistinct("entity_id").alias("endpoints"), F.sum("recoverable_cost").alias("recoverable_cost"))


def ai_kpis(spend: DataFrame, endpoints: DataFrame) -> DataFrame:
    """AI spend, resources, untagged spend, measured tokens, and unit cost over metered endpoints."""
    left = spend.agg(
        F.sum("net_cost").cast("double").alias("ai_spend"), F.countDistinct("resource_id").alias("resources"),
        F.coalesce(sum_if(F.col("net_cost"), F.col("project_tag").isNull()), F.lit(0)).cast("double").alias("untagged_spend"))
    metered = F.col("cost_allocation_basis") == "measured_tokens"
    right = endpoints.agg(
        sum_if(F.col("total_tokens"), F.col("token_coverage_status") == "measured").alias("measured_tokens"),
        (1e6 * ratio(sum_if(F.col("net_cost"), metered), F.nullif(sum_if(F.col("total_tokens"), metered), F.lit(0))))
        .alias("cost_per_million_tokens"))
    return left.crossJoin(F.broadcast(right))


def turn_usage(turns: DataFrame) -> DataFrame:
    """Latency, outcome and answer-source statistics of the turn log, as one row."""
    timed = F.col("duration_ms").isNotNull()
    routed, sourced = F.col("route").isNotNull(), F.col("answer_source").isNotNull()
    head = turns.agg(
        F.count("*").alias("turns"), F.count_if(timed).alias("timed_turns"),
        ratio(F.count_if(timed & (F.col("outcome") == "answer")), F.nullif(F.count_if(timed), F.lit(0))).alias("answered_share"),
        ratio(F.count_if(sourced & F.col("answer_source").isin("summary_spec", "caption")), F.nullif(F.count_if(sourced), F.lit(0))).alias("without_model_share"),
        ratio(F.count_if(routed & (F.col("route") == "deterministic")), F.nullif(F.count_if(routed), F.lit(0))).alias("fast_share"),
        F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"),
        F.coalesce(F.sum("tool_call_count"), F.lit(0)).alias("tool_calls"))
    spread = percentiles(turns.where(timed), [], {
        "median_ms": ("duration_ms", 0.5), "p90_ms": ("duration_ms", 0.9), "plan_median_ms": ("plan_ms", 0.5),
        "explore_median_ms": ("explore_ms", 0.5), "execute_median_ms": ("execute_ms", 0.5),
        "synthesize_median_ms": ("synthesize_ms", 0.5)})
    return head.crossJoin(F.broadcast(spread))
