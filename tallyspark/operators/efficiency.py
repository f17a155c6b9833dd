"""Waste, utilization and ownership views over efficiency records and rule findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.labels import folded_identity, identity_kind
from tallyspark.operators.frame import max_by_present, sum_if

# Which signal describes which entity, in order of preference.
_SIGNALS = {
    "job": ("max_cpu_pct", "max_mem_pct"),
    "interactive": ("max_cpu_pct", "max_mem_pct"),
    "sql_warehouse": ("cache_hit_pct",),
    "sql_warehouse_user": ("duration_share_pct",),
    "query_pattern": ("pct_runs_spilling",),
    "table": ("days_since_last_access", "stats_off_pct"),
}
_HIGHER = ("max_cpu_pct", "max_mem_pct", "cache_hit_pct")
_LOWER = ("pct_runs_spilling", "stats_off_pct", "days_since_last_access")
_UNMEASURABLE = ("sql_warehouse", "sql_warehouse_user", "query_pattern", "table", "endpoint")
# signal -> (text before, text after, digits, shown even when primary)
_SECONDARY = {
    "max_cpu_pct": ("cpu ", "%", 1, False),
    "max_mem_pct": ("mem ", "%", 1, False),
    "cache_hit_pct": ("cache hit ", "%", 1, False),
    "duration_share_pct": ("duration share ", "%", 1, False),
    "pct_runs_spilling": ("spilling ", "%", 1, False),
    "stats_off_pct": ("stats off ", "%", 1, False),
    "unsorted_pct": ("unsorted ", "%", 1, True),
    "days_since_last_access": ("idle ", "d", 0, False),
    "avg_run_seconds": ("avg run ", "s", 0, True),
    "query_count": ("", " queries", 0, True),
}
_ENTITY = ["provider_name", "charge_month", "entity_type", "entity_id"]


def waste_summary_month(waste: DataFrame) -> DataFrame:
    return waste.groupBy("charge_month", "waste_category", "lens", "confidence").agg(
        F.sum("recoverable_cost").alias("recoverable_cost"),
        F.sum("billed_cost").alias("billed_cost"),
        F.count("*").alias("entity_count"),
    )


def efficiency_entity_month(entities: DataFrame) -> DataFrame:
    """Distinct measured entities, whether or not a rule fired."""
    return entities.select(
        "provider_name", "x_source_connector", "entity_type", "entity_id", "entity_name",
        "owner_user", "utilization_pct", "activity_count", "cause_detail", "charge_month",
    ).distinct()


def waste_resolution_month(waste: DataFrame, entities: DataFrame) -> DataFrame:
    """First and last sighting of each finding, and what its entity cost the month after."""
    newest = F.broadcast(
        # One row per provider name.
        entities.groupBy("provider_name").agg(F.max("charge_month").alias("_latest"))
    )
    subject = ["provider_name", "entity_type", "entity_id"]

    def last(name: str) -> Column:
        return max_by_present(F.col(name), F.col("charge_month"))

    spans = waste.groupBy(*subject, "waste_category", "lens").agg(
        last("entity_name").alias("entity_name"),
        last("owner_user").alias("owner_user"),
        last("owner_project").alias("owner_project"),
        F.min("charge_month").alias("first_seen_month"),
        F.max("charge_month").alias("last_seen_month"),
        last("recoverable_cost").alias("recoverable_cost_at_last_seen"),
        last("billed_cost").alias("billed_cost_at_last_seen"),
    )
    monthly = entities.groupBy(*subject, F.col("charge_month").alias("_next")).agg(
        F.sum("billed_cost").alias("billed_cost_after")
    )
    resolved = F.col("last_seen_month") < F.col("_latest")
    return (
        spans.join(newest, "provider_name")
        .withColumn("_next", F.add_months("last_seen_month", 1))
        .join(monthly, [*subject, "_next"], "left")
        .select(
            *subject, "entity_name", "owner_user", "owner_project", "waste_category", "lens",
            "first_seen_month", "last_seen_month", resolved.alias("is_resolved"),
            F.when(resolved, F.col("_next")).alias("resolved_month"),
            "recoverable_cost_at_last_seen", "billed_cost_at_last_seen", "billed_cost_after",
            F.when(resolved, F.round(
                F.col("billed_cost_at_last_seen") - F.coalesce("billed_cost_after", F.lit(0)), 2))
            .alias("realized_savings"),
        )
    )


def _primary_name() -> Column:
    out = F.lit(None).cast("string")
    for kind, names in _SIGNALS.items():
        pick = F.coalesce(*[F.when(F.col(n).isNotNull(), F.lit(n)) for n in names])
        out = F.when(F.col("entity_type") == kind, pick).otherwise(out)
    return out


def _signal_value(name: Column) -> Column:
    out = F.lit(None).cast("double")
    for signal in _HIGHER + _LOWER + ("duration_share_pct",):
        out = F.when(name == signal, F.col(signal).cast("double")).otherwise(out)
    return out


def _secondary_text(primary: Column) -> Column:
    parts = []
    for signal, (before, after, digits, always) in _SECONDARY.items():
        number = F.round(F.col(signal).cast("double"), digits).cast("decimal(30,1)").cast("string")
        text = F.concat(F.lit(before), number, F.lit(after))
        parts.append(text if always else F.when(~primary.eqNullSafe(F.lit(signal)), text))
    return F.nullif(F.concat_ws(" · ", *parts), F.lit(""))


def utilization_entity_month(entities: DataFrame, waste: DataFrame) -> DataFrame:
    """Every measured entity-month with its measurement state; missing telemetry is never a verdict."""
    flags = (
        waste.groupBy(*_ENTITY)
        .agg(F.array_sort(F.collect_set("waste_category")).alias("_cats"))
        .select(*_ENTITY, F.array_join("_cats", " · ").alias("waste_categories"),
                F.array_contains("_cats", "underutilized").alias("_under"))
    )
    name = F.col("primary_signal_name")
    util = F.col("utilization_pct")
    return (
        entities.withColumn("primary_signal_name", _primary_name())
        .withColumn("native_unit", F.lower(F.trim("native_unit")))
        .join(flags, _ENTITY, "left")
        .select(
            "provider_name", "charge_month", "x_source_connector", "entity_type", "entity_id",
            "entity_name", "owner_user", "owner_project", "billed_cost", "utilization_pct",
            "activity_count", "native_quantity", "native_unit",
            F.when(F.col("native_quantity") > 0,
                   F.round(F.col("billed_cost").cast("double") / F.col("native_quantity"), 6))
            .alias("cost_per_native_unit"),
            F.when(util.isNotNull(), "measured")
            .when(F.col("entity_type").isin(*_UNMEASURABLE), "not_applicable")
            .otherwise("unmeasured").alias("measurement_status"),
            F.when(F.col("activity_count").isNotNull(), "measured").otherwise("unmeasured")
            .alias("activity_status"),
            # A reading at the ceiling says something about the meter, not about health.
            (util >= 99.5).alias("is_saturated_reading"),
            "primary_signal_name",
            _signal_value(name).alias("primary_signal_value"),
            F.when(name == "days_since_last_access", "days").when(name.isNotNull(), "pct")
            .alias("primary_signal_unit"),
            F.when(name.isin(*_HIGHER), "higher_is_better").when(name.isin(*_LOWER), "lower_is_better")
            .when(name.isNotNull(), "neutral").alias("primary_signal_direction"),
            _secondary_text(name).alias("secondary_signals"),
            F.coalesce("_under", F.lit(False)).alias("is_flagged_underutilized"),
            "waste_categories",
        )
    )


def waste_by_owner_month(waste: DataFrame) -> DataFrame:
    """Recoverable cost per owner, once by user and once by project; absent owners get a bucket."""
    def side(column: str, dimension: str) -> Column:
        return F.struct(F.lit(dimension).alias("owner_dimension"),
                        F.nullif(F.trim(F.col(column)), F.lit("")).alias("owner_raw"))

    sides = F.array(side("owner_user", "owner_user"), side("owner_project", "owner_project"))
    folded = F.lower(F.col("owner_raw"))
    is_user = F.col("owner_dimension") == "owner_user"
    keyed = waste.select("*", F.inline(sides)).select(
        "provider_name", "charge_month", "owner_dimension", "lens", "confidence", "entity_id",
        "billed_cost", "recoverable_cost", "owner_raw",
        F.coalesce(folded, F.lit("(unattributed)")).alias("owner_key"),
        F.when(is_user, identity_kind(folded, "unattributed_shared_compute"))
        .when(folded.isNull(), "unattributed").otherwise("project").alias("owner_kind"),
    )
    keys = ["provider_name", "charge_month", "owner_dimension", "lens", "owner_key", "owner_kind"]
    agg = keyed.groupBy(*keys).agg(
        max_by_present(F.col("owner_raw"), F.col("recoverable_cost")).alias("_raw"),
        F.sum("recoverable_cost").alias("recoverable_cost"),
        sum_if(F.col("recoverable_cost"), F.col("confidence") == "high")
        .alias("recoverable_cost_high_confidence"),
        F.sum("billed_cost").alias("billed_cost"),
        F.countDistinct("entity_id").alias("entity_count"),
        F.count("*").alias("finding_count"),
    )
    kind = F.col("owner_kind")
    display = (
        F.when(kind == "unattributed_shared_compute", "Unattributed (shared compute)")
        .when(kind == "unattributed", "Unattributed")
        .when(kind == "service_principal",
              F.concat(F.lit("Service principal "), F.substring("owner_key", 1, 8)))
        .otherwise(F.coalesce("_raw", "owner_key"))
    )
    return agg.withColumn("owner_display", display).drop("_raw")
