"""Waste, policy, AI and backing-cost views over the derived planes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators import ai, backing, efficiency, rules
from tallyspark.plans.registry import query
from tallyspark.plans.spend_queries import bill, normalized
from tallyspark.sources import driver_tables as dt


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.unpack_cause_detail(dt.efficiency(spark, sf_dir))


def waste(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.waste_record(entities(spark, sf_dir))


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.policy_record(entities(spark, sf_dir), dt.plane(spark, sf_dir, "policy_config"))


@query("m27_unpack_cause_detail")
def _m27(spark, sf_dir):
    return entities(spark, sf_dir).drop("cause_detail")


@query("g30_waste_record")
def _g30(spark, sf_dir):
    return waste(spark, sf_dir)


def _register_rule(number: int, rule: rules.WasteRule) -> None:
    @query(f"w{number}_{rule.category}")
    def _one(spark, sf_dir):
        return rules.waste_record(entities(spark, sf_dir), rules=(rule,))


for _i, _rule in enumerate(rules.WASTE_RULES, 1):
    _register_rule(_i, _rule)


@query("g31_waste_summary_month")
def _g31(spark, sf_dir):
    return efficiency.waste_summary_month(waste(spark, sf_dir))


@query("g32_efficiency_entity_month")
def _g32(spark, sf_dir):
    return efficiency.efficiency_entity_month(entities(spark, sf_dir))


@query("g33_waste_resolution_month")
def _g33(spark, sf_dir):
    records = entities(spark, sf_dir)
    return efficiency.waste_resolution_month(rules.waste_record(records), records)


@query("g34_utilization_entity_month", {"cost_per_native_unit": 6})
def _g34(spark, sf_dir):
    records = entities(spark, sf_dir)
    return efficiency.utilization_entity_month(records, rules.waste_record(records))


@query("g35_waste_by_owner_month")
def _g35(spark, sf_dir):
    return efficiency.waste_by_owner_month(waste(spark, sf_dir))


@query("g36_driver_health")
def _g36(spark, sf_dir):
    return backing.driver_health(dt.plane(spark, sf_dir, "driver_health"))


@query("g37_storage_location")
def _g37(spark, sf_dir):
    return backing.storage_location(dt.plane(spark, sf_dir, "storage_location"))


def backing_storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = normalized(spark, sf_dir, "resource_id", "region_id", "x_cost_subcategory")
    return backing.backing_storage_month(lines, dt.plane(spark, sf_dir, "storage_location"))


def backing_compute(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = normalized(spark, sf_dir, "resource_id", "region_id", "pricing_category")
    return backing.backing_compute_month(lines, dt.plane(spark, sf_dir, "compute_instance"))


@query("g38_backing_storage_month")
def _g38(spark, sf_dir):
    return backing_storage(spark, sf_dir)


@query("g39_compute_instance")
def _g39(spark, sf_dir):
    return backing.compute_instance(dt.plane(spark, sf_dir, "compute_instance"))


@query("g40_backing_compute_month")
def _g40(spark, sf_dir):
    return backing_compute(spark, sf_dir)


@query("g41_policy_record")
def _g41(spark, sf_dir):
    return policies(spark, sf_dir)


def _register_policy(number: int, category: str) -> None:
    @query(f"p{number}_{category}")
    def _one(spark, sf_dir):
        return policies(spark, sf_dir).where(F.col("policy_category") == category)


for _i, _policy in enumerate(rules.POLICY_RULES + rules.SNAPSHOT_POLICY_RULES, 1):
    _register_policy(_i, _policy.category)


@query("g42_policy_summary_month")
def _g42(spark, sf_dir):
    return rules.policy_summary_month(policies(spark, sf_dir))


def ai_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ai.ai_usage_typed(dt.plane(spark, sf_dir, "ai_usage"))


def ai_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ai.ai_endpoint_cost(
        bill(spark, sf_dir, "service_category", "resource_id", "sku_id", "tags"))


def ai_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ai.ai_endpoint_base(ai_typed(spark, sf_dir), ai_cost(spark, sf_dir))


def ai_allocated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ai.ai_usage_allocated(ai_typed(spark, sf_dir), ai_base(spark, sf_dir))


for _name, _source, _view in (
    ("g43_ai_usage_typed", ai_typed, None),
    ("g44_ai_endpoint_cost", ai_cost, None),
    ("g45_ai_endpoint_base", ai_base, None),
    ("g46_ai_usage_allocated", ai_allocated, None),
    ("g47_endpoint_month", ai_base, ai.endpoint_month),
    ("g48_model_month", ai_allocated, ai.model_month),
    ("g49_project_month", ai_allocated, ai.project_month),
    ("g50_requester_month", ai_allocated, ai.requester_month),
):
    def _run(spark, sf_dir, source=_source, view=_view):
        frame = source(spark, sf_dir)
        return view(frame) if view else frame

    query(_name)(_run)
