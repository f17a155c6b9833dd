"""Spend views over the bill plane; each names the bill columns it needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyspark.operators import silver, spend
from tallyspark.plans.registry import EXACT, query
from tallyspark.sources import driver_tables as dt

_CORE = ("provider_name", "service_name", "charge_period_start", "effective_cost", "charge_category")


def normalized(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return silver.focus_normalized(dt.bill(spark, sf_dir, _CORE + columns), dt.AS_OF)


def bill(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return silver.provider_bill(normalized(spark, sf_dir, *columns))


_SKU = ("sku_id", "charge_description", "consumed_quantity", "consumed_unit")
_RESOURCE = ("sku_id", "resource_type", "resource_id", "resource_name", "sub_account_id", "region_id")

VIEWS: dict[str, tuple] = {
    "g1_monthly_bill": (spend.monthly_bill, ("list_cost", "billing_currency")),
    "g2_spend_by_service_month": (
        spend.spend_by_service_month,
        ("service_category", "list_cost", "billing_currency", "x_effective_is_list")),
    "g3_spend_by_sku_month": (spend.spend_by_sku_month, _SKU + ("billed_cost",)),
    "g4_spend_by_cost_subcategory_month": (
        spend.spend_by_cost_subcategory_month, ("x_cost_subcategory",)),
    "g5_resource_month": (spend.resource_month, _SKU + _RESOURCE),
    "g6_redshift_cluster_cost_month": (
        spend.redshift_cluster_cost_month, _SKU + ("resource_id", "x_cost_subcategory")),
    "g7_spend_by_sku_tag_month": (spend.spend_by_sku_tag_month, ("sku_id", "tags")),
    "g8_spend_by_workspace_month": (spend.spend_by_workspace_month, ("sub_account_id",)),
    "g9_spend_by_tag_month": (spend.spend_by_tag_month, ("tags",)),
    "g10_spend_tag_coverage_month": (spend.spend_tag_coverage_month, ("tags",)),
    "g11_spend_untagged_by_service_month": (spend.spend_untagged_by_service_month, ("tags",)),
    "g12_spend_untagged_by_resource_month": (
        spend.spend_untagged_by_resource_month, _RESOURCE + ("tags",)),
    "g13_savings_summary_month": (
        spend.savings_summary_month, ("list_cost", "x_effective_is_list")),
    "g14_credits_month": (spend.credits_month, ("charge_description",)),
    "g15_spend_trend_daily": (spend.spend_trend_daily, ()),
    "g16_sku_month_over_month": (spend.sku_month_over_month, ("sku_id", "consumed_quantity")),
    "g17_commitment_summary_month": (
        spend.commitment_summary_month,
        ("billed_cost", "commitment_discount_id", "commitment_discount_type",
         "commitment_discount_category", "commitment_discount_status")),
    "g18_invoice_reconciliation_month": (
        spend.invoice_reconciliation_month, ("billing_account_id", "invoice_id", "billed_cost")),
    "g19_spend_by_tag_key_month": (spend.spend_by_tag_key_month, ("tags",)),
    "g20_ai_spend_month": (
        spend.ai_spend_month,
        ("service_category", "resource_type", "resource_id", "resource_name", "sku_id",
         "consumed_quantity", "consumed_unit", "tags")),
    "g21_spend_forecast_month": (spend.spend_forecast_month, ()),
}


def _register(name: str, view, columns: tuple[str, ...]) -> None:
    exact = EXACT if name == "g16_sku_month_over_month" else None
    query(name, exact)(lambda spark, sf_dir: view(bill(spark, sf_dir, *columns)))


for _name, (_view, _columns) in VIEWS.items():
    _register(_name, _view, _columns)
