"""Column functions and source mappings over the derived exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import coerce, labels
from tallyspark.operators import mapping, silver
from tallyspark.plans.registry import query
from tallyspark.sources import driver_tables as dt
from tallyspark.sources import export_tables
from tallyspark.sources import telemetry_tables as tt


def _export(s, f):
    return export_tables.focus_export(s, f)


def _bronze(s, f, by_files=False):
    return mapping.map_focus_to_bronze(_export(s, f), "exporter", "run-1", cost_subcategory=True, by_files=by_files)


def _count(df, *keys):
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


query("m1_nz")(lambda s, f: _count(_export(s, f), coerce.nz(F.col("BillingAccountId")).alias("account"),
                                   coerce.nz(F.col("ChargePeriodEnd")).isNull().alias("no_end"),
                                   coerce.nz(F.col("ResourceId")).isNull().alias("no_resource")))
query("m2_stringify_columns")(lambda s, f: _count(
    mapping.stringify_columns(_export(s, f).withColumn("Tags", F.from_json("Tags", "map<string,string>"))),
    "ProviderName", "BillingCurrency", "Tags"))
query("m3_map_focus_to_bronze")(lambda s, f: _bronze(s, f, by_files=True).drop("x_ingested_at", "charge_period_start", "charge_period_end"))
query("m4_coerce_vocab")(lambda s, f: _count(
    _export(s, f), coerce.charge_category(F.col("ChargeCategory")).alias("charge_category"),
    coerce.service_category(F.col("ServiceCategory")).alias("service_category"),
    coerce.pricing_category(F.col("PricingCategory")).alias("pricing_category"),
    coerce.charge_class(F.col("ChargeClass")).alias("charge_class"),
    coerce.commitment_category(F.col("CommitmentDiscountCategory")).alias("commitment_category")))
query("m5_coerce_money_and_time")(lambda s, f: _export(s, f).groupBy(
    coerce.day(F.col("ChargePeriodEnd")).alias("end_day")).agg(
    F.sum(coerce.money(F.col("BilledCost"))).alias("billed"), F.count(coerce.instant(F.col("ChargePeriodEnd"))).alias("dated")))
query("m6_valid_tags")(lambda s, f: _count(_export(s, f), coerce.valid_tags(F.col("Tags")).alias("tags")))


@query("m7_dedupe_key")
def _m7(s, f):
    # The key's 32 bytes are grouped; their 64 hexadecimal digits would take twice the room in the shuffle.
    found = _count(mapping.stringify_columns(_export(s, f)), F.unhex(mapping.dedupe_key("exporter")).alias("_bytes"))
    return found.select(F.lower(F.hex("_bytes")).alias("dedupe_key"), "n")


query("m8_dedupe_exact")(lambda s, f: _bronze(s, f).groupBy("provider_name", "charge_month").agg(
    F.count("*").alias("n"), F.sum("effective_cost").alias("cost")))


@query("m9_assert_single_currency")
def _m9(s, f):
    rows = dt.bill(s, f, ("provider_name", "billing_currency"))
    mapping.assert_single_currency(rows, "fixture", "USD")
    return _count(rows, "provider_name", "billing_currency")


_TEXT = ("service_name", "charge_category", "charge_description", "sku_id")
query("m10_classify_cost_subcategory")(lambda s, f: _count(
    dt.bill(s, f, _TEXT), "service_name", "charge_category",
    labels.cost_subcategory(*[F.col(c) for c in _TEXT]).alias("cost_subcategory")))
query("m11_compute_class")(lambda s, f: _count(
    dt.plane(s, f, "db_usage"), labels.compute_class(F.col("sku_name")).alias("compute_class"), "sku_name"))
query("m12_map_cost_explorer")(lambda s, f: mapping.map_cost_explorer(dt.plane(s, f, "ce_costs")).drop("ChargePeriodStart", "ChargePeriodEnd"))
query("m13_map_snowflake_usage")(lambda s, f: mapping.map_snowflake_usage(
    dt.plane(s, f, "sf_org_usage"), "1996-01-01", "1998-12-31").groupBy(
    "SubAccountId", "SubAccountName", "BillingPeriodStart", "BillingPeriodEnd", "ChargeCategory", "ChargeDescription",
    "ServiceCategory", "ServiceName").agg(F.sum("EffectiveCost").alias("cost"), F.sum("ConsumedQuantity").alias("quantity"),
                                          F.count("*").alias("n")))


@query("m14_map_databricks_usage")
def _m14(s, f):
    # One price per account, SKU, unit and validity; another account and another unit have their own.
    own = tt.nested_prices(s, f).where(F.col("cloud") == "AWS")
    dearer = F.struct((F.col("pricing.default") * 2).alias("default"))
    prices = own.unionByName(own.withColumn("account_id", F.lit("acc-2")).withColumn("pricing", dearer)).unionByName(
        own.withColumn("usage_unit", F.lit("GB")).withColumn("pricing", dearer))
    planes = [dt.plane(s, f, n) for n in ("db_workspaces", "db_pipelines")]
    return mapping.map_databricks_usage(
        tt.nested_usage(s, f), prices, prices, *planes, tt.nested_clusters(s, f), tt.nested_warehouses(s, f), "us-east-1",
    ).groupBy("SubAccountName", "BillingPeriodStart", "BillingCurrency", "HostProviderName", "ResourceId", "ResourceName", "ResourceType",
              "ServiceCategory", "ServiceName", "ServiceSubcategory", "SkuId", "SkuPriceDetails").agg(
        F.sum("EffectiveCost").alias("cost"), F.sum("ListCost").alias("list_cost"), F.count("*").alias("n"))


@query("m15_resolve_price_table")
def _m15(s, f):
    tt.nested_prices(s, f).createOrReplaceTempView("list_prices_view")
    prices, is_list = mapping.resolve_price_table(s, "no_such_account_prices", "list_prices_view")
    return _count(prices.withColumn("effective_is_list", F.lit(is_list)), "cloud", "effective_is_list")


@query("m16_parse_storage_url")
def _m16(s, f):
    urls = dt.plane(s, f, "uc_catalogs").select(F.coalesce("storage_root", "storage_location").alias("url"))
    return urls.select("url", *[c.alias(n) for n, c in labels.parse_storage_url(F.col("url")).items()])


query("m17_storage_location_rows")(lambda s, f: mapping.storage_location_rows(
    *[dt.plane(s, f, n) for n in ("uc_metastores", "uc_catalogs", "uc_external")], "2001-06"))
query("m18_driver_support_status")(lambda s, f: _count(
    dt.plane(s, f, "sf_sessions"), "client_application_id",
    labels.driver_support_status(F.col("client_application_id")).alias("support_status")))


@query("m19_silver_focus_normalized")
def _m19(s, f):
    lines = silver.focus_normalized(dt.bill(s, f), dt.AS_OF)
    return lines.groupBy("provider_name", "charge_day", "charge_month", "is_credit", "is_correction", "is_partial_period").agg(
        F.count("*").alias("n"), F.sum("cost").alias("cost"), F.sum("billed_cost").alias("billed_cost"))


query("m20_silver_provider_bill")(lambda s, f: silver.provider_bill(silver.focus_normalized(
    dt.bill(s, f, ("provider_name", "service_name", "effective_cost")), dt.AS_OF)).groupBy("provider_name", "service_name").agg(
    F.count("*").alias("n"), F.sum("cost").alias("cost")))
query("m21_compute_family")(lambda s, f: _count(
    dt.plane(s, f, "db_usage"), "billing_origin_product", labels.compute_family(F.col("billing_origin_product")).alias("compute_family")))
query("m22_ai_product_family")(lambda s, f: _count(
    dt.plane(s, f, "db_usage"), "billing_origin_product", labels.ai_product_family(F.col("billing_origin_product")).alias("ai_product_family")))
query("m23_fold_tag_key")(lambda s, f: _count(
    dt.bill(s, f, ("tags",)).select(F.explode(coerce.tag_map(F.col("tags"))).alias("k", "v")),
    labels.fold_tag_key(F.col("k")).alias("folded"), "k"))
query("m24_tag_lookup")(lambda s, f: _count(
    dt.bill(s, f, ("tags",)), labels.tag_lookup(coerce.tag_map(F.col("tags")), "project").alias("project"),
    labels.tag_lookup(coerce.tag_map(F.col("tags")), "cost_project").alias("cost_project")))
query("m25_extract_arn_part")(lambda s, f: _count(
    dt.bill(s, f, ("service_name", "resource_id")), "service_name", labels.bucket_of(F.col("resource_id")).alias("bucket"),
    labels.instance_of(F.col("resource_id")).alias("instance"), labels.cluster_of(F.col("resource_id")).alias("cluster")))
query("m26_identity_kind")(lambda s, f: _count(
    dt.plane(s, f, "ai_usage"), labels.folded_identity(F.col("requester")).alias("identity"),
    labels.identity_kind(labels.folded_identity(F.col("requester")), "unattributed").alias("kind")))
