"""Cloud storage and compute cost mapped to the platform objects that use it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.labels import EC2_SERVICE, S3_SERVICE, bucket_of, instance_of
from tallyspark.operators.frame import broadcast_single, month_date, sum_if


def driver_health(drivers: DataFrame) -> DataFrame:
    return drivers.select(
        "provider_name", month_date("charge_month").alias("charge_month"), "client_driver",
        "client_application", "executed_by", "cluster_id", "query_count", "support_status",
    )


def storage_location(locations: DataFrame) -> DataFrame:
    return locations.select(
        F.col("provider_name").alias("platform_provider_name"),
        month_date("snapshot_month").alias("snapshot_month"), "location_kind", "location_name", "url",
        "scheme", "cloud_provider_name", "bucket_name",
        F.coalesce("key_prefix", F.lit("(bucket root)")).alias("key_prefix"), "is_read_only",
        "credential_name", "x_source_connector",
    )


def compute_instance(instances: DataFrame) -> DataFrame:
    return instances.select(
        F.col("provider_name").alias("platform_provider_name"),
        month_date("charge_month").alias("charge_month"), "cluster_id", "cluster_name", "owner_user",
        "instance_id", "is_driver", "node_type", "x_source_connector",
    )


def _measures() -> list[Column]:
    return [
        F.sum("cost").alias("net_cost"),
        sum_if(F.col("cost"), ~F.col("is_credit")).alias("gross_cost"),
        F.bool_or("is_partial_period").alias("is_partial_period"),
    ]


def _mapping(own_id: str, mapped: str) -> Column:
    return (
        F.when(F.col(own_id).isNull(), "no_resource_id")
        .when(F.col(mapped), "databricks")
        .otherwise("unmapped")
    )


def bucket_map(locations: DataFrame) -> DataFrame:
    """Newest snapshot folded to one row per bucket, so a shared bucket never fans out cost."""
    newest = broadcast_single(locations.agg(F.max("snapshot_month").alias("snapshot_month")))
    kinds = F.col("location_kind")
    root = F.bool_or(kinds == "metastore_root")
    names = F.countDistinct("location_name")
    return (
        locations.join(newest, "snapshot_month", "left_semi")
        .where((F.col("cloud_provider_name") == "AWS") & F.col("bucket_name").isNotNull()
               & kinds.isin("metastore_root", "catalog"))
        .groupBy("bucket_name")
        .agg(
            F.min("provider_name").alias("platform_provider_name"),
            F.bool_or(F.col("key_prefix").isNull()).alias("_has_root"),
            F.count("*").alias("location_count"),
            F.when(root, F.min(F.when(kinds == "metastore_root", F.col("location_name"))))
            .when(names == 1, F.min("location_name"))
            .otherwise(F.concat(F.lit("(shared by "), names.cast("string"), F.lit(" catalogs)")))
            .alias("managed_name"),
            F.when(root, "metastore_root").otherwise("catalog").alias("managed_kind"),
        )
        .withColumn("_mapped", F.lit(True))
    )


def backing_storage_month(normalized: DataFrame, locations: DataFrame) -> DataFrame:
    """Storage cost per bucket, labelled with the catalogs that live in it.

    Cost is aggregated to the bucket first, so the join sees one row per bucket, label and month
    instead of one per charge.
    """
    cost = (
        normalized.where((F.col("provider_name") == "AWS") & (F.col("service_name") == S3_SERVICE))
        .groupBy(
            "provider_name", "service_name", bucket_of(F.col("resource_id")).alias("bucket_name"),
            F.coalesce("x_cost_subcategory", F.lit("(unclassified)")).alias("cost_subcategory"),
            F.coalesce("region_id", F.lit("(none)")).alias("region_id"), "charge_month",
        )
        .agg(*_measures())
    )
    mapped = F.col("_mapped")
    return cost.join(bucket_map(locations), "bucket_name", "left").select(
        F.col("provider_name").alias("billing_provider_name"),
        F.when(mapped, "Databricks Storage").otherwise(F.col("service_name")).alias("service_name"),
        F.coalesce("bucket_name", F.lit("(no resource id)")).alias("bucket_name"),
        _mapping("bucket_name", "_mapped").alias("mapping"),
        "platform_provider_name",
        F.coalesce("managed_name", F.lit("(not managed)")).alias("managed_name"),
        F.coalesce("managed_kind", F.lit("n/a")).alias("managed_kind"),
        F.when(mapped.isNull(), "n/a").when(F.col("_has_root"), "whole_bucket")
        .otherwise("prefix_scoped").alias("mapping_confidence"),
        "cost_subcategory", "region_id", "charge_month",
        F.coalesce("location_count", F.lit(0)).alias("location_count"),
        "net_cost", "gross_cost", "is_partial_period",
    )


def instance_map(instances: DataFrame) -> DataFrame:
    """One row per (instance, month); conflicting facts resolve to the smallest value."""
    facts = ("provider_name", "cluster_id", "cluster_name", "owner_user", "is_driver", "node_type")
    return instances.groupBy("instance_id", month_date("charge_month").alias("charge_month")).agg(
        *[F.min(c).alias(f"_{c}") for c in facts], F.count("*").alias("mapping_row_count"),
        F.lit(True).alias("_mapped"),
    )


def backing_compute_month(normalized: DataFrame, instances: DataFrame) -> DataFrame:
    """Instance cost labelled with the cluster that ran on it that month.

    Cost is aggregated to the instance-month first; both join sides are keyed the same way.
    """
    cost = (
        normalized.where((F.col("provider_name") == "AWS") & (F.col("service_name") == EC2_SERVICE))
        .groupBy(
            "provider_name", "service_name",
            instance_of(F.col("resource_id")).alias("instance_id"),
            F.coalesce("region_id", F.lit("(none)")).alias("region_id"),
            F.coalesce("pricing_category", F.lit("(unknown)")).alias("pricing_category"), "charge_month",
        )
        .agg(*_measures())
    )
    joined = cost.join(instance_map(instances), ["instance_id", "charge_month"], "left")
    cluster, driver = F.col("_cluster_id"), F.col("_is_driver")
    labelled = joined.select(
        F.col("provider_name").alias("billing_provider_name"),
        F.when(F.col("_mapped"), "Databricks Compute").otherwise(F.col("service_name")).alias("service_name"),
        F.coalesce("instance_id", F.lit("(no resource id)")).alias("instance_id"),
        _mapping("instance_id", "_mapped").alias("mapping"),
        F.col("_provider_name").alias("platform_provider_name"),
        F.coalesce(cluster, F.lit("(not managed)")).alias("cluster_id"),
        F.coalesce(F.col("_cluster_name"), cluster, F.lit("(not managed)")).alias("cluster_name"),
        F.coalesce(F.col("_owner_user"), F.when(cluster.isNotNull(), "(unknown)")).alias("owner_user"),
        F.when(driver, "driver").when(~driver, "worker").otherwise("n/a").alias("instance_role"),
        F.coalesce(F.col("_node_type"), F.lit("(not managed)")).alias("node_type"),
        "region_id", "pricing_category", "charge_month",
        F.coalesce("mapping_row_count", F.lit(0)).alias("mapping_row_count"),
        "net_cost", "gross_cost", "is_partial_period",
    )
    return labelled
