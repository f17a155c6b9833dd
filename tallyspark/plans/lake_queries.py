"""Scans, sinks and the catalog, each run over whole derived tables written to the work folder."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from tallyspark import schemas
from tallyspark.functions import labels  # noqa: F401
from tallyspark.operators import efficiency, rules, silver, spend
from tallyspark.plans import catalog
from tallyspark.plans import plane_queries as planes
from tallyspark.plans.registry import query
from tallyspark.plans.spend_queries import bill
from tallyspark.sinks import lake
from tallyspark.sinks.files import work_folder
from tallyspark.sources import account_usage_tables as au_src
from tallyspark.sources import driver_tables as dt
from tallyspark.sources import export_tables  # noqa: F401  (adds its planes)
from tallyspark.sources import scans
from tallyspark.sources import telemetry_tables  # noqa: F401  (adds its planes)

_EXPORT = ("ProviderName string, ServiceName string, ChargePeriodStart timestamp, EffectiveCost decimal(20,6)")


@query("b1_scan_bill_export")
def _b1(s, f):
    root = work_folder(s, "export")
    rows = dt.plane(s, f, "focus_export").select(
        "ProviderName", "ServiceName", F.col("ChargePeriodStart").cast("timestamp").alias("ChargePeriodStart"),
        F.col("EffectiveCost").cast("decimal(20,6)").alias("EffectiveCost"))
    parts = [f"{root}/part={i}" for i in range(2)]
    rows.where(F.col("ServiceName").startswith("A")).write.parquet(parts[0])
    rows.where(~F.col("ServiceName").startswith("A")).withColumn("Extra", F.lit(1)).write.parquet(parts[1])
    out = scans.scan_bill_export(s, parts, "1996-01-01", "1998-12-31", ["Amazon Redshift", "SQL"])
    return out.groupBy("ProviderName", "ServiceName", "Extra").agg(F.count("*").alias("n"), F.sum("EffectiveCost").alias("cost"))


query("b2_resolve_manifest_files")(lambda s, f: scans.resolve_manifest_files(
    dt.plane(s, f, "manifests"), "bkt", "1996-02-10", "1997-05-20"))


@query("b3_scan_csv_chunks")
def _b3(s, f):
    root = work_folder(s, "csv")
    usage = dt.plane(s, f, "db_usage").select("record_id", "sku_name", "cloud", "usage_quantity")
    usage.write.csv(root)
    rows = scans.scan_csv_chunks(s, [root], ["record_id", "sku_name", "cloud", "usage_quantity"])
    return rows.groupBy("sku_name", "cloud").agg(
        F.count("*").alias("n"), F.sum(F.col("usage_quantity").cast("double")).alias("quantity"))


def _bill_key():
    """Hash over every bill column but those that name the load; NULL and empty differ, and no value runs into the next."""
    columns = [c for c in schemas.BILL.names if c not in ("dedupe_key", "ingest_run_id", "x_ingested_at")]
    return F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in columns])), 256)


def _keyed_bill(s, f):
    """The bill with its key. Its rules are derived outside the loop of the joins, which the JVM would not compile with them."""
    return dt.in_short_methods(dt.bill(s, f), "service_name").withColumn("dedupe_key", _bill_key())


def _bronze(s, f, connectors=("aws", "databricks", "snowflake")):
    root = work_folder(s, "bill")
    # Each connector's window is derived from its own lines: its filter reaches the scan, and the bill is on disk once, not twice.
    source = _keyed_bill(s, f)
    for c in connectors:
        lake.write_bill_window(s, root, c, "1990-01-01", "2010-12-31", source)
    return root, source


def _totals(rows):
    return rows.groupBy("x_source_connector", "charge_month").agg(
        F.count("*").alias("n"), F.sum("effective_cost").alias("cost"))


query("b4_scan_bronze_bill")(lambda s, f: _totals(scans.scan_bronze_bill(s, _bronze(s, f)[0])))


@query("k1_write_bill_window")
def _k1(s, f):
    root, source = _bronze(s, f)
    # A second pull of two years, in which one month is no longer reported.
    lake.write_bill_window(s, root, "aws", "1997-01-01", "1998-12-31", source.where(F.col("charge_month") != "1997-06"))
    return _totals(scans.scan_bronze_bill(s, root))


@query("k2_purge_connector")
def _k2(s, f):
    root, _ = _bronze(s, f)
    lake.purge_connector(s, root, "snowflake")
    return _totals(scans.scan_bronze_bill(s, root))


def _efficiency(s, f):
    root = work_folder(s, "efficiency")
    lake.write_efficiency(s, root, dt.efficiency(s, f), "1990-01-01", "2010-12-31")
    return root


def _plane_totals(rows, *keys):
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


_EFF_KEYS = ("provider_name", "x_source_connector", "charge_month")


@query("k3_write_efficiency")
def _k3(s, f):
    root = _efficiency(s, f)
    again = dt.efficiency(s, f).where((F.col("provider_name") == "AWS") & (F.col("charge_month") != "1997-06"))
    lake.write_efficiency(s, root, again, "1997-01-01", "1997-12-31")
    return _plane_totals(scans.scan_plane(s, root, schemas.EFFICIENCY), *_EFF_KEYS)


@query("k4_repartition_legacy_metrics")
def _k4(s, f):
    old, new = work_folder(s, "legacy"), work_folder(s, "metrics")
    lake.replace_partitions(dt.efficiency(s, f), old, ["provider_name", "charge_month"])
    lake.repartition_legacy_metrics(s, old, new)
    return _plane_totals(scans.scan_plane(s, new, schemas.EFFICIENCY), *_EFF_KEYS)


@query("b5_scan_plane")
def _b5(s, f):
    root = work_folder(s, "ai")
    old = dt.plane(s, f, "ai_usage").drop("max_provisioned_throughput", "workload_size")
    lake.write_monthly_plane(s, root, old, "1990-01-01", "2010-12-31")
    rows = scans.scan_plane(s, root, schemas.AI_USAGE)
    return rows.groupBy("provider_name", "charge_month", "serving_mode").agg(
        F.count("*").alias("n"), F.count("workload_size").alias("sized"), F.sum("input_tokens").alias("input_tokens"))


@query("k5_write_monthly_planes")
def _k5(s, f):
    root = work_folder(s, "instances")
    rows = dt.plane(s, f, "compute_instance")
    for _ in range(2):
        lake.write_monthly_plane(s, root, rows, "1990-01-01", "2010-12-31")
    return _plane_totals(scans.scan_plane(s, root, schemas.COMPUTE_INSTANCE), "provider_name", "charge_month")


@query("b6_scan_driver_health")
def _b6(s, f):
    new, old = work_folder(s, "drivers"), work_folder(s, "drivers-legacy")
    rows = dt.plane(s, f, "driver_health")
    lake.write_monthly_plane(s, new, rows.where((F.col("charge_month") == "2024-01") & (F.col("provider_name") == "Databricks")),
                             "2023-01-01", "2024-12-31")
    lake.replace_partitions(rows, old, ["provider_name", "charge_month"])
    return scans.scan_driver_health(s, new, old).groupBy("provider_name", "charge_month").agg(
        F.count("*").alias("n"), F.sum("query_count").alias("query_count"))


@query("k6_write_storage_locations")
def _k6(s, f):
    root = work_folder(s, "locations")
    rows = dt.plane(s, f, "storage_location")
    lake.write_snapshot(rows, root)
    lake.write_snapshot(rows.where(F.lit(False)), root)
    return _plane_totals(scans.scan_plane(s, root, schemas.STORAGE_LOCATION), "provider_name", "snapshot_month", "location_kind")


@query("k7_write_table_observability")
def _k7(s, f):
    root = work_folder(s, "observability")
    daily = dt.plane(s, f, "stl_scan").groupBy(
        F.col("tbl").alias("table_id"), F.date_format("starttime", "yyyy-MM").alias("observation_date"),
        F.concat(F.lit("cl-"), (F.col("tbl") % 3).cast("string")).alias("cluster_id")).agg(F.count("*").alias("query_count"))
    rows = schemas.conform(daily.withColumn("record_kind", F.lit("table_usage")), schemas.TABLE_OBSERVABILITY)
    lake.write_table_observability(rows, root)
    lake.write_table_observability(rows.where((F.col("cluster_id") == "cl-1") & (F.col("observation_date") == "1997-06")), root)
    return scans.scan_plane(s, root, schemas.TABLE_OBSERVABILITY).groupBy("cluster_id", "observation_date", "record_kind").agg(
        F.count("*").alias("n"), F.sum("query_count").alias("query_count"))


@query("k8_write_policy_config")
def _k8(s, f):
    root = work_folder(s, "policy")
    lake.write_snapshot(dt.plane(s, f, "policy_config"), root)
    return _plane_totals(scans.scan_plane(s, root, schemas.POLICY_CONFIG), "provider_name", "snapshot_month", "encrypted")


def _account(s, f):
    root = work_folder(s, "account")
    t = {n: au_src.tables(s, f)[n] for n in ("metering_history", "tag_references")}
    upper = {n.upper(): df.toDF(*[c.upper() for c in df.columns]) for n, df in t.items()}
    lake.write_account_usage(upper, root, {"METERING_HISTORY": "START_TIME"}, "2024-01")
    return root


@query("k9_write_account_usage")
def _k9(s, f):
    root = _account(s, f)
    rows = s.read.parquet(f"{root}/metering_history")
    return rows.groupBy("provider_name", "charge_month").agg(F.count("*").alias("n"), F.sum("credits_used").alias("credits"))


@query("b7_scan_account_usage")
def _b7(s, f):
    root = _account(s, f)
    rows = scans.scan_account_usage(s, root, "metering_history")
    return rows.groupBy("service_type", "entity_type").agg(F.count("*").alias("n"), F.sum("credits_used").alias("credits"))


@query("b8_scan_turn_log")
def _b8(s, f):
    a, b = work_folder(s, "turns"), work_folder(s, "turns-old")
    rows = dt.plane(s, f, "turn_log")
    rows.where(F.col("total_tokens") % 2 == 0).write.parquet(a)
    rows.where(F.col("total_tokens") % 2 == 1).drop("route", "execute_ms").write.parquet(b)
    return scans.scan_turn_log(s, a, b).groupBy("model", "route").agg(
        F.count("*").alias("n"), F.sum("total_tokens").alias("total_tokens"), F.count("execute_ms").alias("timed"))


def _views(s, f):
    lines = bill(s, f, "list_cost", "billing_currency", "service_category", "x_effective_is_list")
    return {"monthly_bill": spend.monthly_bill(lines), "spend_by_service_month": spend.spend_by_service_month(lines)}


def _gold(s, f):
    root = work_folder(s, "gold")
    summary = efficiency.waste_summary_month(rules.waste_record(planes.entities(s, f)))
    return root, lake.publish_gold(s, root, _views(s, f), {"efficiency": {"waste_summary_month": summary}})


@query("k10_publish_gold")
def _k10(s, f):
    root, produced = _gold(s, f)
    parts = [s.read.parquet(f"{root}/{p}").agg(F.lit(p).alias("relation"), F.count("*").alias("n")) for p in produced]
    return lake_union(parts)


def lake_union(parts):
    from tallyspark.operators.frame import union_all
    return union_all(parts)


@query("b9_scan_gold")
def _b9(s, f):
    root, _ = _gold(s, f)
    return scans.scan_gold(s, root, "databricks", "monthly_bill").drop("list_cost", "savings", "currency")


query("k11_discover_providers")(lambda s, f: lake.discover_providers(dt.bill(s, f, ("provider_name",))))
query("k12_provider_group")(lambda s, f: dt.bill(s, f, ("provider_name", "service_name")).groupBy(
    lake.provider_group(F.concat_ws(" / ", "provider_name", "service_name")).alias("provider_group")).agg(F.count("*").alias("n")))


def _runs(s, f):
    return dt.plane(s, f, "run_log").withColumnRenamed("rows_written", "rows")


query("k13_run_history")(lambda s, f: lake.run_history(_runs(s, f), 50).drop("started_at", "finished_at", "detail"))
query("k13_run_groups")(lambda s, f: lake.run_groups(_runs(s, f), 20).withColumn("started_at", F.to_date("started_at")).withColumn(
    "finished_at", F.to_date("finished_at")))

# --- catalog -----------------------------------------------------------------------------------------------
query("q1_query_view")(lambda s, f: catalog.query_view(
    _views(s, f), "spend_by_service_month", order_by="net_cost DESC",
    filters={"provider_name": ["AWS", "Databricks"], "service_category": "Analytics"}, measures=["net_cost", "list_cost"]))
query("q2_distinct_values")(lambda s, f: catalog.distinct_values(_views(s, f), "spend_by_service_month", "service_name"))
query("q3_run_select")(lambda s, f: catalog.run_select(
    s, _views(s, f), "WITH t AS (SELECT provider_name, sum(net_cost) AS net FROM monthly_bill GROUP BY provider_name) SELECT * FROM t", 100))


@query("q4_catalog")
def _q4(s, f):
    views = _views(s, f)
    rows = views["spend_by_service_month"].agg(F.count("*").alias("view_rows"))
    return catalog.catalog(s, views).where(F.col("view") == "spend_by_service_month").crossJoin(F.broadcast(rows))


@query("q5_list_rules")
def _q5(s, f):
    fired = planes.waste(s, f).groupBy(F.col("waste_category").alias("category")).agg(F.count("*").alias("findings"))
    return catalog.list_rules(s).where(F.col("pool") == "waste").join(fired, "category", "left")


@query("q6_load_thresholds")
def _q6(s, f):
    limits = {**catalog.load_thresholds(), "underutilized_pct": 10}
    found = rules.waste_record(planes.entities(s, f), limits)
    return found.where(F.col("waste_category") == "underutilized").groupBy("charge_month").agg(F.count("*").alias("n"))


# --- GOLD build graph -----------------------------------------------------------------------------------
def gold_graph(s, f, wanted=None):
    """The silver bill as one shared node with the columns that the wanted spend views (all without a choice) read,
    and every spend view on it. Only wanted views can be built."""
    from tallyspark.plans import gold
    from tallyspark.plans.spend_queries import VIEWS
    from tallyspark.plans.spend_queries import bill as silver_bill

    def silver():
        # Every table is joined whichever columns are stored: a key that repeats in one repeats its bill lines in all views.
        whole = silver_bill(s, f, *sorted({c for _, needed in VIEWS.values() for c in needed}))
        if wanted is None:
            return whole
        read = {c for name, (_, needed) in VIEWS.items() if name.split("_", 1)[1] in wanted for c in needed}
        return whole.select(*silver_bill(s, f, *sorted(read)).columns)

    nodes = [gold.Node("silver_bill", silver)]
    for name, (view, _) in VIEWS.items():
        if view is spend.resource_month:
            view = functools.partial(view, stored=True)
        nodes.append(gold.Node(name.split("_", 1)[1], view, ("silver_bill",), gold.BY_PROVIDER))
    return nodes


def _read_back(s, f, view):
    """Publishes one view of the graph (and what it needs), then reads all its provider groups back."""
    from tallyspark.plans import gold

    root = work_folder(s, "gold-graph")
    nodes = gold_graph(s, f, [view])
    built = gold.build(nodes, [view])
    produced = gold.publish(s, root, nodes, [view], built)
    schema = built[view].schema
    paths = [f"{root}/{p}" for p in produced if p.endswith(f"/{view}")]
    rows = s.read.schema(schema).parquet(*paths) if paths else s.createDataFrame([], schema)
    return rows


def _register_gold_views():
    from tallyspark.plans.registry import EXACT
    from tallyspark.plans.spend_queries import VIEWS

    for name in VIEWS:
        short = name.split("_", 1)[1]
        exact = EXACT if name == "g16_sku_month_over_month" else None
        query(f"b9_gold_{short}", exact)(lambda s, f, short=short: _read_back(s, f, short))


_register_gold_views()
