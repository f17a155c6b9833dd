"""Read-side analytics over the published views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import actions as ac
from tallyspark.operators import ai, efficiency, rules, spend
from tallyspark.operators import account_usage as au
from tallyspark.operators import drilldown as dd
from tallyspark.plans import plane_queries as planes
from tallyspark.plans import telemetry_queries as tel
from tallyspark.plans.account_usage_queries import DAY
from tallyspark.plans.registry import query
from tallyspark.plans.spend_queries import VIEWS, bill
from tallyspark.sinks.files import stored
from tallyspark.sources import account_usage_tables as au_src
from tallyspark.sources import driver_tables as dt

START, END, MONTH, AS_OF = "1996-01-01", "1999-12-01", "1998-06-01", dt.AS_OF


def view(name, provider=None):
    """A spend view of the whole bill or of one provider."""
    fn, columns = VIEWS[next(k for k in VIEWS if k.split("_", 1)[1] == name)]

    def load(spark, sf):
        lines = bill(spark, sf, *columns)
        if provider:
            lines = lines.where(F.col("provider_name") == provider)
        return fn(lines)

    return load


def _d(name, build, round_to=None):
    query(name, round_to)(build)


AWS, DBX = "AWS", "Databricks"
_d("d1_service_share", lambda s, f: dd.service_share(view("spend_by_service_month", AWS)(s, f), START, END))
_d("d2_resource_rank", lambda s, f: dd.resource_rank(view("resource_month", DBX)(s, f), "JOBS", START, END))
_d("d3_billing_tier", lambda s, f: view("spend_by_service_month")(s, f).groupBy(
    dd.billing_tier(F.col("service_name")).alias("tier"), "service_name").agg(F.sum("net_cost").alias("net_cost")))


def _shares(s, f):
    util = efficiency.utilization_entity_month(planes.entities(s, f), planes.waste(s, f))
    return util.where((F.col("provider_name") == DBX) & (F.col("entity_type") == "sql_warehouse_user")).select(
        "charge_month", F.col("entity_id").alias("owner_user"), F.col("primary_signal_value").alias("share"),
        F.col("secondary_signals").alias("note"))


@query("d4_allocate_cost_to_users")
def _d4(s, f):
    cost = dd.in_range(view("spend_by_service_month", DBX)(s, f), START, END).where(
        F.col("service_name") == "SQL").select("charge_month", F.col("gross_cost").alias("cost"))
    return dd.allocate_cost_to_users(cost, dd.in_range(_shares(s, f), START, END))


_d("d5_tag_key_rank", lambda s, f: dd.tag_key_rank(
    view("spend_by_tag_key_month", DBX)(s, f), view("spend_by_tag_month", DBX)(s, f), START, END))
_d("d6_tag_value_rank", lambda s, f: dd.tag_value_rank(view("spend_by_tag_month", DBX)(s, f), "cost_project", START, END))
_d("d7_bill_months", lambda s, f: dd.bill_months(view("monthly_bill", DBX)(s, f), START, END))
_RS = ("Amazon Redshift", "Amazon Redshift Spectrum")
_d("d7_bill_months_scoped", lambda s, f: dd.bill_months(view("spend_by_service_month", AWS)(s, f), START, END, _RS[:1]))
_d("d8_scoped_run_rate", lambda s, f: dd.scoped_run_rate(view("spend_trend_daily", AWS)(s, f), _RS))
_d("d8_scoped_forecast", lambda s, f: dd.scoped_forecast(view("spend_trend_daily", AWS)(s, f), _RS))
_d("d9_cap_series", lambda s, f: dd.cap_series(
    view("spend_by_service_month")(s, f).select("charge_month", "service_name", "net_cost"), "service_name", "net_cost", 5))


def _backing(s, f, start=START, end=END):
    return dd.backing_monthly(planes.backing_storage(s, f), planes.backing_compute(s, f), start, end)


_d("d10_backing_monthly", _backing)
_d("d10_backing_run_rate", lambda s, f: dd.backing_run_rate(_backing(s, f), MONTH, 12), 2)
_d("d10_backing_trend", lambda s, f: dd.backing_trend(_backing(s, f), "1999-01-01"))
_d("d11_partial_month_remainder", lambda s, f: dd.partial_month_remainder(
    view("spend_forecast_month")(s, f), view("monthly_bill")(s, f), 1))
_MONTHS = [f"1998-{m:02d}-01" for m in range(1, 7)]
_d("d12_spend_pivot", lambda s, f: dd.spend_pivot(view("spend_by_sku_month", DBX)(s, f), "sku_id", _MONTHS))
_d("d13_resource_delta", lambda s, f: dd.resource_delta(view("resource_month", DBX)(s, f), "service_name", "SQL", MONTH))
_d("d14_sku_tag_delta", lambda s, f: dd.sku_tag_delta(
    view("spend_by_sku_tag_month", DBX)(s, f), view("spend_by_sku_month", DBX)(s, f), "Brand#7", "team", MONTH))
_d("d15_mom_totals", lambda s, f: dd.mom_totals(view("sku_month_over_month", DBX)(s, f), MONTH))
_d("d16_cost_subcategory_split", lambda s, f: dd.cost_subcategory_split(
    view("spend_by_cost_subcategory_month", AWS)(s, f), START, END))
_d("d16_credits_detail", lambda s, f: dd.credits_detail(view("credits_month", AWS)(s, f), START, END))
_d("d17_latest_month_movers", lambda s, f: dd.latest_month_movers(
    view("sku_month_over_month", DBX)(s, f), "2005-01-01", AS_OF, 20))
_d("d17_sku_compare", lambda s, f: dd.sku_compare(view("spend_by_sku_month", AWS)(s, f), MONTH, 20))
_d("d18_spend_alert", lambda s, f: dd.spend_alert(view("monthly_bill")(s, f), "1998-01-15", "1998-06-30", AS_OF))
_d("d18_alert_movers", lambda s, f: dd.alert_movers(
    view("spend_by_service_month")(s, f), view("sku_month_over_month")(s, f), MONTH, 10))


def _movers(s, f, n=8):
    return dd.cross_provider_movers(view("spend_by_service_month")(s, f), view("sku_month_over_month")(s, f), MONTH, n, True)


_d("d19_cross_provider_movers", _movers)
_d("d20_best_action_per_entity", lambda s, f: ac.best_action_per_entity(planes.waste(s, f)))
_d("d20_action_groups", lambda s, f: ac.action_groups(planes.waste(s, f)))
_d("d20_action_potential_by_month", lambda s, f: ac.action_potential_by_month(planes.waste(s, f)))
_d("d20_action_potential_by_month_all_lanes", lambda s, f: ac.action_potential_by_month(planes.waste(s, f), False))
_d("d21_entity_findings", lambda s, f: ac.entity_findings(planes.waste(s, f)))
_d("d22_completed_months", lambda s, f: ac.completed_months(planes.waste(s, f), AS_OF))
_d("d22_mom_recoverable_delta", lambda s, f: ac.mom_recoverable_delta(planes.waste(s, f), AS_OF))
_d("d23_measurement_coverage", lambda s, f: ac.measurement_coverage(planes.entities(s, f)))


@query("d24_rule_coverage")
def _d24(s, f):
    records = planes.entities(s, f)
    return ac.rule_coverage(rules.waste_record(records), records)


@query("w40_rule_scope")
def _w40(s, f):
    measured = planes.entities(s, f).groupBy("provider_name", "entity_type").agg(F.count("*").alias("entity_months"))
    scope = ac.rule_scope(s).where(F.col("entity_type") != "")
    return scope.join(measured, ["provider_name", "entity_type"])


@query("w40_rule_scope_all")
def _w40_all(s, f):
    """Rules for any kind ('') are in scope for every kind a provider has measured."""
    measured = planes.entities(s, f).groupBy("provider_name", F.col("entity_type").alias("measured_entity_type")).agg(
        F.count("*").alias("entity_months"))
    scope = ac.rule_scope(s)
    fits = (F.col("entity_type") == "") | (F.col("entity_type") == F.col("measured_entity_type"))
    return scope.join(measured, "provider_name").where(fits)


@query("d25_first_seen_context")
def _d25(s, f):
    records = planes.entities(s, f)
    # The best findings and the first sightings read the same findings: write them once.
    found = stored(rules.waste_record(records), "findings")
    best = ac.best_action_per_entity(found).select("charge_month", "entity_type", "entity_id", "lens", "potential_savings")
    return ac.first_seen_context(best, efficiency.waste_resolution_month(found, records))


@query("d26_driver_staleness")
def _d26(s, f):
    return ac.driver_staleness(dt.plane(s, f, "driver_health")).select(
        "provider_name", "cluster_id", "charge_month", "executed_by", "client_driver", "driver_family", "driver_version",
        "newest_seen_version", "status")


_d("d27_latest_policy_status", lambda s, f: ac.latest_policy_status(planes.policies(s, f)))
_d("d27_policy_compliance", lambda s, f: ac.policy_compliance(planes.policies(s, f)))
_d("d28_redshift_spend_partition", lambda s, f: dd.redshift_spend_partition(view("resource_month", AWS)(s, f), START, END))
_CLU = view("redshift_cluster_cost_month", AWS)
_d("d29_cluster_components", lambda s, f: dd.cluster_components(_CLU(s, f), START, END))
_d("d29_component_charges", lambda s, f: dd.component_charges(_CLU(s, f), "cl-3", "storage", START, END))
_d("d30_spectrum_table_cost", lambda s, f: dd.spectrum_table_cost(planes.entities(s, f), "1990-01-01", "2030-01-01"))
_d("d31_compute_heavy_tables", lambda s, f: dd.compute_heavy_tables(tel.inventory(s, f)), {"weighted_exec_seconds": 2})


@query("d32_capacity_state")
def _d32(s, f):
    from tallyspark.operators import redshift as rs
    measured = rs.measurable_window(tel.activity(s, f), *tel.WINDOW)
    return dd.capacity_state(rs.redshift_cluster_row(
        measured, tel.cost_breakdown(s, f), tel.reserved(s, f), tel.capacity(s, f), tel.MONTH))


@query("d33_billed_vs_instrumented_clusters")
def _d33(s, f):
    seen = tel.capacity(s, f).select(F.col("cluster_id").alias("entity_id"))
    return dd.billed_vs_instrumented_clusters(view("resource_month", AWS)(s, f), seen)


_d("d34_total_cost_of_ownership", lambda s, f: dd.total_cost_of_ownership(
    view("monthly_bill")(s, f), planes.backing_storage(s, f), planes.backing_compute(s, f), START, END))
_d("d35_headline_month", lambda s, f: dd.headline_month(view("monthly_bill")(s, f), START, "2010-01-01", AS_OF))
_d("d35_credits_by_provider", lambda s, f: dd.credits_by_provider(view("credits_month")(s, f), MONTH))
_d("d35_recoverable_by_provider", lambda s, f: ac.recoverable_by_provider(planes.waste(s, f), MONTH))


@query("d35_provider_history")
def _d35(s, f):
    tco = au.tco_by_month(au_src.tables(s, f), DAY).withColumn("month", F.add_months("month", -300))
    return dd.provider_history(view("monthly_bill")(s, f), planes.backing_storage(s, f), planes.backing_compute(s, f),
                               START, END, AS_OF, tco)


@query("d35_recoverable_by_provider_with_account")
def _d35b(s, f):
    total = au.hidden_waste_summary(au_src.tables(s, f), DAY)
    return ac.recoverable_by_provider(planes.waste(s, f), MONTH, total)


@query("d36_home_movers")
def _d36(s, f):
    account = au_src.tables(s, f)["warehouse_metering_history"].groupBy(
        F.add_months(F.trunc(F.to_date("start_time"), "MM"), -306).alias("charge_month")).agg(
        (F.sum("credits_used").cast("double") * 4.0).alias("cost"))
    return dd.home_movers(_movers(s, f, None), planes.backing_storage(s, f), planes.backing_compute(s, f), MONTH, 8, account)


_AI = view("ai_spend_month")
_d("d37_ai_by_product", lambda s, f: ac.ai_by_product(_AI(s, f)))
_d("d37_ai_by_resource", lambda s, f: ac.ai_by_resource(_AI(s, f)))
_d("d37_ai_by_tag", lambda s, f: ac.ai_by_tag(_AI(s, f), "team"))
_d("d38_token_rollup_by_user", lambda s, f: ac.token_rollup(
    ai.requester_month(planes.ai_allocated(s, f)), "requester_display"), 2)
_d("d38_token_rollup_by_project", lambda s, f: ac.token_rollup(ai.project_month(planes.ai_allocated(s, f)), "project_key"), 2)
_d("d39_model_economics", lambda s, f: ac.model_economics(ai.model_month(planes.ai_allocated(s, f))), 2)
_d("d39_endpoint_findings", lambda s, f: ac.endpoint_findings(planes.waste(s, f)))
_d("d40_managed_clusters", lambda s, f: dd.managed_clusters(planes.backing_compute(s, f)))
_d("d40_pricing_trend", lambda s, f: dd.pricing_trend(planes.backing_compute(s, f)))
_d("d40_managed_storage", lambda s, f: dd.managed_storage(planes.backing_storage(s, f)))
_d("d40_subcategory_trend", lambda s, f: dd.subcategory_trend(planes.backing_storage(s, f)))
_d("d41_turn_usage", lambda s, f: ac.turn_usage(dt.plane(s, f, "turn_log")))
_d("d42_ai_kpis", lambda s, f: ac.ai_kpis(_AI(s, f), ai.endpoint_month(planes.ai_base(s, f))))
_d("d43_redshift_tag_keys", lambda s, f: dd.redshift_tag_rank(
    view("spend_by_sku_tag_month", AWS)(s, f), view("resource_month", AWS)(s, f), START, END))
_d("d43_redshift_tag_values", lambda s, f: dd.redshift_tag_rank(
    view("spend_by_sku_tag_month", AWS)(s, f), view("resource_month", AWS)(s, f), START, END, "team"))
