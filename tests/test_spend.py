import datetime as dt

from pyspark.sql import functions as F

from tallyspark.operators import silver, spend


def _one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def _days(n, cost=10, month="2024-05"):
    return [{"day": f"{month}-{d:02d}", "cost": cost} for d in range(1, n + 1)]


def test_run_rate_drops_the_newest_day(bill_rows, provider_bill):
    out = spend.spend_forecast_month(provider_bill(bill_rows(*_days(11)))).where("forecast_kind = 'run_rate'")
    row = _one(out)
    assert (row["forecast_cost"], row["history_days"], row["actual_to_date"]) == (310.0, 10, 110.0)


def test_run_rate_ignores_a_small_newest_day(bill_rows, provider_bill):
    rows = _days(10) + [{"day": "2024-05-11", "cost": 1}]
    row = _one(spend.spend_forecast_month(provider_bill(bill_rows(*rows))).where("forecast_kind = 'run_rate'"))
    assert (row["forecast_cost"], row["actual_to_date"]) == (310.0, 101.0)


def test_trend_needs_three_complete_months(bill_rows, provider_bill):
    rows = _days(3, month="2024-03") + _days(3, month="2024-04") + _days(5)
    out = spend.spend_forecast_month(provider_bill(bill_rows(*rows))).where("forecast_kind = 'trend'").collect()
    assert len(out) == 3 and all(r["forecast_cost"] is None for r in out)


def test_trend_is_the_mean_of_the_last_three_months(bill_rows, provider_bill):
    rows = [{"day": f"2024-0{m}-05", "cost": c} for m, c in ((1, 500), (2, 30), (3, 60), (4, 90))] + _days(5)
    out = spend.spend_forecast_month(provider_bill(bill_rows(*rows))).where("forecast_kind = 'trend'").orderBy("charge_month").collect()
    assert [(r["charge_month"], r["forecast_cost"]) for r in out] == [
        (dt.date(2024, 6, 1), 60.0), (dt.date(2024, 7, 1), 60.0), (dt.date(2024, 8, 1), 60.0)]


def test_no_history_gives_an_empty_forecast(bill_rows, provider_bill):
    assert spend.spend_forecast_month(provider_bill(bill_rows({"cost": 1}).where("false"))).count() == 0


def test_gross_is_null_without_charges(bill_rows, provider_bill):
    row = _one(spend.monthly_bill(provider_bill(bill_rows({"cost": -5}))))
    assert row["gross_cost"] is None and row["credit_cost"] == -5


def test_lag_is_the_previous_present_month_and_effects_add_up(bill_rows, provider_bill):
    rows = bill_rows({"day": "2024-01-02", "cost": 100, "consumed_quantity": 10.0, "sku_id": "s"},
                     {"day": "2024-04-02", "cost": 180, "consumed_quantity": 12.0, "sku_id": "s"})
    last = spend.sku_month_over_month(provider_bill(rows)).where(F.col("prev_cost").isNotNull()).collect()[0]
    assert float(last["cost_delta"]) == 80 and last["volume_effect"] == 20.0 and last["rate_effect"] == 60.0
    assert last["cost_pct_change"] == 80.0


def test_infrastructure_services_leave_the_provider_bill_but_not_silver(bill_rows):
    lines = silver.focus_normalized(bill_rows({"service_name": "Amazon Elastic Compute Cloud"}, {}), "2024-05-11")
    assert lines.count() == 2 and silver.provider_bill(lines).count() == 1


def test_tag_spellings_fold_into_one_key(bill_rows, provider_bill):
    rows = bill_rows({"tags": '{"app-name":"a"}', "cost": 3}, {"tags": '{"App_Name":"b"}', "cost": 4}, {"tags": '{"app-name":"c"}', "cost": -9})
    row = _one(spend.spend_by_tag_key_month(provider_bill(rows)))
    assert (row["tag_key_normalized"], row["tag_key_variants"], row["variant_count"]) == ("app_name", "App_Name · app-name", 2)
    assert float(row["net_cost"]) == 7 and row["tag_value_count"] == 2


def test_daily_and_monthly_totals_reconcile(bill_rows, provider_bill):
    b = provider_bill(bill_rows(*_days(9, 7), {"day": "2024-04-02", "cost": -3, "service_name": "X"}))
    totals = {view(b).agg(F.sum("net_cost")).first()[0] for view in (
        spend.monthly_bill, spend.spend_by_service_month, spend.spend_by_sku_month, spend.resource_month,
        spend.spend_trend_daily, spend.spend_by_workspace_month)}
    assert len(totals) == 1


def test_tagged_share_counts_charges_only(bill_rows, provider_bill):
    rows = bill_rows({"cost": 30, "tags": '{"a":"1"}'}, {"cost": 10}, {"cost": -500})
    row = _one(spend.spend_tag_coverage_month(provider_bill(rows)))
    assert row["tagged_pct"] == 75.0 and float(row["untagged_cost"]) == 10
