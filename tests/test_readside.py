"""Read-side queries: what several steps read is worked out once."""

import datetime as dt

from pyspark.sql import functions as F

from tallyspark.plans import plane_queries, readside_queries
from tallyspark.sources import driver_tables


def test_first_seen_context_finds_the_waste_once(spark, monkeypatch):
    cause = '{"query_count": 0, "failed_cost": 9.5}'
    days = [dt.date(2024, m, 1) for m in (3, 1, 2, 2)]
    rows = spark.createDataFrame(
        [("job", "j1", "j1", None, None, 100.0, 1.0, "DBU", None, 5, cause, "Databricks", "dbx", d.strftime("%Y-%m")) for d in days]
        + [("job", None, None, None, None, 50.0, 1.0, "DBU", None, 5, cause, "Databricks", "dbx", "2024-01")],
        "entity_type string, entity_id string, entity_name string, owner_user string, owner_project string, billed_cost double, "
        "native_quantity double, native_unit string, utilization_pct double, activity_count long, cause_detail string, "
        "provider_name string, x_source_connector string, charge_month string")
    monkeypatch.setattr(driver_tables, "efficiency", lambda s, f: rows)
    found = plane_queries.waste(spark, "").where("entity_id = 'j1'")
    assert found.count() >= 4  # the case has findings in every month, twice in one
    got = readside_queries._d25(spark, "")
    # The rules are not part of the plan: both steps read the stored findings.
    assert "Generate explode" not in got._jdf.queryExecution().optimizedPlan().toString()
    seen = [tuple(r) for r in got.where("entity_id = 'j1'").select("charge_month", "first_seen_month").distinct().orderBy("charge_month").collect()]
    assert seen == [(dt.date(2024, m, 1), dt.date(2024, 1, 1)) for m in (1, 2, 3)]
    assert got.where("entity_id is null and first_seen_month is not null").isEmpty()
    assert got.where(F.col("entity_id").isNull()).count() >= 1
