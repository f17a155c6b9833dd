import json
from decimal import Decimal

import pytest

from tallyspark import schemas
from tallyspark.operators import actions, efficiency, rules


@pytest.fixture()
def entities(spark):
    def make(*rows):
        out = []
        for i, r in enumerate(rows):
            base = {"entity_type": "job", "entity_id": f"e{i}", "entity_name": f"E{i}", "billed_cost": Decimal("100"),
                    "provider_name": "Databricks", "x_source_connector": "databricks", "charge_month": "2024-05"}
            base.update(r)
            base["cause_detail"] = json.dumps(base.pop("cause", {}))
            out.append(tuple(base.get(f.name) for f in schemas.EFFICIENCY.fields))
        return rules.unpack_cause_detail(spark.createDataFrame(out, schemas.EFFICIENCY))

    return make


def _fired(df):
    return {(r["waste_category"], r["recoverable_cost"], r["confidence"], r["detail"]) for r in rules.waste_record(df).collect()}


CASES = [
    ({"utilization_pct": 10.0, "cause": {"pct_runs_underutilized": 0.9}}, "underutilized", 90.0, "high"),
    ({"utilization_pct": 10.0}, "underutilized", 90.0, "candidate"),
    ({"activity_count": 0}, "idle", 100.0, "high"),
    ({"utilization_pct": 40.0}, "job_low_utilization", 30.0, "candidate"),
    ({"entity_type": "interactive", "cause": {"job_shaped_cost": 150, "jobs_priced_cost": 45, "auto_termination_minutes": 5}}, "placement", 105.0, "candidate"),
    ({"cause": {"failed_cost": 12.5}}, "failed", 12.5, "high"),
    ({"entity_type": "interactive", "cause": {"photon": True, "auto_termination_minutes": 5}}, "photon_on_interactive_cluster", 50.0, "candidate"),
    ({"entity_type": "interactive"}, "missing_autotermination", 15.0, "candidate"),
    ({"entity_type": "storage"}, "s3_intelligent_tiering", 35.0, "candidate"),
    ({"entity_type": "sql_warehouse_user", "cause": {"duration_share_pct": 40, "query_count": 3}}, "sql_warehouse_user_concentration", 20.0, "candidate"),
    ({"entity_type": "table", "native_quantity": 1024000.0, "cause": {"days_since_last_access": 90}}, "redshift_table_unused", 24.0, "candidate"),
    ({"entity_type": "sql_warehouse", "cause": {"compute_cost": 85, "concurrency_scaling_cost": 15}}, "redshift_concurrency_scaling_overage", 15.0, "candidate"),
    ({"entity_type": "sql_warehouse", "cause": {"on_demand_node_hours": 50, "reserved_node_hours": 50, "compute_cost": 80}}, "redshift_ri_coverage_gap", 20.0, "candidate"),
    ({"entity_type": "sql_warehouse", "cause": {"wlm_queue_wait_ms_p95": 5000}}, "redshift_wlm_queue_wait", 0.0, "candidate"),
    ({"entity_type": "table", "cause": {"encoded": "N"}}, "redshift_stale_compression_encoding", 0.0, "high"),
]


@pytest.mark.parametrize("row,category,amount,confidence", CASES)
def test_rule_fires(entities, row, category, amount, confidence):
    found = [f for f in _fired(entities(row)) if f[0] == category]
    assert [(f[1], f[2]) for f in found] == [(amount, confidence)]


NEAR = [
    ({"utilization_pct": 20.5}, "underutilized"),
    ({"activity_count": 0, "billed_cost": Decimal("0")}, "idle"),
    ({"utilization_pct": 60.0}, "job_low_utilization"),
    ({"cause": {"network_bytes": 9e11}}, "possible_heavy_shuffle"),
    ({"cause": {"network_bytes": 9e11, "avg_run_seconds": 299}}, "possible_heavy_shuffle"),
    ({"entity_type": "query_pattern", "cause": {"run_count": 2, "avg_skew_ratio": 9}}, "redshift_query_pattern_skew"),
    ({"entity_type": "table", "cause": {"days_since_last_access": 89}}, "redshift_table_unused"),
    ({"entity_type": "endpoint", "cause": {"request_count": 5}}, "endpoint_scale_to_zero_disabled"),
]


@pytest.mark.parametrize("row,category", NEAR)
def test_rule_stays_quiet_just_below_or_without_telemetry(entities, row, category):
    assert category not in {f[0] for f in _fired(entities(row))}


def test_nothing_measured_is_never_a_verdict(entities):
    assert _fired(entities({})) == set()


def test_whole_numbers_written_as_decimals_still_read(entities):
    row = entities({"cause": {"query_count": 3.0, "run_count": "7"}}).first()
    assert (row["query_count"], row["run_count"]) == (3, 7)


def test_thresholds_move_the_rule(entities):
    e = entities({"utilization_pct": 30.0})
    assert "underutilized" in {r["waste_category"] for r in rules.waste_record(e, {"underutilized_pct": 35}).collect()}


def test_resolution_counts_full_recovery_when_an_entity_disappears(entities):
    e = entities({"entity_id": "a", "activity_count": 0}, {"entity_id": "b", "charge_month": "2024-06", "activity_count": 5})
    row = efficiency.waste_resolution_month(rules.waste_record(e), e).first()
    assert row["is_resolved"] and float(row["realized_savings"]) == 100.0 and row["billed_cost_after"] is None


def test_owner_view_never_has_a_null_key(entities):
    e = entities({"activity_count": 0}, {"activity_count": 0, "owner_user": " Bob "},
                 {"activity_count": 0, "owner_user": "0A1B2C3D-0000-4000-8000-000000000001"})
    rows = efficiency.waste_by_owner_month(rules.waste_record(e)).where("owner_dimension = 'owner_user'").collect()
    assert {(r["owner_key"], r["owner_kind"], r["owner_display"]) for r in rows} == {
        ("(unattributed)", "unattributed_shared_compute", "Unattributed (shared compute)"), ("bob", "user", "Bob"),
        ("0a1b2c3d-0000-4000-8000-000000000001", "service_principal", "Service principal 0a1b2c3d")}


def test_best_action_is_not_the_sum(entities):
    e = entities({"activity_count": 0, "utilization_pct": 10.0})
    best = actions.best_action_per_entity(rules.waste_record(e)).collect()
    assert [(b["potential_savings"], b["findings"]) for b in best] == [(100.0, 2)]
    shown = actions.entity_findings(rules.waste_record(e)).collect()
    assert sum(r["potential_savings"] for r in shown) == 100.0 and len(shown) == 2


def test_coverage_tells_clean_from_no_data(entities):
    e = entities({"entity_type": "job", "utilization_pct": 90.0})
    rows = {(r["entity_type"], r["waste_category"]): r["status"] for r in actions.rule_coverage(rules.waste_record(e), e).collect()}
    assert rows[("job", "job_low_utilization")] == "clean" and rows[("notebook", "notebook_could_move_to_jobs")] == "no data"
    assert rows[("", "underutilized")] == "clean"


def test_policy_statuses(spark, entities):
    e = entities({"entity_type": "interactive", "cause": {"auto_termination_minutes": 90, "tag_count": 0}}, {"entity_type": "sql_warehouse"})
    snap = spark.createDataFrame([("c", None, True, None, False, 7, None, 2, "rs", "AWS", "2024-05")], schemas.POLICY_CONFIG)
    rows = {(r["entity_id"], r["policy_category"]): r["status"] for r in rules.policy_record(e, snap).collect()}
    assert rows[("e0", "auto_terminate")] == "non_compliant" and rows[("e0", "cluster_tagging")] == "non_compliant"
    assert rows[("e1", "warehouse_auto_stop")] == "not_applicable"
    assert rows[("c", "redshift_public_access")] == "not_applicable" and rows[("c", "redshift_snapshot_retention")] == "compliant"


def _filtered_before_unpacking(df):
    """Whether a filter on the kind of entity stands at or below every parse of the causes in the plan."""
    plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    parses = [i for i, line in enumerate(plan) if "from_json" in line]
    filters = [i for i, line in enumerate(plan) if "Filter" in line and "interactive" in line]
    return bool(parses and filters) and max(parses) <= max(filters)


def test_a_rule_alone_filters_records_before_their_causes_are_unpacked(entities):
    rule = next(r for r in rules.WASTE_RULES if r.category == "autoscale_misconfigured")
    cause = {"min_autoscale_workers": 1, "max_autoscale_workers": 9}
    df = entities({"entity_type": "interactive", "utilization_pct": 10.0, "cause": cause}, {"entity_type": "interactive", "utilization_pct": 10.0},
                  {"utilization_pct": 10.0, "cause": cause}, {"entity_type": "interactive", "utilization_pct": None, "cause": cause})
    found = rules.waste_record(df, rules=(rule,))
    assert [r["entity_id"] for r in found.collect()] == ["e0"]
    assert _filtered_before_unpacking(found)


def test_kinds_without_a_policy_are_not_unpacked(spark, entities):
    df = entities({"entity_type": "interactive", "cause": {"tag_count": 1}}, {"entity_type": "job", "cause": {"tag_count": 1}}, {"entity_type": None})
    snapshots = schemas.empty(spark, schemas.POLICY_CONFIG)
    found = rules.policy_record(df, snapshots)
    assert {r["entity_id"] for r in found.collect()} == {"e0"}
    assert _filtered_before_unpacking(found)
