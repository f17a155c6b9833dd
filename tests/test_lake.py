from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark import schemas
from tallyspark.operators import mapping
from tallyspark.sinks import files, lake
from tallyspark.sinks.files import Folder
from tallyspark.sources import scans


@pytest.fixture()
def root(tmp_path):
    return str(tmp_path / "bill")


def _read(spark, root):
    return scans.scan_bronze_bill(spark, root)


def test_missing_table_reads_empty_and_typed(spark, root):
    df = _read(spark, root)
    assert df.count() == 0 and df.schema.names == schemas.BILL.names


def test_same_window_twice_keeps_the_row_count(spark, root, bill_rows):
    rows = bill_rows({"day": "2024-04-02"}, {"day": "2024-05-02", "cost": 2})
    for _ in range(2):
        lake.write_bill_window(spark, root, "aws", "2024-04-01", "2024-05-31", rows)
    assert _read(spark, root).count() == 2


def test_exact_repeats_collapse_and_vanished_months_disappear(spark, root, bill_rows):
    rows = bill_rows({"day": "2024-04-02", "dedupe_key": "x"}, {"day": "2024-04-02", "dedupe_key": "x"}, {"day": "2024-05-02", "cost": 2})
    lake.write_bill_window(spark, root, "aws", "2024-04-01", "2024-05-31", rows)
    assert _read(spark, root).count() == 2
    lake.write_bill_window(spark, root, "aws", "2024-04-01", "2024-05-31", rows.where("charge_month = '2024-05'"))
    assert [r[0] for r in _read(spark, root).select("charge_month").collect()] == ["2024-05"]


def test_months_outside_the_window_stay(spark, root, bill_rows):
    rows = bill_rows({"day": "2024-03-02"}, {"day": "2024-05-02", "cost": 2})
    lake.write_bill_window(spark, root, "aws", "2024-03-01", "2024-05-31", rows)
    lake.write_bill_window(spark, root, "aws", "2024-05-01", "2024-05-31", rows.where("false"))
    assert [r[0] for r in _read(spark, root).select("charge_month").collect()] == ["2024-03"]


def test_sibling_connectors_do_not_touch_each_other(spark, root, bill_rows):
    lake.write_bill_window(spark, root, "aws", "2024-05-01", "2024-05-31", bill_rows({}))
    lake.write_bill_window(spark, root, "other", "2024-05-01", "2024-05-31", bill_rows({"x_source_connector": "other"}))
    lake.purge_connector(spark, root, "aws")
    assert [r[0] for r in _read(spark, root).select("x_source_connector").collect()] == ["other"]


def test_foreign_currency_is_rejected_with_old_data_intact(spark, root, bill_rows):
    lake.write_bill_window(spark, root, "aws", "2024-05-01", "2024-05-31", bill_rows({"cost": 5}))
    with pytest.raises(mapping.MixedCurrencyError):
        lake.write_bill_window(spark, root, "aws", "2024-05-01", "2024-05-31", bill_rows({"billing_currency": "EUR"}))
    assert float(_read(spark, root).first()["effective_cost"]) == 5
    assert Folder(spark, root).children(f"{root}/_staging") == []


def _breaking_move(monkeypatch, at=2):
    """Folder.move fails on its `at`-th call, after the target was removed: a crash between the two steps."""
    real, calls = Folder.move, []

    def flaky(self, source, target):
        calls.append(target)
        if len(calls) == at:
            raise OSError("lost")
        real(self, source, target)

    monkeypatch.setattr(Folder, "move", flaky)
    return lambda: monkeypatch.setattr(Folder, "move", real)


def test_failed_swap_is_finished_by_the_next_reader(spark, root, bill_rows, monkeypatch):
    rows = bill_rows({"day": "2024-04-02"}, {"day": "2024-05-02"})
    lake.write_bill_window(spark, root, "aws", "2024-04-01", "2024-05-31", rows)
    fresh = bill_rows({"day": "2024-04-03", "cost": 7}, {"day": "2024-05-03", "cost": 8})
    heal = _breaking_move(monkeypatch)
    with pytest.raises(OSError):
        lake.write_bill_window(spark, root, "aws", "2024-04-01", "2024-05-31", fresh)
    heal()
    assert Folder(spark, root).exists(f"{root}/{files.JOURNAL}")
    got = sorted(float(r["effective_cost"]) for r in _read(spark, root).collect())
    assert got == [7.0, 8.0]  # the whole new window, never a mix and never a lost month
    assert not Folder(spark, root).exists(f"{root}/{files.JOURNAL}")
    assert Folder(spark, root).children(f"{root}/_staging") == []


def test_failed_window_swap_is_finished_by_the_next_writer(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "eff")

    def rows(ids, month="2024-05"):
        base = [tuple({"entity_id": i, "entity_type": "job", "provider_name": "P", "x_source_connector": "a",
                       "charge_month": month}.get(f.name) for f in schemas.EFFICIENCY.fields) for i in ids]
        return spark.createDataFrame(base, schemas.EFFICIENCY)

    lake.write_efficiency(spark, root, rows("xy"), "2024-05-01", "2024-05-31")
    heal = _breaking_move(monkeypatch, at=1)
    with pytest.raises(OSError):
        lake.write_efficiency(spark, root, rows("z"), "2024-05-01", "2024-05-31")
    heal()
    assert lake.complete_swap(spark, root)
    assert sorted(r["entity_id"] for r in spark.read.parquet(root).collect()) == ["z"]
    lake.write_efficiency(spark, root, rows("w", "2024-06"), "2024-06-01", "2024-06-30")
    assert sorted(r["entity_id"] for r in spark.read.parquet(root).collect()) == ["w", "z"]


def test_failed_publication_is_finished_by_the_next_reader(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "gold")
    view = spark.createDataFrame([("AWS", 1.0), ("GCP", 2.0)], "provider_name string, net_cost double")
    lake.publish_gold(spark, root, {"monthly_bill": view}, {})
    heal = _breaking_move(monkeypatch, at=2)
    with pytest.raises(OSError):
        lake.publish_gold(spark, root, {"monthly_bill": view.withColumn("net_cost", F.col("net_cost") * 10)}, {})
    heal()
    got = {g: scans.scan_gold(spark, root, g, "monthly_bill").first()["net_cost"] for g in ("aws", "gcp")}
    assert got == {"aws": 10.0, "gcp": 20.0}


def test_efficiency_refresh_of_one_connector_keeps_the_other(spark, tmp_path):
    root = str(tmp_path / "eff")

    def rows(connector, ids):
        base = [tuple({"entity_id": i, "entity_type": "job", "provider_name": "P", "x_source_connector": connector,
                       "charge_month": "2024-05"}.get(f.name) for f in schemas.EFFICIENCY.fields) for i in ids]
        return spark.createDataFrame(base, schemas.EFFICIENCY)

    lake.write_efficiency(spark, root, rows("a", "xy"), "2024-05-01", "2024-05-31")
    lake.write_efficiency(spark, root, rows("b", "z"), "2024-05-01", "2024-05-31")
    lake.write_efficiency(spark, root, rows("a", "q"), "2024-05-01", "2024-05-31")
    assert sorted(r[0] for r in scans.scan_plane(spark, root, schemas.EFFICIENCY).select("entity_id").collect()) == ["q", "z"]


def test_empty_snapshot_keeps_the_good_map(spark, tmp_path):
    root = str(tmp_path / "loc")
    row = {"location_kind": "catalog", "location_name": "c", "provider_name": "D", "snapshot_month": "2024-05"}
    rows = spark.createDataFrame([tuple(row.get(f.name) for f in schemas.STORAGE_LOCATION.fields)], schemas.STORAGE_LOCATION)
    assert lake.write_snapshot(rows, root) and not lake.write_snapshot(rows.where("false"), root)
    assert scans.scan_plane(spark, root, schemas.STORAGE_LOCATION).count() == 1


def test_new_driver_partitions_win_over_legacy(spark, tmp_path):
    new, old = str(tmp_path / "n"), str(tmp_path / "o")

    def rows(month, n):
        row = {"client_driver": "d", "query_count": n, "provider_name": "P", "charge_month": month}
        return spark.createDataFrame([tuple(row.get(f.name) for f in schemas.DRIVER_HEALTH.fields)], schemas.DRIVER_HEALTH)

    lake.write_monthly_plane(spark, new, rows("2024-05", 1), "2024-05-01", "2024-05-31")
    lake.replace_partitions(rows("2024-05", 9).unionByName(rows("2024-04", 7)), old, ["provider_name", "charge_month"])
    got = {r["charge_month"]: r["query_count"] for r in scans.scan_driver_health(spark, new, old).collect()}
    assert got == {"2024-05": 1, "2024-04": 7}


def test_publish_splits_providers_and_prunes_old_groups(spark, tmp_path):
    root = str(tmp_path / "gold")
    view = spark.createDataFrame([("AWS", 1), ("Google Cloud", 2)], "provider_name string, v int")
    lake.publish_gold(spark, root, {"v": view}, {"policy": {"p": view}})
    done = lake.publish_gold(spark, root, {"v": view.where("provider_name = 'Google Cloud'")}, {})
    assert done == ["google_cloud/v"] and Folder(spark, root).children(root) in (["google_cloud"], ["_staging", "google_cloud"])
    assert scans.scan_gold(spark, root, "google_cloud", "v").collect()[0]["v"] == 2


def test_export_window_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "x")
    spark.range(3).select(F.lit("SQL").alias("ServiceName"), F.lit("2024-05-01").cast("timestamp").alias("ChargePeriodStart"),
                          F.lit(1).alias("Cost")).write.parquet(path)
    df = scans.scan_bill_export(spark, [path], "2024-05-01", "2024-05-01", ["SQL"])
    plan = df._jdf.queryExecution().toString()
    assert df.count() == 3 and "GreaterThanOrEqual(ChargePeriodStart" in plan and "ServiceName" in plan.split("PushedFilters")[1]


def test_mapping_of_messy_rows(spark):
    export = spark.createDataFrame(
        [("AWS", " 2024-05-02 ", "abc", "NaN", "Weird", {"a": "1"}), ("AWS", "NULL", "1", "x", "Usage", None)],
        "ProviderName string, ChargePeriodStart string, BilledCost string, SkuId string, ChargeCategory string, Tags map<string,string>")
    row = mapping.map_focus_to_bronze(export, "c", "r").collect()
    assert len(row) == 1
    r = row[0]
    assert (float(r["billed_cost"]), r["sku_id"], r["charge_category"], r["tags"], r["charge_month"]) == (0.0, None, "Usage", '{"a":"1"}', "2024-05")
    assert r["billing_account_id"] == "unknown" and r["charge_period_end"] == r["charge_period_start"]
    assert list(r.asDict()) == schemas.BILL.names


def test_record_type_keeps_corrections_apart(spark):
    rows = [("2024-05-02", "5", "r1", t) for t in ("ORIGINAL", "RETRACTION", "ORIGINAL")]
    export = spark.createDataFrame(rows, "ChargePeriodStart string, BilledCost string, x_RecordId string, x_RecordType string")
    assert mapping.map_focus_to_bronze(export, "c", "r").count() == 2


def _months(spark, root):
    return [(r.provider_name, r.charge_month) for r in spark.read.parquet(root).select("provider_name", "charge_month").distinct().collect()]


@pytest.mark.parametrize("provider", ["A:B/c=d%e", "AB", "", None])
def test_monthly_plane_drops_months_that_are_gone(spark, tmp_path, provider):
    root = str(tmp_path / "plane")
    rows = lambda *m: spark.createDataFrame([(provider, x, 1) for x in m] + [("other", "2024-02", 1)], "provider_name string, charge_month string, n int")
    lake.write_monthly_plane(spark, root, rows("2024-01", "2024-02"), "2024-01-01", "2024-02-28")
    lake.write_monthly_plane(spark, root, rows("2024-01"), "2024-01-01", "2024-02-28")
    assert len(_months(spark, root)) == 2
    lake.write_monthly_plane(spark, root, rows("2024-03"), "2024-03-01", "2024-03-31")
    assert len(_months(spark, root)) == 3


def test_gold_leaves_out_nameless_providers_and_refuses_clashes(spark, tmp_path):
    view = spark.createDataFrame([("AWS", 1), (None, 2), ("", 3), (" ", 4)], "provider_name string, n int")
    assert lake.publish_gold(spark, str(tmp_path / "gold"), {"bill": view}, {}) == ["aws/bill"]
    clash = spark.createDataFrame([("A B", 1), ("a-b", 2)], "provider_name string, n int")
    with pytest.raises(ValueError):
        lake.publish_gold(spark, str(tmp_path / "gold"), {"bill": clash}, {})
    assert spark.read.parquet(str(tmp_path / "gold/aws/bill")).count() == 1


def test_charges_that_differ_in_any_column_are_kept(spark, bill_rows, tmp_path, monkeypatch):
    """Only rows equal in all bill columns are one charge, whichever load brought them."""
    from tallyspark.plans import lake_queries

    rows = bill_rows(
        {"day": "1997-04-02"}, {"day": "1997-04-02"}, {"day": "1997-04-02", "effective_cost": Decimal(2)}, {"day": "1997-04-02", "tags": '{"a":"b"}'},
        {"day": "1997-04-02", "ingest_run_id": "later"}, {"day": "1997-04-02", "region_id": ""}, {"day": "1997-04-02", "billing_account_id": "x"},
        {"day": "1997-04-02", "sku_id": "a|b", "region_id": "c"}, {"day": "1997-04-02", "sku_id": "a", "region_id": "b|c"})
    monkeypatch.setattr(lake_queries.dt, "bill", lambda s, f: rows)
    monkeypatch.setattr(lake_queries, "work_folder", lambda s, name: str(tmp_path / name))
    root, _ = lake_queries._bronze(spark, "", ("aws",))
    assert lake_queries.scans.scan_bronze_bill(spark, root).count() == 7


def test_efficiency_sources_sharing_a_month_both_survive(spark, tmp_path):
    root = str(tmp_path / "eff")

    def rows(ids, kind, connector="redshift", month="2024-05"):
        return spark.createDataFrame([(i, kind, "AWS", connector, month) for i in ids],
                                     "entity_id string, entity_type string, provider_name string, x_source_connector string, charge_month string")

    owner = [("AWS", "redshift")]
    plane, owners = lake.efficiency_plane({"patterns": (rows("ab", "query_pattern"), owner), "tables": (rows("c", "table"), owner)})
    lake.write_efficiency(spark, root, plane, "2024-05-01", "2024-05-31", owners)
    got = sorted((r["entity_type"], r["entity_id"]) for r in scans.scan_plane(spark, root, schemas.EFFICIENCY).collect())
    assert got == [("query_pattern", "a"), ("query_pattern", "b"), ("table", "c")]
    with pytest.raises(ValueError, match="does not declare"):
        lake.efficiency_plane({"patterns": (rows("a", "query_pattern", connector="other"), owner)})


def test_account_usage_months_with_other_types_are_widened(spark, tmp_path):
    import datetime as dt

    root = str(tmp_path / "au")
    may = spark.createDataFrame([(dt.date(2024, 5, 1), 1, "x", 2)], "START_TIME date, CREDITS int, NOTE string, ID int")
    june = spark.createDataFrame([(dt.date(2024, 6, 1), Decimal("2.5"), 7, 3)], "START_TIME date, CREDITS decimal(10,2), NOTE int, ID bigint")
    lake.write_account_usage({"METERING": may}, root, {"METERING": "START_TIME"}, "2024-06")
    lake.write_account_usage({"METERING": june}, root, {"METERING": "START_TIME"}, "2024-06")
    rows = scans.scan_account_usage(spark, root, "metering")
    types = dict(rows.dtypes)
    assert (types["credits"], types["note"], types["id"]) == ("double", "string", "bigint")
    assert sorted((r["credits"], r["note"], r["id"]) for r in rows.collect()) == [(1.0, "x", 2), (2.5, "7", 3)]
    assert scans.scan_account_usage(spark, root, "missing") is None


@pytest.mark.parametrize("most", [2**20, 0])
def test_only_rows_of_repeated_keys_are_gathered(spark, root, bill_rows, monkeypatch, most):
    """Rows with a key of their own reach their month's files where they are; null keys are one key, as for dropDuplicates."""
    gathered, real = [], lake.dedupe_exact

    def seen(rows):
        gathered.append(sorted(str(r["dedupe_key"]) for r in rows.select("dedupe_key").collect()))
        return real(rows)

    monkeypatch.setattr(lake, "dedupe_exact", seen)
    monkeypatch.setattr(lake, "MOST_REPEATS", most, raising=False)
    lake.write_bill_window(spark, root, "aws", "2024-04-01", "2024-05-31", bill_rows({"dedupe_key": "a"}, {"dedupe_key": "b"}, {"dedupe_key": None}))
    assert gathered == []
    assert sorted(str(r["dedupe_key"]) for r in _read(spark, root).collect()) == ["None", "a", "b"]
    rows = bill_rows(*[{"dedupe_key": k} for k in ("a", "b", "b", "c", None, None)])
    lake.write_bill_window(spark, root, "aws", "2024-04-01", "2024-05-31", rows)
    assert gathered == [["None", "None", "b", "b"] if most else ["None", "None", "a", "b", "b", "c"]]
    assert sorted(str(r["dedupe_key"]) for r in _read(spark, root).collect()) == ["None", "a", "b", "c"]
    assert Folder(spark, root).children(f"{root}/_staging") == []
