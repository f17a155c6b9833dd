import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.functions import coerce, labels
from tallyspark.operators import backing, databricks, drilldown, frame, redshift
from tallyspark.plans import catalog

URLS = [
    ("s3://b/a/c/", ("s3", "AWS", "b", "a/c")), ("s3://b", ("s3", "AWS", "b", None)), ("s3://b/", ("s3", "AWS", "b", None)),
    ("abfss://c@acct.dfs.core.windows.net/x", ("abfss", "Microsoft", "c@acct.dfs.core.windows.net", "x")),
    ("gs://g/p", ("gs", "Google Cloud", "g", "p")), ("dbfs:/user", ("dbfs", None, None, None)),
    ("plain", ("other", None, None, None)), ("S3A://B/x", ("s3a", "AWS", "B", "x")), ("ftp://h/x", ("ftp", None, "h", "x")),
]


def test_storage_urls(spark):
    df = spark.createDataFrame([(u,) for u, _ in URLS], "u string")
    rows = df.select(*labels.parse_storage_url(F.col("u")).values()).collect()
    assert [tuple(r) for r in rows] == [want for _, want in URLS]


DRIVERS = [("JDBC 3.14.5", "supported"), ("JDBC 3.14.4", "unsupported"), ("Go 1.10.0", "supported"), ("Snowflake UI", "unknown"),
           ("Python Connector 3.7.0", "supported"), (None, "unknown"), ("JDBC 3.14", "unknown"), (" SnowSQL 1.3.99 ", "unsupported")]


def test_driver_support(spark):
    df = spark.createDataFrame([(d,) for d, _ in DRIVERS], "d string")
    assert [r[0] for r in df.select(labels.driver_support_status(F.col("d"))).collect()] == [w for _, w in DRIVERS]


def test_null_words(spark):
    df = spark.createDataFrame([("  null ",), ("NaN",), ("",), (" x ",), (None,)], "t string")
    assert [r[0] for r in df.select(coerce.nz(F.col("t"))).collect()] == [None, None, None, "x", None]


@pytest.mark.parametrize("text,want", [("spectrum storage", "spectrum_scan"), ("Node usage", "compute"), ("unused commitment", None), ("hm", "other")])
def test_cost_subcategory(spark, text, want):
    c = labels.cost_subcategory(F.lit("Amazon Redshift"), F.lit("Usage"), F.lit(text), F.lit(None).cast("string"))
    assert spark.range(1).select(c).first()[0] == want


def test_project_tag_matches_the_folded_key_only(spark):
    df = spark.createDataFrame([('{"cost-project":"no","PROJECT ":"yes"}',), ('{"cost-project":"no"}',), ("bad",)], "t string")
    got = [r[0] for r in df.select(labels.tag_lookup(coerce.tag_map(F.col("t")), "project")).collect()]
    assert got == ["yes", None, None]


@pytest.mark.parametrize("levels", [None, (1, 2, 4, 8, 37)])
def test_exact_percentiles_match_numpy(spark, monkeypatch, levels):
    if levels:  # coarse first buckets: ranks are found only by refinement
        monkeypatch.setattr(frame, "_LEVEL_BITS", levels)
    rng = np.random.default_rng(7)
    hot = np.concatenate([rng.integers(0, 50, 20_000), rng.exponential(1000, 30_000), -rng.random(500), [0.0, -0.0, 1e-310]])
    rows = [("hot", float(v)) for v in hot] + [("one", 4.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    out = {r["k"]: r for r in frame.exact_percentiles(df, ["k"], "v", {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99}).collect()}
    for name, p in (("p0", 0), ("p50", 50), ("p95", 95), ("p99", 99)):
        assert out["hot"][name] == pytest.approx(np.percentile(hot, p), rel=1e-12)
    assert out["one"]["p95"] == 4.0 and out["none"]["p50"] is None


def test_percentiles_of_several_columns_in_one_pass(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(0, 1e6, 5000), rng.integers(0, 3, 5000).astype(float)
    rows = [(float(x), float(y) if i % 3 else None) for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "a double, b double")
    (got,) = frame.percentiles(df, [], {"a37": ("a", 0.37), "a99": ("a", 0.99), "b50": ("b", 0.5)}).collect()
    kept = [y for i, y in enumerate(b) if i % 3]
    assert got["a37"] == pytest.approx(np.percentile(a, 37), rel=1e-12) and got["a99"] == pytest.approx(np.percentile(a, 99), rel=1e-12)
    assert got["b50"] == np.percentile(kept, 50)
    (empty,) = frame.percentiles(df.where("false"), [], {"a50": ("a", 0.5)}).collect()
    assert empty["a50"] is None
    inf = spark.createDataFrame([(float("inf"),), (1.0,), (float("-inf"),)], "a double")
    (edge,) = frame.percentiles(inf, [], {"lo": ("a", 0.0), "mid": ("a", 0.5), "hi": ("a", 1.0)}).collect()
    assert (edge["lo"], edge["mid"], edge["hi"]) == (float("-inf"), 1.0, float("inf"))


def test_price_change_prices_each_row_once(spark):
    usage = spark.createDataFrame(
        [("s", "AWS", dt.datetime(2024, 5, 1), 2.0)], "sku_name string, cloud string, usage_end_time timestamp, q double")
    t = dt.datetime
    prices = spark.createDataFrame(
        [("s", "AWS", 1.0, t(2024, 1, 1), t(2024, 5, 1)), ("s", "AWS", 3.0, t(2024, 5, 1), t(2030, 1, 1))],
        "sku_name string, cloud string, unit_price double, price_start_time timestamp, price_end_time timestamp")
    rows = databricks._valid_price(usage, databricks._index(prices), "sku_name", "p").collect()
    assert [r["p"] for r in rows] == [3.0]


def test_latest_row_prefers_any_date_over_none(spark):
    df = spark.createDataFrame([("a", None, "x"), ("a", 1, "y"), ("b", None, "z")], "k string, v int, p string")
    got = {r["k"]: r["p"] for r in frame.latest_by_key(df, ["k"], "v", ["p"]).collect()}
    assert got == {"a": "y", "b": "z"}


def test_allocation_reconciles_to_the_whole_cost(spark):
    d = dt.date
    cost = spark.createDataFrame([(d(2024, 5, 1), 100.0), (d(2024, 6, 1), 50.0)], "charge_month date, cost double")
    shares = spark.createDataFrame([(d(2024, 5, 1), "a", 30.0, "n"), (d(2024, 5, 1), "b", 10.0, "n")],
                                   "charge_month date, owner_user string, share double, note string")
    got = {r["owner_user"]: r["allocated_cost"] for r in drilldown.allocate_cost_to_users(cost, shares).collect()}
    assert got == pytest.approx({"a": 75.0, "b": 25.0, drilldown.UNALLOCATED: 50.0})


def test_capped_series_keep_the_total(spark):
    df = spark.createDataFrame([(f"s{i}", float(i)) for i in range(1, 9)], "s string, v double")
    out = {r["s"]: r["v"] for r in drilldown.cap_series(df, "s", "v", 4).collect()}
    assert set(out) == {"s8", "s7", "s6", "Other"} and sum(out.values()) == 36.0
    assert drilldown.cap_series(df, "s", "v", 8).count() == 8


def test_shared_bucket_does_not_multiply_cost(spark):
    cols = "location_kind string, location_name string, key_prefix string, cloud_provider_name string, bucket_name string, provider_name string, snapshot_month string"
    loc = spark.createDataFrame([("catalog", "a", "p", "AWS", "b", "D", "2024-05"), ("catalog", "c", "q", "AWS", "b", "D", "2024-05"),
                                 ("catalog", "old", None, "AWS", "b", "D", "2024-04")], cols)
    lines = spark.createDataFrame(
        [("AWS", "Amazon Simple Storage Service", "arn:aws:s3:::b", None, None, dt.date(2024, 5, 1), 10.0, False, False)],
        "provider_name string, service_name string, resource_id string, x_cost_subcategory string, region_id string, charge_month date, "
        "cost double, is_credit boolean, is_partial_period boolean")
    row = backing.backing_storage_month(lines, loc).collect()
    assert len(row) == 1 and row[0]["net_cost"] == 10.0
    assert (row[0]["managed_name"], row[0]["mapping_confidence"], row[0]["location_count"]) == ("(shared by 2 catalogs)", "prefix_scoped", 2)


def test_context_header_is_skipped_for_its_user(spark):
    t = dt.datetime
    head = "-- Looker Query Context ".ljust(143)
    rows = [(1, 102, t(2024, 5, 1), t(2024, 5, 1, 1), head + "select 1"), (2, 102, t(2024, 5, 1), t(2024, 5, 1, 1), head + "select 1"),
            (3, 7, t(2024, 5, 1), t(2024, 5, 1, 1), "select 1")]
    q = spark.createDataFrame(rows, "query bigint, userid int, starttime timestamp, endtime timestamp, querytxt string")
    wlm = spark.createDataFrame([], "query bigint, total_exec_time bigint, total_queue_time bigint")
    rep = spark.createDataFrame([], "query bigint, is_diskbased string, bytes bigint, workmem bigint, rows_out bigint")
    users = spark.createDataFrame([(102, "bi"), (7, "me")], "usesysid int, usename string")
    out = redshift.query_patterns(
        q, wlm, rep, users, "2024-05-01", "2024-05-31", context_header=(102, "-- Looker Query Context", 144)).collect()
    assert len(out) == 1 and out[0]["run_count"] == 3 and out[0]["top_user"] == "bi"


@pytest.mark.parametrize("start,end,want", [("2024-05-01", "2024-05-31", "2024-05-25"), ("2024-05-30", "2024-05-31", "2024-05-30")])
def test_log_window_is_capped(start, end, want):
    assert redshift.capped_window(start, end)[0] == want


@pytest.mark.parametrize("sql", [
    "delete from v", "select 1; select 2", "select * from parquet.`/etc`", "with x as (select 1) insert into v select * from x",
    "select java_method('java.lang.System','exit',0)", "select * from silver.x", "select * from read_files('/x')", "drop table v",
    "select * from v) as q --", "select * from parquet/**/.`/etc`", "select * from session_table", "select * from default.v", "show tables",
    "select (select count(*) from session_table) as n from v", "select * from v where a in (select a from session_table)",
    "with x as (select * from session_table) select * from x", "select * from range(5)", "select * from v where exists (select 1 from json.`/x`)"])
def test_guard_rejects(spark, sql):
    with pytest.raises(catalog.QueryError):
        catalog.run_select(spark, {"v": spark.range(3).toDF("a")}, sql)


def test_guard_passes_queries(spark):
    spark.range(1).createOrReplaceTempView("session_table")
    views = {"v": spark.range(2000).selectExpr("id as a", "'load set; cache' as t"), "w": spark.range(3).toDF("a")}
    run = lambda sql, **k: catalog.run_select(spark, views, sql, **k)
    assert run("select * from v").count() == 2000
    assert run("select * from v where t = 'load set; cache' -- drop", limit=5).count() == 5
    sql = """with x as (select a from v), y as (select a from x where a in (select a from w))
      select y.a, sum(w.a) over (partition by y.a) as s, (select max(a) from w) as m from y join w on y.a = w.a order by 1 limit 2"""
    assert [tuple(r) for r in run(sql).collect()] == [(0, 0, 2), (1, 1, 2)]
    assert not spark.catalog.tableExists("w")


def test_query_view_checks_names_and_direction(spark):
    views = {"v": spark.createDataFrame([("AWS", 1.0, 2.0), ("GCP", 5.0, 1.0)], "provider_name string, net_cost double, list_cost double")}
    rows = catalog.query_view(views, "v", order_by="net_cost DESC", measures=["net_cost"]).collect()
    assert [tuple(r) for r in rows] == [("GCP", 5.0), ("AWS", 1.0)]
    assert catalog.query_view(views, "v", filters={"provider_name": ["AWS"]}).count() == 1
    for bad in ({"filters": {"x": 1}}, {"order_by": "x"}, {"measures": ["provider_name"]}, {"filters": {"provider_name": []}}):
        with pytest.raises(catalog.QueryError):
            catalog.query_view(views, "v", **bad)


def test_thresholds_file(tmp_path):
    path = tmp_path / "p.yml"
    assert catalog.load_thresholds(str(path))["underutilized_pct"] == 20
    path.write_text("thresholds:\n  underutilized_pct: 5  # strict\n")
    assert catalog.load_thresholds(str(path))["underutilized_pct"] == 5
    for bad in ("nope: 1\n", "- a\n", "underutilized_pct: 500\n"):
        path.write_text(bad)
        with pytest.raises(ValueError):
            catalog.load_thresholds(str(path))


@pytest.mark.parametrize("broadcast", [True, False])
def test_price_index_open_ends_overlaps_and_gaps(spark, monkeypatch, broadcast):
    from tallyspark.operators import price_index as pi

    if not broadcast:
        monkeypatch.setattr(pi, "BROADCAST_BYTES", -1)
    t = dt.datetime
    prices = spark.createDataFrame([
        ("s", "A", 1.0, t(2024, 1, 1), t(2024, 3, 1)),
        ("s", "A", 2.0, t(2024, 3, 1), None),  # open end
        ("s", "A", 9.0, t(2024, 2, 1), t(2024, 2, 10)),  # overlaps the first: started last, holds
        ("s", "A", 5.0, t(2024, 6, 1), t(2024, 5, 1)),  # ends before it starts: never valid
        ("g", "A", 4.0, t(2024, 1, 1), t(2024, 1, 2)),
        ("n", "A", 4.0, None, t(2024, 1, 2)),  # no start: never valid
    ], "sku_name string, cloud string, unit_price double, price_start_time timestamp, price_end_time timestamp")
    index = pi.price_index(prices, ["sku_name", "cloud"], F.col("unit_price"), "price_start_time", "price_end_time")
    at = [("s", t(2023, 12, 31)), ("s", t(2024, 1, 1)), ("s", t(2024, 2, 5)), ("s", t(2024, 2, 10)), ("s", t(2024, 3, 1)),
          ("s", t(2030, 1, 1)), ("g", t(2024, 1, 2)), ("n", t(2024, 1, 1)), ("x", t(2024, 1, 1)), (None, t(2024, 1, 1)), ("s", None)]
    usage = spark.createDataFrame([(i, s, "A", e) for i, (s, e) in enumerate(at)], "i int, sku string, cloud string, e timestamp")
    got = {r["i"]: r["p"] for r in pi.with_price(usage, index, [(F.col("sku"), "sku_name"), (F.col("cloud"), "cloud")], F.col("e"), "p").collect()}
    assert got == {0: None, 1: 1.0, 2: 9.0, 3: 1.0, 4: 2.0, 5: 2.0, 6: None, 7: None, 8: None, 9: None, 10: None}
    many = spark.createDataFrame([("s", "A", float(k), t(2024, 1, 1) + dt.timedelta(days=k), t(2024, 1, 1) + dt.timedelta(days=k + 1)) for k in range(300)],
                                 "sku_name string, cloud string, unit_price double, price_start_time timestamp, price_end_time timestamp")
    big = pi.price_index(many, ["sku_name", "cloud"], F.col("unit_price"), "price_start_time", "price_end_time")
    days = spark.createDataFrame([(k, "s", "A", t(2024, 1, 1, 12) + dt.timedelta(days=k)) for k in range(-2, 303)], "i int, sku string, cloud string, e timestamp")
    found = {r["i"]: r["p"] for r in pi.with_price(days, big, [(F.col("sku"), "sku_name"), (F.col("cloud"), "cloud")], F.col("e"), "p").collect()}
    assert found == {k: (float(k) if 0 <= k < 300 else None) for k in range(-2, 303)}


def test_run_select_puts_back_the_callers_view(spark):
    spark.createDataFrame([(42,)], "a int").createOrReplaceTempView("mine")
    got = catalog.run_select(spark, {"mine": spark.range(3).toDF("a")}, "SELECT count(*) AS n FROM mine").first()["n"]
    assert got == 3 and spark.table("mine").first()["a"] == 42
    spark.catalog.dropTempView("mine")


def test_retention_ledger_intersects_logs_with_the_window(spark):
    from tallyspark.operators import redshift

    t = dt.datetime
    a = spark.createDataFrame([(t(2024, 5, 3, 10),), (t(2024, 6, 2),)], "ts timestamp")
    b = spark.createDataFrame([(t(2024, 4, 20),), (t(2024, 5, 20),)], "ts timestamp")
    empty = spark.createDataFrame([], "ts timestamp")
    rows = {r["log_table"]: r for r in redshift.retention_ledger({"a": (a, "ts"), "b": (b, "ts")}, "2024-05-01", "2024-05-31").collect()}
    assert (rows["a"]["effective_from"], rows["a"]["effective_to"], rows["a"]["truncated"]) == (dt.date(2024, 5, 3), dt.date(2024, 5, 31), True)
    assert (rows["b"]["effective_from"], rows["b"]["effective_to"], rows["b"]["truncated"]) == (dt.date(2024, 5, 1), dt.date(2024, 5, 20), False)
    assert (rows["*"]["covered_from"], rows["*"]["covered_to"], rows["*"]["complete"]) == (dt.date(2024, 5, 3), dt.date(2024, 5, 20), False)
    assert rows["a"]["capped_from"] == dt.date(2024, 5, 25)
    none = {r["log_table"]: r for r in redshift.retention_ledger({"a": (a, "ts"), "e": (empty, "ts")}, "2024-05-01", "2024-05-31").collect()}
    assert none["*"]["effective_from"] is None and none["*"]["truncated"] and none["e"]["covered_from"] is None
