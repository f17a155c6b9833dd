"""Large tables move as few and as narrow rows between tasks as their job needs."""

import re

import pytest

from tallyspark.operators import mapping, silver, spend
from tallyspark.plans import lake_queries, mapping_queries
from tallyspark.sinks import lake
from tallyspark.sources import driver_tables as dt
from tallyspark.sources import export_tables

TABLES = {
    "lineitem": "SELECT * FROM VALUES (1L, 2L, 3L, 1, 5D, 7.5D, 0.05D, 0.02D, 'A', 'F', TIMESTAMP '1997-01-02'), (1L, 2L, 3L, 1, 5D, 7.5D, 0.05D, 0.02D, 'A', 'F', "
                "TIMESTAMP '1997-01-02'), (2L, 9L, 4L, 2, 5D, 7.5D, 0.05D, 0.02D, 'R', 'F', TIMESTAMP '1997-02-02'), (3L, NULL, 5L, 3, 5D, 7.5D, 0.05D, 0.02D, 'N', "
                "'O', TIMESTAMP '1997-03-02'), (NULL, 3L, 5L, 4, 5D, 7.5D, 0.05D, 0.02D, 'A', 'F', TIMESTAMP '1997-03-02'), (8L, 3L, NULL, 5, NULL, 7.5D, 0.05D, 0.02D, "
                "NULL, 'F', TIMESTAMP '1997-03-02') AS t(l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, "
                "l_returnflag, l_linestatus, l_shipdate)",
    "orders": "SELECT * FROM VALUES (1L, 4L, '1-URGENT'), (2L, 5L, '2-HIGH'), (2L, 4L, '2-HIGH'), (3L, NULL, '3'), (NULL, 4L, '4'), (8L, 77L, NULL) "
              "AS t(o_orderkey, o_custkey, o_orderpriority)",
    "customer": "SELECT * FROM VALUES (4L, 6L, 'BUILDING'), (4L, 7L, 'AUTO'), (NULL, 8L, 'x'), (5L, NULL, NULL) AS t(c_custkey, c_nationkey, c_mktsegment)",
    "part": "SELECT * FROM VALUES (2L, 'BRASS', 'Brand#1', 3L), (3L, 'TIN', 'Brand#2', 10L), (NULL, 'X', 'Y', 1L) AS t(p_partkey, p_type, p_brand, p_size)",
    "supplier": "SELECT * FROM VALUES (3L, 6L), (4L, NULL), (5L, 9L) AS t(s_suppkey, s_nationkey)",
    "nation": "SELECT * FROM VALUES (6L, 'CHINA'), (7L, 'PERU') AS t(n_nationkey, n_name)",
}


@pytest.fixture()
def tables(spark, tmp_path):
    for name, sql in TABLES.items():
        spark.sql(sql).write.parquet(f"{tmp_path}/in/{name}.parquet")
    return f"{tmp_path}/in"


@pytest.fixture()
def no_broadcast(spark):
    """Tables of any size count as too large to broadcast, and plans show every exchange."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    old = {n: spark.conf.get(n) for n in names}
    for n, value in zip(names, ("-1", "false"), strict=True):
        spark.conf.set(n, value)
    yield
    for n, value in old.items():
        spark.conf.set(n, value)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(df):
    return sorted(map(str, df.collect()))


def test_bill_lines_move_once_to_their_order_and_customer(spark, tables, no_broadcast):
    moved = dt.bill(spark, tables)
    plan = _plan(moved)
    assert len(re.findall(r"Exchange hashpartitioning\(l_orderkey", plan)) == 1
    below = plan.split("Exchange hashpartitioning(o_custkey")[1].split("FileScan")
    assert "Join" not in below[0] and "o_custkey" in below[1].split("]")[0]  # orders move to customers, bill lines do not
    found = _rows(moved)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    assert found == _rows(dt.bill(spark, tables)) and len(found) == 10


def test_export_reads_the_bill_once(spark, tables, no_broadcast):
    export = export_tables.focus_export(spark, tables)
    assert _plan(export).count("FileScan parquet [l_") == 1
    assert _rows(export) == _rows(dt.plane(spark, tables, "focus_export"))


def test_export_keys_are_grouped_as_bytes(spark, tables, no_broadcast):
    keys = mapping_queries._m7(spark, tables)
    assert "unhex(" in _plan(keys) and "Exchange hashpartitioning(dedupe_key" not in _plan(keys)
    want = mapping_queries._count(mapping.stringify_columns(export_tables.focus_export(spark, tables)), mapping.dedupe_key("exporter").alias("dedupe_key"))
    assert _rows(keys) == _rows(want) and keys.dtypes == want.dtypes


def test_mapped_export_is_dealt_by_files(spark, tables, no_broadcast):
    bronze = mapping.map_focus_to_bronze(export_tables.focus_export(spark, tables), "exporter", "run-1", by_files=True)
    shuffled = mapping.map_focus_to_bronze(export_tables.focus_export(spark, tables), "exporter", "run-1")
    assert "Exchange hashpartitioning(dedupe_key" in _plan(shuffled) and _rows(bronze.drop("x_ingested_at")) == _rows(shuffled.drop("x_ingested_at"))
    assert "Exchange" not in _plan(bronze) and "x_ingested_at" in bronze.columns
    again = [bronze.drop("x_ingested_at"), bronze.drop("x_ingested_at")]
    assert _rows(again[0]) == _rows(again[1])
    keys = [r[0] for r in bronze.select("dedupe_key").collect()]
    assert sorted(keys) == sorted(r[0] for r in mapping_queries._m7(spark, tables).select("dedupe_key").collect())
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("tallyspark_")]


def test_bill_is_stored_once(spark, tables, tmp_path, monkeypatch):
    monkeypatch.setattr(lake_queries, "work_folder", lambda s, name: str(tmp_path / "work" / name))
    root, source = lake_queries._bronze(spark, tables)
    assert [p.name for p in (tmp_path / "work").iterdir()] == ["bill"]
    stored = lake_queries.scans.scan_bronze_bill(spark, root)
    keyed = [r["dedupe_key"] for r in source.collect() if r["x_source_connector"]]
    assert sorted(r["dedupe_key"] for r in stored.collect()) == sorted(set(keyed))


def test_resource_charges_move_once_where_few_share_a_key(spark, bill_rows, no_broadcast):
    rows = bill_rows(*[{"resource_id": f"r{i // 4}", "cost": i, "charge_description": f"d{i % 3}", "sku_id": s} for i in range(8) for s in ("a", "b")][:13])
    few = bill_rows(*[{"resource_id": f"r{i}", "cost": i, "charge_description": "d"} for i in range(8)])
    for lines, exchanges in ((few, 1), (rows, 2)):
        lines = silver.provider_bill(silver.focus_normalized(lines, "2024-05-11"))
        view = spend.resource_month(lines, stored=True)
        assert len(re.findall(r"Exchange hashpartitioning", _plan(view))) == exchanges
        assert _rows(view) == _rows(spend.resource_month(lines))


def test_published_view_is_not_moved_again(spark, tmp_path, monkeypatch):
    view = spark.createDataFrame([("AWS", 1), ("Google Cloud", 2)], "provider_name string, v int")
    hints, real = [], type(view).hint
    monkeypatch.setattr(type(view), "hint", lambda self, *a: hints.append(a) or real(self, *a))
    assert lake.publish_gold(spark, str(tmp_path / "gold"), {"v": view}, {}) == ["aws/v", "google_cloud/v"]
    assert lake.publish_gold(spark, str(tmp_path / "none"), {"v": view.where("false")}, {}) == []
    with pytest.raises(ValueError, match="share the group"):
        lake.publish_gold(spark, str(tmp_path / "gold"), {"v": spark.createDataFrame([("--", 1)], view.schema)}, {})
    assert hints == [] and spark.read.parquet(str(tmp_path / "gold/aws/v")).count() == 1
