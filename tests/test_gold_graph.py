"""GOLD build graph: order, errors, shared nodes built once, publication of every view."""

import pytest
from pyspark.sql import functions as F

from tallyspark.plans import gold


def test_order_puts_inputs_first_and_builds_only_what_is_needed():
    nodes = [
        gold.Node("v2", lambda a, b: a, ("s1", "s2"), gold.BY_PROVIDER),
        gold.Node("s2", lambda a: a, ("s1",)),
        gold.Node("s1", lambda: None),
        gold.Node("v1", lambda a: a, ("s1",), "efficiency"),
        gold.Node("lone", lambda: None),
    ]
    names = [n.name for n in gold.ordered(nodes)]
    assert names == ["s1", "v1", "s2", "v2"]  # views by name, each after its inputs; unused shared nodes left out
    assert [n.name for n in gold.ordered(nodes, ["v1"])] == ["s1", "v1"]
    assert [r[0] for r in gold.catalog_rows(nodes)] == ["v1", "v2"]


@pytest.mark.parametrize("nodes, message", [
    ([gold.Node("a", lambda b: b, ("b",), "g"), gold.Node("b", lambda a: a, ("a",))], "cycle"),
    ([gold.Node("a", lambda b: b, ("missing",), "g")], "unknown"),
    ([gold.Node("a", lambda: None, (), "g"), gold.Node("a", lambda: None, (), "g")], "twice"),
])
def test_graph_errors(nodes, message):
    with pytest.raises(ValueError, match=message):
        gold.ordered(nodes)


def test_shared_node_is_stored_once_and_every_view_is_published(spark, tmp_path):
    calls = []

    def source():
        calls.append(1)
        return spark.createDataFrame([("AWS", 1.0), ("Databricks", 2.0), ("AWS", 3.0)], "provider_name string, cost double")

    nodes = [
        gold.Node("silver", source),
        gold.Node("by_provider_total", lambda s: s.groupBy("provider_name").agg(F.sum("cost").alias("cost")), ("silver",), gold.BY_PROVIDER),
        gold.Node("count", lambda s: s.agg(F.count("*").alias("n")), ("silver",), "summary"),
    ]
    root = str(tmp_path / "gold")
    produced = gold.publish(spark, root, nodes)
    assert calls == [1]
    assert produced == ["aws/by_provider_total", "databricks/by_provider_total", "summary/count"]
    assert spark.read.parquet(f"{root}/aws/by_provider_total").first()["cost"] == 4.0
    assert spark.read.parquet(f"{root}/summary/count").first()["n"] == 3


@pytest.mark.parametrize("view, unread", [
    ("spend_by_service_month", "tags"), ("sku_month_over_month", "invoice_id"), ("invoice_reconciliation_month", "tags"), ("resource_month", "tags")])
def test_a_view_alone_stores_only_the_bill_columns_it_reads(spark, tmp_path, view, unread):
    import datetime as dt

    from tallyspark.plans import lake_queries

    def put(name, schema, *row, times=1):
        spark.createDataFrame([row] * times, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    day = dt.datetime(1998, 3, 4)
    put("lineitem", "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
        "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp", 1, 4, 1, 1, 5.0, 100.0, 0.1, 0.0, "N", "O", day)
    put("part", "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double", 4, "p", "Brand#7", "t", 3, 1.0)
    put("orders", "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
        1, 2, "O", 1.0, day, "HIGH")
    put("customer", "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", 2, "c", 3, 1.0, "AUTO", times=2)
    put("supplier", "s_suppkey long, s_name string, s_nationkey int, s_acctbal double", 1, "s", 3, 1.0)
    put("nation", "n_nationkey int, n_name string", 3, "CANADA")
    rows = lake_queries._read_back(spark, str(tmp_path), view).collect()
    assert [r["provider_name"] for r in rows] == ["Databricks"]
    silver = next(n for n in lake_queries.gold_graph(spark, str(tmp_path), [view]) if n.name == "silver_bill")
    lines = silver.build()
    # The customer comes twice, and so does its line, also for views that read nothing of customers.
    assert unread not in lines.columns and lines.count() == 2
