"""The wide input planes are derived by code that the JVM compiles."""

import re

from tallyspark.plans import lake_queries
from tallyspark.sources import driver_tables as dt
from tallyspark.sources import export_tables

# HotSpot leaves methods longer than this to its interpreter.
LONGEST = 8000
TABLES = {
    "lineitem": """SELECT 1L AS l_orderkey, 2L AS l_partkey, 3L AS l_suppkey, 1L AS l_linenumber, 5.0D AS l_quantity, 7.5D AS l_extendedprice,
        0.05D AS l_discount, 0.02D AS l_tax, 'A' AS l_returnflag, 'F' AS l_linestatus, TIMESTAMP '1997-01-02 00:00:00' AS l_shipdate""",
    "orders": "SELECT 1L AS o_orderkey, 4L AS o_custkey, '1-URGENT' AS o_orderpriority",
    "customer": "SELECT 4L AS c_custkey, 6L AS c_nationkey, 'BUILDING' AS c_mktsegment",
    "part": "SELECT 2L AS p_partkey, 'BRASS' AS p_type, 'Brand#1' AS p_brand, 3L AS p_size",
    "supplier": "SELECT 3L AS s_suppkey, 6L AS s_nationkey",
    "nation": "SELECT 6L AS n_nationkey, 'CHINA' AS n_name",
}


def _longest(spark, df):
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    text = df._jdf.queryExecution().explainString(mode)
    return max(int(size) for size in re.findall(r"maxMethodCodeSize:(\d+)", text))


def test_export_is_derived_by_short_methods_and_keeps_its_rows(spark, tmp_path):
    for name, sql in TABLES.items():
        spark.sql(sql).write.parquet(f"{tmp_path}/{name}.parquet")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plain, short = dt.plane(spark, str(tmp_path), "focus_export"), export_tables.focus_export(spark, str(tmp_path))
        assert _longest(spark, plain) > LONGEST > _longest(spark, short)
        assert short.columns == plain.columns
        assert sorted(map(str, short.collect())) == sorted(map(str, plain.collect())) and plain.count() == 2
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_keyed_bill_is_derived_by_short_methods_and_keeps_its_rows(spark, tmp_path):
    for name, sql in TABLES.items():
        spark.sql(sql).write.parquet(f"{tmp_path}/{name}.parquet")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plain = dt.bill(spark, str(tmp_path)).withColumn("dedupe_key", lake_queries._bill_key())
        short = lake_queries._keyed_bill(spark, str(tmp_path))
        assert _longest(spark, plain) > LONGEST > _longest(spark, short)
        assert short.columns == plain.columns
        assert short.collect() == plain.collect() and plain.count() == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
