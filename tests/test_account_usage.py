"""Byte sums of the account-usage views past the range of a bigint."""

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import account_usage as au

HUGE = 1 << 62
_TB = 1024.0**4


@pytest.fixture()
def history(spark):
    rows = [(f"q{i}", "WH", "SUCCESS", "SELECT", "h", None, HUGE, HUGE, HUGE, 10.0, 1000) for i in range(6)]
    return spark.createDataFrame(
        rows, "query_id string, warehouse_name string, execution_status string, query_type string, query_hash string, "
              "query_parameterized_hash string, bytes_scanned bigint, bytes_spilled_to_local_storage bigint, "
              "bytes_spilled_to_remote_storage bigint, percentage_scanned_from_cache double, total_elapsed_time bigint")


def test_a20_bytes_of_a_warehouse_add_up_past_a_bigint(spark, history):
    credits = history.select("query_id", F.lit(2).cast("decimal(18,4)").alias("credits_attributed_compute"))
    # Attributed twice: each query's bytes count twice.
    row = au.warehouse_cost_efficiency({"query_history": history, "query_attribution_history": credits.unionAll(credits)}).first()
    assert row["scanned_tb"] == round(12 * HUGE / _TB, 2) and row["spilled_gb"] == round(24 * HUGE / 1024.0**3, 2)


def test_a22_bytes_of_a_query_pattern_add_up_past_a_bigint(history):
    row = au.expensive_query_patterns({"query_history": history}).first()
    assert row["tb_scanned"] == round(6 * HUGE / _TB, 2) and row["gb_remote_spill"] == round(6 * HUGE / 1024.0**3, 2)


def test_a23_bytes_of_a_query_shape_add_up_past_a_bigint(history):
    assert au.cache_reuse_opportunity({"query_history": history}).first()["tb_scanned"] == round(6 * HUGE / _TB, 2)


def test_a31_bytes_of_a_transfer_route_add_up_past_a_bigint(spark):
    rows = spark.createDataFrame(
        [("COPY", "AWS", "r1", "GCP", "r2", HUGE)] * 3,
        "transfer_type string, source_cloud string, source_region string, target_cloud string, target_region string, bytes_transferred bigint")
    assert au.data_transfer_drivers({"data_transfer_history": rows}).first()["tb_transferred"] == round(3 * HUGE / _TB, 3)
