"""Session settings shared by the bench, the tests and callers without a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Call-site capture costs several JVM round trips per column expression.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    # 'YYYY-MM' partition values must stay text.
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    builder = SparkSession.builder.appName("tallyspark")
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
