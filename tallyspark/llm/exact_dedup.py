"""Exact deduplication by a stateful stream with disk-backed keyed state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import stored, text_of, work_path

STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    # Many small stores: without it each sets aside megabytes of log files and uploads all it holds after a batch.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Late batches must see every digest ever seen, so no state is ever dropped; old versions of it are.
    "spark.sql.streaming.minBatchesToRetain": "2",
}


def _located(frame: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Digest, identifier and content locator (file, row in the file) of every row, with its text."""
    text = text_of(text_col)
    return frame.select(
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.col(id_col).alias("doc_id"),
        F.struct(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("position")).alias("locator"),
        text.alias("body"),
    )


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(
        F.max(F.struct("doc_id", "locator")).alias("keeper"), F.count(F.lit(1)).alias("group_size"))


def stream_groups(
    spark: SparkSession, path: str, *, id_col: str = "doc_id", text_col: str = "text",
    state_path: str | None = None, bytes_per_batch: int = 8 << 30,
) -> DataFrame:
    """One row per digest of the Parquet table at `path`: digest, keeper (doc_id, locator), group_size.

    The table is read as a stream of new files. Per digest the state keeps the count, the largest identifier
    and where that row's content lies; it lives in a disk-backed store and never expires. `state_path` holds
    the stream's checkpoint and what it has emitted: a later call with the same path only reads files that
    came since, and a call after a crash goes on where it stopped (a repeated batch overwrites its own output).
    Without it a fresh path in the shared folder is taken.
    Null identifiers are smaller than any other; equal identifiers are told apart by the locator.
    """
    root = state_path or work_path(spark, "exact-dedup")
    table = spark.read.parquet(path)
    source = table.select(id_col, text_col)
    before = {k: spark.conf.get(k, None) for k in STATE_SETTINGS}
    for key, value in STATE_SETTINGS.items():
        spark.conf.set(key, value)
    try:
        # A table without files starts no batch; its groups are none.
        _grouped(_located(table, id_col, text_col)).where("false").write.mode("overwrite").parquet(f"{root}/groups/none")
        # A stream takes a single file only by a pattern.
        pattern = f"{path.rstrip('/')[:-1]}[{path.rstrip('/')[-1]}]"
        # Files count as new whatever their age: copied and restored ones can be older than those already seen.
        reader = spark.readStream.schema(source.schema).option("maxBytesPerTrigger", str(bytes_per_batch)).option("maxFileAge", "36500d")
        rows = _located(reader.parquet(pattern), id_col, text_col)
        seen = _grouped(rows)

        def emit(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{root}/groups/batch={number}")

        query = (
            seen.writeStream.outputMode("update").option("checkpointLocation", f"{root}/state")
            .foreachBatch(emit).trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    # An updated group is emitted again; both values only grow, so the largest are the newest.
    schema = seen.schema
    return (
        spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{root}/groups")
        .groupBy("digest").agg(F.max("keeper").alias("keeper"), F.max("group_size").alias("group_size")))


def exact_duplicates(
    spark: SparkSession, path: str, *, id_col: str = "doc_id", text_col: str = "text", state_path: str | None = None,
    bytes_per_batch: int = 8 << 30,
) -> DataFrame:
    """Every row of the Parquet table at `path` with the row of equal text that stays.

    Texts are equal when their bytes are; null counts as empty. Of equal texts the row with the largest
    identifier stays (a null one only if all are null; of rows with the same identifier, the one stored last).
    Returns doc_id, keep_id, group_size, kept, text_sha256. An empty table gives no rows; further columns of
    the table are not read, so their names do not matter.

    The stream's state finds rows with equal digests; each such hit is then compared byte by byte. Rows whose
    digests agree but whose bytes do not are grouped by their bytes instead.
    """
    groups = stream_groups(
        spark, path, id_col=id_col, text_col=text_col, state_path=state_path, bytes_per_batch=bytes_per_batch)
    rows = _located(spark.read.parquet(path), id_col, text_col)
    # One join deals the texts by digest; only the rows of a hit keep their text for the comparison.
    missing = F.raise_error(F.lit("a row is in no group of the stream's state")).cast("long")
    marked = stored(
        rows.join(groups, "digest", "left").select(
            "digest", "doc_id", "locator", "keeper", F.coalesce("group_size", missing).alias("group_size"),
            F.when(F.col("group_size") > 1, F.col("body")).alias("body")),
        "exact-marked")
    hits = marked.where("group_size > 1")
    # All bytes of a group are equal exactly if its least and greatest text are; a hot group shrinks before the shuffle.
    torn = hits.groupBy("digest").agg(F.min("body").alias("least"), F.max("body").alias("greatest")).where(
        "least <> greatest").select("digest")
    mended = hits.join(torn, "digest", "left_semi").groupBy("digest", "body").agg(
        F.max(F.struct("doc_id", "locator")).alias("own_keeper"), F.count(F.lit(1)).alias("own_size"))
    repaired = hits.join(torn, "digest", "left_semi").join(mended, ["digest", "body"]).select(
        "digest", "doc_id", "locator", F.col("own_keeper").alias("keeper"), F.col("own_size").alias("group_size"))
    whole = marked.where("group_size = 1").drop("body").unionByName(
        hits.join(torn, "digest", "left_anti").drop("body")).unionByName(repaired)
    return whole.select(
        "doc_id", F.col("keeper.doc_id").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"),
        (F.col("locator") == F.col("keeper.locator")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
