"""Helpers shared by the corpus operators: tables of a data folder, shared work folders, row keys."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"
# Rows that a Python worker turns into Python objects at once.
SLICE = 512
# Work tables made by this process, in order, so that a caller can remove those it knows are no longer read.
_MADE: list[str] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that all machines of the cluster share.

    The folder comes from spark.checkpoint.dir. Only a session on one machine (as in tests) may lack it and gets a
    folder of its own, which is then kept in the session's setting; on a cluster its lack is an error.
    """
    root = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING, None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{SETTING} has to name a folder that all machines of the cluster share")
    if not root:
        root = f"file://{tempfile.mkdtemp(prefix='llm-work-')}"
        spark.conf.set(SETTING, root)
    path = f"{root.rstrip('/')}/llm/{label}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def made() -> int:
    """How many work tables this process has made so far; a mark for `release`."""
    return len(_MADE)


def release(spark: SparkSession, start: int, end: int) -> None:
    """Removes the work tables made between two marks. Only for tables that nothing will read again."""
    jvm = spark.sparkContext._jvm
    for path in _MADE[start:end]:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """The frame written as a table in the shared folder and read back.

    Cuts lineage, and later steps survive the loss of any executor.
    """
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_row(df: DataFrame, *columns: str, row: str = "_row") -> DataFrame:
    """Only the named columns and a number per row, the same on every read of one frame, however it is split.

    doc_id may be null or repeated, so steps that come back to a row do it by this number: that of its file
    among the frame's files and its place in that file. `df` is a Parquet table, or columns and filters of one.
    """
    path, place = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    files = sorted(r[0] for r in df.select(path).distinct().collect())
    listed = F.from_json(F.lit(json.dumps(files)), "array<string>")
    numbers = F.broadcast(df.sparkSession.range(0, 1, 1, 1).select(F.posexplode(listed).alias("_file", "_path")))
    known = F.coalesce(F.col("_file").cast("long"), F.raise_error(F.lit("a file has come since the rows were numbered")).cast("long"))
    rows = df.select(*columns, path.alias("_path"), place.alias("_place")).join(numbers, "_path", "left")
    return rows.select(*columns, (F.shiftleft(known, 40) + F.col("_place")).alias(row))


def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, at most SLICE at a time: what a worker makes of a batch is many times the batch, and a worker
    that stays for the next stage keeps what it once took. Unused memory is given back after the last."""
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), SLICE):
            yield batch.slice(at, SLICE)
    pa.default_memory_pool().release_unused()


def text_of(name: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
