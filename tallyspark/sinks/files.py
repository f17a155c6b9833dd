"""Folder operations on whatever file system the lake lives on."""

from __future__ import annotations

import re
import tempfile
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession


class Folder:
    """Lists, moves and removes folders through Spark's own Hadoop configuration."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark._jvm
        self.root = root.rstrip("/")
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, text: str):
        return self._jvm.org.apache.hadoop.fs.Path(text)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def children(self, path: str) -> list[str]:
        if not self.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(path)) if s.isDirectory())

    def partitions(self, path: str, key: str) -> dict[str, str]:
        """value -> folder of the '<key>=<value>' children."""
        out = {}
        for name in self.children(path):
            found = re.fullmatch(rf"{re.escape(key)}=(.*)", name)
            if found:
                out[found[1]] = f"{path}/{name}"
        return out

    def values(self, path: str, key: str) -> dict[str | None, str]:
        """Like `partitions`, by the values before they were escaped for a folder's name; null for the default folder."""
        return {
            None if value == "__HIVE_DEFAULT_PARTITION__" else unquote(value): folder
            for value, folder in self.partitions(path, key).items()}

    def remove(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def write_text(self, path: str, text: str) -> None:
        """A small file, replaced whole."""
        out = self._fs.create(self._path(path), True)
        try:
            out.write(bytearray(text.encode("utf-8")))
            out.hsync()
        finally:
            out.close()

    def read_text(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def move(self, source: str, target: str) -> None:
        parent = self._path(target).getParent()
        self._fs.mkdirs(parent)
        if not self._fs.rename(self._path(source), self._path(target)):
            raise OSError(f"could not move {source} to {target}")


def work_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder in the shared location the cluster names, for tables written between steps.

    Without that setting only a session on a single machine, as in tests, gets a folder of its own; a cluster's
    executors could not see it, so there it is an error. The folder is removed when the driver ends.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
    root = shared or tempfile.mkdtemp(prefix="run-", dir="/tmp")
    path = f"{root.rstrip('/')}/tallyspark/{label}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """The frame written once to a fresh folder of `work_folder` and read back: later steps share it and survive lost executors."""
    path = work_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_in_buckets(df: DataFrame, label: str, bucket: str) -> DataFrame:
    """The frame written once like `stored`, its rows dealt by the column `bucket` into as many files a task as shuffles have partitions.

    Grouping the frame read back by that column and others moves nothing between tasks: its rows were dealt by the columnar,
    compressed files, which take a fraction of the room of shuffled rows.
    """
    spark, path = df.sparkSession, work_folder(df.sparkSession, label)
    # The catalog only carries the buckets to the reader; the frame goes on reading the files when its entry is gone.
    name = f"tallyspark_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(n, bucket).option("compression", "zstd").option("path", path).saveAsTable(name)
    try:
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


# The plan of a swap in progress, beside the folders it swaps; files starting with '_' are not read as data.
JOURNAL = "_swap_journal.json"


def swap(folder: Folder, moves: list[tuple[str, str]], removes: list[str], staging: str | None = None) -> None:
    """Puts each staged folder in place of its target and removes the others, as one journaled step.

    The plan is written before the first removal. A crash at any point leaves the journal, and the next
    `complete_swap` (every writer and reader of the root calls it first) rolls the swap forward: staged folders
    are whole before the plan exists, so finishing is always possible. Only a finished swap removes `staging`.
    """
    import json

    journal = f"{folder.root}/{JOURNAL}"
    folder.write_text(journal, json.dumps({"moves": moves, "removes": removes, "staging": staging}))
    _apply(folder, moves, removes, staging)
    folder.remove(journal)


def _apply(folder: Folder, moves: list, removes: list, staging: str | None) -> None:
    for source, target in moves:
        if folder.exists(source):  # else moved before the crash
            folder.remove(target)
            folder.move(source, target)
    for path in removes:
        folder.remove(path)
    if staging:
        folder.remove(staging)


def complete_swap(spark: SparkSession, root: str) -> bool:
    """Finishes a swap under `root` that a crash interrupted; whether there was one."""
    import json

    folder = Folder(spark, root)
    journal = f"{folder.root}/{JOURNAL}"
    if not folder.exists(journal):
        return False
    plan = json.loads(folder.read_text(journal))
    _apply(folder, [tuple(m) for m in plan["moves"]], plan["removes"], plan.get("staging"))
    folder.remove(journal)
    return True
