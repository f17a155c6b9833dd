"""Removal of lines that many documents share, over levelled sorted runs of line hashes."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import stored, text_of, with_row

BLANKS = "\t\n\x0b\x0c\r "
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _hashed(line: Column, min_chars: int) -> Column:
    """128 bits of the line's key; null for a key of fewer code points."""
    key = line_key(line)
    return F.when(F.length(key) >= min_chars, F.substring(F.unhex(F.sha2(key, 256)), 1, 16))


class LineRuns:
    """Line counts as sorted runs in levels.

    A run is a table of (key, n_docs) sorted by key. A new batch is counted, its keys that the runs already
    know to be common are taken out by an anti-join with the runs, and the rest becomes a run of level 0.
    When a level holds `fanout` runs they are merged into one run of the next level, so a key is rewritten
    a logarithmic number of times and a lookup reads few runs.
    """

    def __init__(self, spark: SparkSession, *, min_docs: int, min_chars: int = 1, fanout: int = 4):
        if min_chars < 1:
            raise ValueError("an empty line has no key")
        self.spark, self.min_docs, self.min_chars, self.fanout = spark, min_docs, min_chars, fanout
        self.levels: list[list[DataFrame]] = []

    def add(self, docs: DataFrame, text_col: str = "text") -> None:
        """Count the lines of a batch of documents and add them as a run."""
        lines = F.split(text_of(text_col), "\n")
        keys = F.array_distinct(F.transform(lines, lambda x: _hashed(x, self.min_chars)))
        counts = (
            docs.select(F.explode(keys).alias("key")).where("key is not null")
            .groupBy("key").agg(F.count(F.lit(1)).alias("n_docs")))
        if self.levels:
            counts = counts.join(self.common(), "key", "left_anti")
        self._put(0, counts)

    def _put(self, level: int, counts: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(stored(counts.sortWithinPartitions("key"), f"line-run-{level}"))
        if len(self.levels[level]) == self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._put(level + 1, self._merged(full))

    @staticmethod
    def _merged(runs: Iterable[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, runs).groupBy("key").agg(F.sum("n_docs").alias("n_docs"))

    def common(self) -> DataFrame:
        """Keys found in at least `min_docs` documents so far."""
        runs = [run for level in self.levels for run in level]
        return self._merged(runs).where(F.col("n_docs") >= self.min_docs).select("key")


def file_batches(docs: DataFrame, batches: int) -> list[DataFrame]:
    """A Parquet table's files dealt into batches, as if they had come one after the other."""
    files = sorted(docs.inputFiles())
    if len(files) < 2:
        return [docs]
    shares = [files[i::batches] for i in range(min(batches, len(files)))]
    return [docs.sparkSession.read.schema(docs.schema).parquet(*share) for share in shares]


def drop_common_lines(
    docs: DataFrame, *, min_docs: int = 10, min_chars: int = 1, batches: list[DataFrame] | None = None, fanout: int = 3,
    id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (),
) -> DataFrame:
    """Every document without the lines that at least `min_docs` documents hold.

    Lines end at "\\n"; a line's key has no blanks at its ends and A-Z in lower case, and keys of fewer than
    `min_chars` code points never count. A common line goes from every document, all its copies. Null and
    empty texts are one empty line. Repeated rows are separate documents. An empty table gives no rows.
    Returns doc_id, text (the kept lines joined by "\\n"), n_lines, n_dropped and the columns named in `keep`;
    other columns are not read.

    `docs` is a stored table; `batches` are its parts in the order of arrival, by default the whole at once.
    Only the 16-byte keys are dealt by key, each once per document and counted before the shuffle; the text
    moves once, to meet the numbers of its dropped lines.
    """
    runs = LineRuns(docs.sparkSession, min_docs=min_docs, min_chars=min_chars, fanout=fanout)
    for batch in batches or [docs]:
        runs.add(batch, text_col)
    common = stored(runs.common(), "line-common")

    # What is only passed on travels as one column, so its names cannot clash with those used here.
    rows = with_row(
        docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"), F.struct(F.lit(0), *keep).alias("passed")),
        "doc_id", "text", "passed")
    lines = F.split("text", "\n")
    found = (
        rows.select("_row", F.posexplode(F.transform(lines, lambda x: _hashed(x, min_chars))).alias("_line", "key"))
        .where("key is not null")
        .join(common, "key", "left_semi")
        .groupBy("_row").agg(F.collect_list("_line").alias("_gone")))
    joined = rows.join(found, "_row", "left").withColumn("_lines", lines)
    # Set difference is hashed, so the work stays linear in the lines of a document.
    left = F.array_except(F.sequence(F.lit(0), F.array_size("_lines") - 1), "_gone")
    kept = F.when(F.col("_gone").isNull(), F.col("_lines")).otherwise(F.transform(left, lambda i: F.get("_lines", i)))
    return joined.select(
        "doc_id", F.array_join(kept, "\n").alias("text"), F.array_size("_lines").cast("long").alias("n_lines"),
        F.coalesce(F.array_size("_gone"), F.lit(0)).cast("long").alias("n_dropped"), *(f"passed.`{c}`" for c in keep))
