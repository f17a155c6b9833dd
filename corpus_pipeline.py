"""Corpus pipeline: language filter, line dedup, near-dedup, passage dedup, packing.

Every stage takes (spark, docs, sf_dir), works on all documents its predecessor kept and reads them from a
stored table. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from functools import wraps

from tallyspark.llm.common import documents, made, release, stored, with_row
from tallyspark.llm.langid import UNDETERMINED, fit, fold, predict
from tallyspark.llm.line_dedup import drop_common_lines, file_batches
from tallyspark.llm.minhash import near_duplicates
from tallyspark.llm.packing import pack_documents
from tallyspark.llm.suffix_dedup import remove_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
# Below this the most likely language is hardly more likely than the others.
LEAST_SCORE = 0.3


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


# Work tables of the stage called last: (first mark, end mark).
_LAST: list[tuple[int, int]] = []


def _clears_previous(stage):
    """A stage first removes the work tables of the stage called before it.

    By the pipeline's contract a stage's result is written and read again before the next stage is called, so
    those tables are never read again; without this every stage's tables stay until the driver ends and the
    disk holds all of them at the last stage.
    """

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _LAST:
            release(spark, *_LAST.pop())
        start = made()
        out = stage(spark, docs, sf_dir)
        _LAST.append((start, made()))
        return out

    return run


@_clears_previous
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or in no language that the labelled ones teach, go; without labels only the former."""
    learn = docs.where(~fold() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    if learn.isEmpty():
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    said = predict(docs.select(*COLUMNS), fit(learn), keep=COLUMNS)
    return said.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).withColumn(
        "lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


@_clears_previous
def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten or more documents hold go from all of them."""
    out = drop_common_lines(docs, min_docs=10, batches=file_batches(docs.select("text"), 4), keep=("lang", "source"))
    return _sized(out)


@_clears_previous
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, 80 %) one row stays, the first of those with the smallest identifier."""
    found = near_duplicates(docs, words=5, percent=80)
    # Equal and null identifiers do not name a row, so a group keeps its least row; null is the greatest identifier.
    keep = found.groupBy("component_row").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("least"))
    return with_row(docs, *COLUMNS).join(keep.select("least._row"), "_row", "left_semi").select(*COLUMNS)


@_clears_previous
def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes that occur more than once go; letters cut by a string's edge stay."""
    return _sized(remove_repeats(docs, length=400, keep=("lang", "source")))


@_clears_previous
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens, one row per piece with its ids."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_duplicate_stage),
    ("passage_dedup", passage_stage),
    ("packing", packing_stage),
]

# Model scores, byte-pair merging and best fit have no SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each on what the one before it has written."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
