"""Row numbers under reads that are split at other places."""

import pytest

from tallyspark.llm import common, minhash, suffix_dedup
from tallyspark.llm.common import stored, with_row
from tallyspark.llm.minhash import near_duplicates
from tallyspark.llm.suffix_dedup import remove_repeats
from tests.llm.brute import near_groups, without_repeats
from tests.llm.test_dedup import near_corpus
from tests.llm.test_suffix_dedup import corpus

SPLIT = "spark.sql.files.maxPartitionBytes"


@pytest.fixture()
def splits(spark):
    """Sets how many bytes a task reads, as other numbers of cores do for later jobs."""
    before = spark.conf.get(SPLIT)
    yield lambda size: spark.conf.set(SPLIT, size)
    spark.conf.set(SPLIT, before)


@pytest.fixture()
def shifting(monkeypatch, splits):
    """Every table between steps changes how later reads are split."""
    sizes = iter(["1k", "128m"] * 100)

    def run(df, label):
        out = stored(df, label)
        splits(next(sizes))
        return out

    for module in (suffix_dedup, minhash):
        monkeypatch.setattr(module, "stored", run)


def table(spark, texts):
    return stored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5), "test-docs")


def test_numbers_do_not_depend_on_splits(spark, splits):
    docs = table(spark, [str(i) for i in range(500)])
    seen = []
    for size in ("128m", "1k"):
        splits(size)
        seen.append({r.doc_id: r._row for r in with_row(docs, "doc_id").collect()})
    assert seen[0] == seen[1] and len(set(seen[0].values())) == 500
    assert common.with_row(docs.where("doc_id < 0"), "doc_id").count() == 0


def test_repeats_under_other_splits(spark, shifting):
    texts = corpus(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(table(spark, texts), length=40).collect()}
    assert got == {i: want[:4] for i, want in enumerate(without_repeats(texts, 40))}


def test_near_duplicates_under_other_splits(spark, shifting):
    texts = near_corpus(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(table(spark, texts), words=4).collect()}
    assert got == dict(enumerate(near_groups(texts, 4, 80)))
