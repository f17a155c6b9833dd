"""The pipeline against plain Python, stage by stage, and the registration of all corpus queries."""

import re

import public_tokenizers
import pytest
import tokenizers

import __spark_entry__ as contract
import corpus_pipeline
from tallyspark.llm.common import documents, stored
from tallyspark.llm.langid import fit, fold
from tests.llm.brute import kept_lines, near_groups, whole_letters, without_repeats
from tests.llm.test_tokens import check_packing

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    names = [n for n in contract.queries() if n.startswith("op")]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14))
    assert "pipeline" in contract.queries() and len(corpus_pipeline.STAGES) == 5


@pytest.fixture(scope="module")
def stages(spark):
    """Rows of every stage's result over the smallest table."""
    docs = documents(spark, SF)
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), f"test-{name}")
        out.append(docs.collect())
    return out


def texts(rows):
    return {r.doc_id: r.text for r in sorted(rows, key=lambda r: r.doc_id)}


def test_language_stage(spark, stages):
    docs = documents(spark, SF)
    model = fit(docs.where(~fold()).select("text", "lang"))
    want = {i: t for i, t in texts(stages[0]).items() if (said := model.predict(t))[0] != "und" and said[1] >= corpus_pipeline.LEAST_SCORE}
    assert texts(stages[1]) == want
    assert len(want) >= 0.99 * len(stages[0])


def test_line_stage(stages):
    before = texts(stages[1])
    assert texts(stages[2]) == dict(zip(before, (t for _, _, t in kept_lines(before.values(), 10)), strict=True))
    assert all(r.n_chars == len(r.text) for r in stages[2])


def test_near_duplicate_stage(stages):
    before = texts(stages[2])
    groups = near_groups(list(before.values()), 5, 80)
    assert texts(stages[3]) == {i: t for n, (i, t) in enumerate(before.items()) if groups[n][1] == n}


def test_passage_stage(stages):
    before = texts(stages[3])
    left = without_repeats(before.values(), 400)
    assert texts(stages[4]) == {i: whole_letters(t or "", gone) for (i, t), (*_, gone) in zip(before.items(), left, strict=True)}


def test_packing_stage(spark, stages):
    tokenizer = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    used = check_packing(stages[5], texts(stages[4]), tokenizer, 1024)
    assert used <= sum(r.length for r in stages[5]) / 1024 + 2
    key = lambda r: (r.doc_id, r.piece, r.length, r.ids_crc32)
    assert sorted(map(key, corpus_pipeline.run(spark, SF).collect())) == sorted(map(key, stages[5]))


@pytest.mark.parametrize("name", sorted(n for n in contract.oracle_sql() if n.startswith("op")))
def test_comparison_sql(spark, name):
    from tools.compare import connect, table

    df = contract.queries()[name](spark, SF)
    rel = connect(SF).execute(contract.oracle_sql()[name])
    want = table([d[0] for d in rel.description], rel.fetchall())
    assert table(df.columns, [tuple(r) for r in df.collect()]) == want
