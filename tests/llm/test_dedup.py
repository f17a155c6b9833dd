"""Exact, line and near deduplication against plain Python on small inputs."""

import hashlib
import random

import numpy as np
import pytest

from tallyspark.llm.common import stored
from tallyspark.llm.components import star_components
from tallyspark.llm.exact_dedup import exact_duplicates, stream_groups
from tallyspark.llm.hashing import shingle_set
from tallyspark.llm.line_dedup import LineRuns, drop_common_lines
from tallyspark.llm.minhash import Sketcher, near_duplicates
from tests.llm.brute import kept_lines, near_groups, shingles

SCHEMA = "doc_id long, text string, digest string, key long, `_gone` int, keeper string"


def table(spark, rows):
    return stored(spark.createDataFrame([(i, t, "d", 1, 2, "k") for i, t in rows], SCHEMA).repartition(3), "test-docs")


def saved(spark, rows, path):
    spark.createDataFrame([(i, t, "d", 1, 2, "k") for i, t in rows], SCHEMA).coalesce(2).write.mode("append").parquet(str(path))
    return str(path)


def test_exact_duplicates(spark, tmp_path):
    rows = [(1, "a"), (2, "a"), (3, "A"), (4, None), (5, ""), (6, "x" * 100_000), (7, "x" * 100_000), (None, "a"), (None, "z"), (8, "é"), (9, "é")]
    got = exact_duplicates(spark, saved(spark, rows, tmp_path / "t")).collect()
    best = {}
    for i, t in rows:
        best.setdefault(t or "", []).append(i)
    want = [(i, max((x for x in best[t or ""] if x is not None), default=None), len(best[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows]
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == sorted(want, key=str)
    assert {r.doc_id for r in got if r.kept} == {max((x for x in g if x is not None), default=None) for g in best.values()}


def test_exact_duplicates_keep_one_of_repeated_rows(spark, tmp_path):
    got = exact_duplicates(spark, saved(spark, [(1, "a")] * 4 + [(None, "b")] * 3, tmp_path / "t")).collect()
    assert sorted((r.text_sha256[:2], r.kept) for r in got).count((hashlib.sha256(b"a").hexdigest()[:2], True)) == 1
    assert sum(r.kept for r in got) == 2 and len(got) == 7


def test_state_goes_on_with_new_files(spark, tmp_path):
    path, state = tmp_path / "t", str(tmp_path / "state")
    groups = lambda: {r.keeper.doc_id: r.group_size for r in stream_groups(spark, str(path), state_path=state, bytes_per_batch=1).collect()}
    saved(spark, [(1, "a"), (2, "b")], path)
    assert groups() == {1: 1, 2: 1}
    saved(spark, [(3, "a"), (0, "b"), (5, "c")], path)
    assert groups() == {3: 2, 2: 2, 5: 1}
    assert groups() == {3: 2, 2: 2, 5: 1}


def test_exact_duplicates_of_equal_digests(spark, tmp_path, monkeypatch):
    """Texts that share a digest but not their bytes are told apart."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(F, "sha2", lambda c, n: F.sha1(F.substring(c, 1, 1)))
    rows = [(1, "ab"), (2, "ab"), (3, "ac"), (4, "b"), (5, "ac"), (6, "ab")]
    got = exact_duplicates(spark, saved(spark, rows, tmp_path / "t")).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == [
        (1, 6, 3, False), (2, 6, 3, False), (3, 5, 2, False), (4, 4, 1, True), (5, 5, 2, True), (6, 6, 3, True)]


def test_exact_duplicates_of_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "t"))
    assert exact_duplicates(spark, str(tmp_path / "t")).count() == 0


LINES = ["all rights reserved.", "  ALL rights reserved.\t", "", "   ", "one", "One ", "É", "é", "long " * 2000, "a\rb", "x "]


@pytest.mark.parametrize("batches", [1, 3])
def test_line_dedup(spark, batches):
    rnd = random.Random(batches)
    texts = [None, "", "\n", "one\n\none"] + ["\n".join(rnd.choice([*LINES, f"own {i}"]) for _ in range(rnd.randrange(9))) for i in range(40)]
    docs = table(spark, enumerate(texts))
    parts = [stored(docs.where(f"doc_id % {batches} = {b}"), "test-part") for b in range(batches)]
    got = drop_common_lines(docs, min_docs=10, batches=parts, fanout=2, keep=("digest", "_gone")).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in got} == dict(enumerate(kept_lines(texts, 10)))
    assert {(r.digest, r["_gone"]) for r in got} == {("d", 2)}


def test_line_dedup_with_null_and_repeated_identifiers(spark):
    got = drop_common_lines(table(spark, [(None, "s\nt"), (7, "s"), (7, "s"), (8, "u")]), min_docs=3).collect()
    assert sorted(((r.doc_id, r.text, r.n_dropped) for r in got), key=str) == [(7, "", 1), (7, "", 1), (8, "u", 0), (None, "t", 1)]
    assert drop_common_lines(table(spark, [(1, "a")]).where("false")).count() == 0


def test_runs_are_merged_by_levels(spark):
    runs = LineRuns(spark, min_docs=3, fanout=2)
    for i in range(5):
        runs.add(spark.createDataFrame([(f"same\nown {i}",)], "text string"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert runs.common().count() == 1
    # A key that is known to be common is not counted again.
    assert runs.levels[0][0].count() == 1


def words(rnd, n):
    return [rnd.choice("abcdefghijklmnopqrstuvwxyz") + str(rnd.randrange(400)) for _ in range(n)]


def near_corpus(seed):
    rnd = random.Random(seed)
    texts = [None, "", " \t\n", "one", "ONE", "one two three", "one two three", "É é", "one  two\nthree"]
    for _ in range(8):
        base = words(rnd, rnd.randrange(8, 300))
        for _ in range(rnd.randrange(2, 14)):
            copy = list(base)
            for _ in range(rnd.randrange(max(2, len(base) // 25))):
                copy[rnd.randrange(len(copy))] = "edit" + str(rnd.randrange(99))
            texts.append(" ".join(copy[: rnd.randrange(len(copy) * 8 // 10, len(copy) + 1)]))
    # Chains: each a little on from the one before.
    base = words(rnd, 260)
    texts += [" ".join(base[i * 6 : i * 6 + 120]) for i in range(20)]
    return texts


@pytest.mark.parametrize(("seed", "size"), [(1, 4), (2, 5)])
def test_near_duplicates(spark, seed, size):
    texts = near_corpus(seed)
    got = {r.doc_id: r for r in near_duplicates(table(spark, enumerate(texts)), words=size, percent=80).collect()}
    want = near_groups(texts, size, 80)
    assert [(got[i].n_shingles, got[i].component_id, got[i].kept) for i in range(len(texts))] == [(n, c, c == i) for i, (n, c) in enumerate(want)]


def test_unlinked_documents_of_one_bucket_are_decided(spark):
    """One band of one coordinate puts many unlinked documents into a bucket; all pairs between components count."""
    texts = near_corpus(5)[:60]
    got = {r.doc_id: r.component_id for r in near_duplicates(table(spark, enumerate(texts)), words=4, percent=80, bands=28, band_rows=1).collect()}
    assert got == {i: c for i, (_, c) in enumerate(near_groups(texts, 4, 80))}


def test_near_duplicates_with_null_and_repeated_identifiers(spark):
    rows = [(None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (None, "alone with words"), (9, "")]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_duplicates(table(spark, rows), words=4).collect()), key=str)
    assert got == sorted([(None, 4, False), (4, 4, True), (4, 4, True), (None, None, True), (9, 9, True)], key=str)
    assert near_duplicates(table(spark, rows).where("false"), words=4).count() == 0


def test_shingles_and_sketches():
    rnd = random.Random(3)
    for text in [*near_corpus(9)[:30], "w " * 700_000]:
        assert len(shingle_set((text or "").encode(), 4)) == len(shingles(text, 4))
    sketch = Sketcher(112)
    for n in (1, 3, 20, 500):
        for share in (0.5, 0.8):
            same = 0
            for _ in range(40):
                pool = np.array([rnd.getrandbits(63) for _ in range(2 * n + 20)], np.uint64)
                both = round(2 * n * share / (1 + share)) if n > 1 else 1
                a, b = pool[:n], np.concatenate([pool[:both], pool[n : 2 * n - both]])
                x, y = sketch(np.sort(a)), sketch(np.sort(b))
                assert x.all() and y.all()
                same += (x == y).mean() - both / (2 * n - both)
            assert abs(same / 40) < 0.05


def test_components(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, i) for i in range(1001, 1100)] + [(rnd.randrange(2000, 2100), rnd.randrange(2000, 2100)) for _ in range(70)]
    parent = {x: x for e in edges for x in e}
    root = lambda x: x if parent[x] == x else root(parent[x])
    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = dict(star_components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {x: root(x) for x in linked}
    assert star_components(spark.createDataFrame([], "u long, v long")).count() == 0
