"""Quality rules, Merkle manifest and periodic runs against plain Python versions."""

import random
import zlib

import numpy as np
import pytest

from tallyspark.llm import merkle, queries
from tallyspark.llm.periodic import find_runs, periodic_runs, planted, runs_in, words_of
from tallyspark.llm.quality import quality, repeated_words
from tests.llm.brute import brute_runs, merkle_manifest, quality_rows, sha

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows, extra=False):
    df = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], SCHEMA)
    if extra:  # clashing names the operators make for themselves
        for name in ("leaf", "_key", "_pos", "_rk", "host", "pos", "runs", "collapsed", "kept"):
            df = df.withColumn(name, df["doc_id"] * 0)
    return df


def edge_rows():
    boiler = "Read our terms at the end of this page"
    body = " ".join(f"w{i}" for i in range(60))
    rows = []
    for i in range(12):
        rows.append({"doc_id": i, "text": f"{boiler}\nunique text {i} " + body, "lang": "en", "source": "a", "n_chars": 10})
    rows += [
        {"doc_id": None, "text": None, "lang": None, "source": None, "n_chars": None},
        {"doc_id": 20, "text": "", "lang": "fr", "source": "a", "n_chars": 0},
        {"doc_id": 21, "text": "  \n\t ", "lang": "fr", "source": None, "n_chars": 5},
        {"doc_id": 3, "text": f"{boiler}\nunique text 3 " + body, "lang": "en", "source": "a", "n_chars": 10},  # repeated row
        {"doc_id": 22, "text": ("x y z " * 40 + "\n") * 3, "lang": "de", "source": "b", "n_chars": 3},
        {"doc_id": 23, "text": "<b>#$ " * 100 + " été " + "long" * 50000, "lang": None, "source": "b", "n_chars": 7},
    ]
    return rows


# Quality rules


def test_repeated_words_counts_first_window():
    assert repeated_words(b"a b c a b c".split()) == 6
    assert repeated_words(b"a a a a".split()) == 4
    assert repeated_words(b"a b c d".split()) == 0
    assert repeated_words([]) == 0


@pytest.mark.parametrize("extra", [False, True])
def test_quality_matches_plain_python(spark, extra):
    rows = edge_rows()
    got = {(r.doc_id, i): r for i, r in enumerate(quality(docs_of(spark, rows, extra)).collect())}
    want = quality_rows(rows)
    seen = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words,
                   r.removed_lines, r.removed_chars) for r in got.values())
    assert seen == sorted((r["doc_id"] is None, r["doc_id"] or 0, *w) for r, w in zip(rows, want))
    by_id = {r.doc_id: r for r in got.values()}
    # The boilerplate line of host "a" is in 13 rows: removed, but it is a small part of each.
    assert by_id[0].removed_lines == 1 and by_id[0].kept and not by_id[0].depleted
    assert by_id[None].base_failed and not by_id[None].kept and by_id[None].n_words == 0
    assert by_id[22].base_failed  # every word is in a repeated window
    assert by_id[23].n_symbols == 400


def test_quality_depleted_documents(spark):
    rows = [{"doc_id": i, "text": "same boiler line " * 20 + f"\nown {i}", "lang": "en", "source": "h", "n_chars": 1} for i in range(10)]
    out = {r.doc_id: r for r in quality(docs_of(spark, rows), min_words=5, max_repeat=1.0).collect()}
    assert all(r.depleted and not r.kept and r.removed_lines == 1 for r in out.values())
    # Fewer documents than the limit: nothing goes.
    out = {r.doc_id: r for r in quality(docs_of(spark, rows[:9]), min_words=5, max_repeat=1.0).collect()}
    assert all(r.kept and r.removed_lines == 0 for r in out.values())


def test_quality_empty_table(spark):
    assert quality(docs_of(spark, [])).count() == 0


def test_op11_registered_query_matches_plain_python(spark):
    import duckdb

    rows = duckdb.sql(f"select doc_id, text, lang, source, n_chars from '{SF}/documents.parquet'").df().to_dict("records")
    rows = [{k: (None if v != v else v) for k, v in r.items()} for r in rows]
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.removed_lines, r.removed_chars)
                 for r in queries.op11_quality_rules(spark, SF).collect())
    assert got == sorted((r["doc_id"], *w) for r, w in zip(rows, quality_rows(rows)))


# Merkle manifest


def tampered(row):
    return row["doc_id"] is not None and row["n_chars"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0


@pytest.mark.parametrize("bits", [10, 1, 2])
def test_manifest_matches_plain_python(spark, monkeypatch, bits):
    monkeypatch.setattr(merkle, "BLOCK_BITS", bits)
    rng = random.Random(bits)
    rows = edge_rows() + [
        {"doc_id": rng.randrange(50), "text": f"t{rng.random()}", "lang": rng.choice(["en", "fr", "és", None, "z"]),
         "source": None, "n_chars": rng.choice([None, 4])} for _ in range(70)]
    df = docs_of(spark, rows, extra=True).select("doc_id", "source", "lang", "n_chars", "text", "leaf", "_key")
    monkeypatch.setattr(queries, "documents", lambda spark, sf: df)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified)
                 for r in queries.op12_merkle_manifest(spark, "unused").collect())
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, *w) for r, w in zip(rows, merkle_manifest(rows, tampered)))
    assert got == want
    assert any(not g[-1] for g in got) and any(g[-1] for g in got)


def test_manifest_single_row_and_empty(spark):
    one = [{"doc_id": 5, "text": "a", "lang": "en", "source": "s", "n_chars": 1}]
    (row,) = merkle.manifest(docs_of(spark, one)).collect()
    assert row.leaf == row.subroot == row.root == sha("1:5" + "1:s" + "2:en" + "1:1" + "1:a") and row.path == []
    assert merkle.manifest(docs_of(spark, [])).count() == 0


def test_op12_registered_query_matches_plain_python(spark):
    import duckdb

    rows = duckdb.sql(f"select doc_id, text, lang, source, n_chars from '{SF}/documents.parquet'").df().to_dict("records")
    rows = [{k: (None if v != v else v) for k, v in r.items()} for r in rows]
    got = sorted((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified)
                 for r in queries.op12_merkle_manifest(spark, SF).collect())
    assert got == sorted((r["doc_id"], *w) for r, w in zip(rows, merkle_manifest(rows, tampered)))


# Periodic runs


def test_runs_match_every_period_and_start():
    rng = random.Random(7)
    for _ in range(1500):
        n, v = rng.randint(0, 50), rng.randint(1, 4)
        w = [rng.randrange(v) for _ in range(n)]
        if n > 8 and rng.random() < 0.5:
            a, p = rng.randrange(n), rng.randint(1, 4)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        assert (runs_in(np.array(w, dtype=np.int64)) if w else []) == brute_runs(w)


def test_collapsed_keeps_first_period():
    words = b"x a b a b a b a b a b y".split()
    runs, kept = periodic_runs(words)
    assert runs == [(1, 10, 2)] and kept == b"x a b y".split()
    assert periodic_runs([]) == ([], [])
    assert periodic_runs(b"a a a a a".split()) == ([], b"a a a a a".split())  # 5 words: too short


def plain_query_row(doc_id, text):
    words = planted(words_of(text), doc_id)
    runs, kept = periodic_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(b" ".join(kept).decode()))


def test_find_runs_edges(spark):
    rows = edge_rows()
    out = find_runs(docs_of(spark, rows, extra=True)).collect()
    assert len(out) == len(rows)
    empty = [r for r in out if r.doc_id in (None, 20, 21)]
    assert all(r.n_words == 0 and r.n_runs == 0 and r.start is None and r.collapsed == "" for r in empty)
    assert find_runs(docs_of(spark, [])).count() == 0


def test_op13_registered_query_matches_plain_python(spark):
    import duckdb

    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    got = sorted(tuple(r) for r in queries.op13_periodic_runs(spark, SF).collect())
    assert got == sorted(plain_query_row(d, t) for d, t in rows)
    assert sum(1 for g in got if g[1]) >= 10  # planted runs are found
