"""Nearest neighbours, WARC archives and language identification on small inputs."""

import gzip
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm.ann import nearest_by_product
from tallyspark.llm.common import stored
from tallyspark.llm.langid import NGrams, best_temperature, fit, identify, predict
from tallyspark.llm.warc import LoserTree, archive_and_index, merge_index, parse_archive, payload_digest, read_archives, url_key, write_archives

VECTORS = "vec_id long, embedding array<float>, list string, bound int"


def brute(rows, k, query):
    data = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            data.setdefault(i, []).append(np.array(v, np.float32).astype(float))
    out = {}
    for q in data:
        if query(q):
            found = sorted((-max(float(data[q][0] @ v) for v in vs), i) for i, vs in data.items() if i != q)
            out[q] = [(i, -s) for s, i in found[:k]]
    return out


def test_nearest(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=24) * rng.uniform(0.2, 3)).tolist()) for i in range(900)]
    rows += [(i, rows[5][1]) for i in range(900, 1250)]  # a hot vector: ties go to the smaller identifier
    rows += [(2000, None), (2001, [0.0] * 24), (2002, [None] + [1.0] * 23), (2003, [float("nan")] * 24), (2004, [float("inf")] * 24), (2005, [1.0]), (None, rows[3][1])]
    frame = stored(spark.createDataFrame([(i, v, "x", 1) for i, v in rows], VECTORS).repartition(4), "test-vectors")
    got = nearest_by_product(frame, F.col("vec_id") % 20 == 0, k=10, sample_rows=400, block_rows=64, query_rows=16).collect()
    want = brute([r for r in rows if r[1] is None or len(r[1]) == 24], 10, lambda q: q % 20 == 0)
    per = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        per.setdefault(r.query_id, []).append(r)
    assert set(per) == set(want)
    hits = 0
    for q, found in per.items():
        assert [r["rank"] for r in found] == list(range(1, 11))
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        hits += len({r.vec_id for r in found} & {i for i, _ in want[q]})
        exact = dict(want[q])
        assert all(abs(r.score - exact[r.vec_id]) < 1e-9 for r in found if r.vec_id in exact)
    assert hits >= 0.9 * 10 * len(want)


def test_nearest_of_few(spark):
    few = spark.createDataFrame([(i, [float(i + 1), 1.0], "x", 1) for i in range(3)], VECTORS)
    got = sorted(tuple(r) for r in nearest_by_product(few, F.col("vec_id") == 0, k=20).collect())
    assert [(q, rank, i) for q, rank, i, _ in got] == [(0, 1, 2), (0, 2, 1)]
    assert nearest_by_product(few.where("false"), F.col("vec_id") == 0).count() == 0
    assert nearest_by_product(few.limit(1), F.col("vec_id") == 0).count() == 0
    twice = spark.createDataFrame([(1, [1.0, 0.0], "x", 1), (2, [1.0, 1.0], "x", 1), (2, [1.0, 1.0], "x", 1)], VECTORS)
    assert [tuple(r) for r in nearest_by_product(twice, F.col("vec_id") == 1, k=5).collect()] == [(1, 1, 2, 1.0)]


PAGES = "page_id long, url string, html string, keeper string, content int"


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_archives(spark, tmp_path, compression):
    rows = [
        (1, "http://www.Example.com/b?y=2&x=1#part", "<p>hé\r\n\r\nWARC/1.1</p>"), (2, "https://example.com:443/b?x=1&y=2", "same"), (3, None, "same"),
        (4, "http://a.org/\r\nX: y", ""), (5, "http://a.org", None), (6, "::bad[", "z" * 300_000), (None, "http://n.org/", "same"), (None, "http://n.org/", "only"), (7, "x", "rep"), (7, "x", "rep")]
    pages = spark.createDataFrame([(*r, "k", 1) for r in rows], PAGES).repartition(3)
    path = str(tmp_path / "warc")
    got = archive_and_index(pages, path, records_per_file=2, compression=compression).collect()
    best = {}
    for i, _, html in rows:
        best.setdefault(html or "", []).append(i)
    want = []
    for i, _, html in rows:
        known = [x for x in best[html or ""] if x is not None]
        revisit = bool(known) and i != max(known)
        want.append((i, len((html or "").encode()), payload_digest((html or "").encode()), "revisit" if revisit else "response", max(known) if revisit else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)
    order = [(r.url_key, r.captured, r.page_id is not None, r.page_id or 0) for r in got]
    assert order == sorted(order)
    payloads = {r.payload.decode() for r in read_archives(spark, path, with_payload=True).collect() if r.payload is not None}
    assert payloads == {html or "" for _, _, html in rows}
    # A record can be read alone from its place.
    for r in got[:3] if compression == "none" else ():
        with open(r.archive.removeprefix("file:"), "rb") as file:
            file.seek(r.offset)
            assert [x[2]["warc-type"] for x in parse_archive(file.read(r.length))] == [r.record_type]


def test_small_payloads_are_never_revisits(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", "abc" if i < 2 else "abcdef", "k", 1) for i in range(4)], PAGES)
    got = archive_and_index(pages, str(tmp_path / "warc"), min_revisit_bytes=4).collect()
    assert sorted((r.page_id, r.record_type) for r in got) == [(0, "response"), (1, "response"), (2, "revisit"), (3, "response")]


def test_no_pages(spark, tmp_path):
    assert archive_and_index(spark.createDataFrame([], PAGES), str(tmp_path / "warc")).count() == 0


def test_broken_archives_are_errors():
    for content in (b"junk", b"WARC/1.1\r\nContent-Length: 5\r\n\r\nab", gzip.compress(b"WARC/1.1")):
        with pytest.raises((ValueError, KeyError)):
            list(parse_archive(content))


def test_loser_tree_and_keys(spark):
    rnd = random.Random(2)
    for k in range(8):
        runs = [sorted((rnd.randrange(50), j) for j in range(rnd.randrange(20))) for _ in range(k)]
        assert list(LoserTree(runs)) == sorted(x for run in runs for x in run)
    assert url_key("HTTP://www.A.b.com:80/X?b=1&a=2#f") == url_key("https://a.B.com/x?a=2&b=1") == "com,b,a)/x?a=2&b=1"
    assert url_key(None) == "" and url_key("http://[bad") == "http://[bad"
    entries = [(f"file{i % 7}", i, 1, f"k{rnd.randrange(5)}", "t", i, "u", 1, "d", "response", None) for i in range(300)]
    from tallyspark.llm.warc import ENTRY

    frame = spark.createDataFrame(entries, ENTRY)
    got = [(r.url_key, r.captured, r.page_id) for r in merge_index(frame, range_rows=40).collect()]
    assert got == sorted(got) and len(got) == 300


SAID = {"aa": "banana papaya mamma data ", "oo": "moon pool book foot ", "ii": "mini bikini wifi kiwi "}


def docs(spark, n=240, extra=()):
    rnd = random.Random(8)
    rows = [(i, " ".join(rnd.choices(SAID[lang].split(), k=rnd.randrange(3, 40))), lang, "s", 0.5) for i in range(n) for lang in [rnd.choice(list(SAID))]]
    return stored(spark.createDataFrame([*rows, *extra], "doc_id long, text string, lang string, lang_pred string, score double"), "test-docs")


def test_language(spark):
    odd = [(1001, None, "aa", "", 0.0), (1002, "", None, "", 0.0), (1003, "12 !? \n", "aa", "", 0.0), (1004, "foot " * 300_000, None, "", 0.0), (None, "kiwi mini", None, "", 0.0), (1005, "moon", "oo", "", 0.0), (1005, "moon", "oo", "", 0.0)]
    frame = docs(spark, extra=odd)
    got = identify(frame, per_language=60, bits=12).collect()
    assert len(got) == 247 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (1001, 1002, 1003, 1004, 1005, None)] == ["und", "und", "und", "oo", "oo", "ii"]
    import zlib

    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    truth = {r.doc_id: r.lang for r in frame.collect()}
    held = [r for r in got if r.held_out and r.doc_id < 1000]
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.95 * len(held)


def test_language_does_not_look_at_held_out_labels(spark):
    frame = docs(spark)
    from tallyspark.llm.langid import fold

    blind = stored(frame.withColumn("lang", F.when(~fold(), F.col("lang")).otherwise(F.lit("ii"))), "test-docs")
    one, two = (sorted(tuple(r) for r in identify(f, per_language=60, bits=12).collect()) for f in (frame, blind))
    assert one == two


def test_language_without_labels(spark):
    bare = stored(docs(spark, 5).withColumn("lang", F.lit(None).cast("string")), "test-docs")
    assert {(r.lang_pred, r.score) for r in identify(bare).collect()} == {("und", 0.0)}
    assert identify(bare.where("false")).count() == 0
    with pytest.raises(ValueError):
        fit(bare.select("text", "lang"))
    model = fit(docs(spark).select("text", "lang"), per_language=30, bits=10)
    assert predict(bare.where("false"), model).count() == 0
    assert np.count_nonzero(model.weights) < model.weights.size / 2


def test_ngrams_do_not_depend_on_the_step(monkeypatch):
    from tallyspark.llm import langid

    text = "Ein  Satz, der über\n\nmehrere Stücke geht. 中文 " * 20
    whole = NGrams(12, 3).counts(text)
    for step in (1, 7, 64):
        monkeypatch.setattr(langid, "_STEP", step)
        assert (NGrams(12, 3).counts(text) == whole).all()


def test_temperature_lowers_the_loss():
    rng = np.random.default_rng(1)
    labels = rng.integers(0, 3, 500)
    scores = 8 * (np.eye(3)[labels] + rng.normal(size=(500, 3)))
    t = best_temperature(scores, labels)

    def loss(s):
        return (np.log(np.exp(s).sum(axis=1)) - s[np.arange(500), labels]).mean()

    assert t > 1.5 and loss(scores / t) < loss(scores)
    assert best_temperature(np.empty((0, 3)), np.empty(0, int)) == 1.0


def test_language_does_not_depend_on_splits(spark):
    frame = docs(spark, 400)
    split = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(split)
    seen = []
    try:
        for size in ("128m", "2k"):
            spark.conf.set(split, size)
            seen.append(sorted(tuple(r) for r in identify(frame, per_language=50, bits=12).collect()))
    finally:
        spark.conf.set(split, before)
    assert seen[0] == seen[1]
