"""Repeated byte strings against a count of every window."""

import random

import numpy as np
import pytest

from tallyspark.llm import suffix_dedup
from tallyspark.llm.common import stored
from tallyspark.llm.suffix_dedup import remove_repeats, sampled_cells
from tests.llm.brute import whole_letters, without_repeats

SCHEMA = "doc_id long, text string, core long, whole string, n int"


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["ab", "é", "xyz", "q", "longer", " ", "ü1"])
    text = lambda n: "".join(word() for _ in range(n))
    shared = [text(rnd.randrange(5, 120)) for _ in range(6)]
    docs = [None, "", "a", "a" * 300, "ab" * 200, "abc" * 90 + "x" + "abc" * 50, "same text " * 3, "same text " * 3, "é" * 50, "è" * 50]
    for _ in range(60):
        docs.append("".join(rnd.choice([text(rnd.randrange(60)), rnd.choice(shared), rnd.choice(shared)[rnd.randrange(9):]]) for _ in range(rnd.randrange(6))))
    return docs


@pytest.mark.parametrize(("seed", "length"), [(1, 16), (2, 40), (3, 104)])
def test_against_every_window(spark, seed, length):
    docs = corpus(seed)
    frame = stored(spark.createDataFrame([(i, t, 7, "x", 1) for i, t in enumerate(docs)], SCHEMA).repartition(3), "test-docs")
    got = {r.doc_id: r for r in remove_repeats(frame, length=length, keep=("whole", "n")).collect()}
    for i, (t, want) in enumerate(zip(docs, without_repeats(docs, length), strict=True)):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[:4]
        assert r.text == whole_letters(t or "", want[4])
        assert (got[i].whole, got[i].n) == ("x", 1)


def test_null_and_repeated_identifiers_and_empty_table(spark):
    frame = stored(spark.createDataFrame([(None, "x" * 40, 0, "", 0), (5, "words here, not twice", 0, "", 0), (5, "other words, once too", 0, "", 0)], SCHEMA), "test-docs")
    rows = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in remove_repeats(frame, length=16).collect()), key=str)
    assert rows == [(5, 21, 0), (5, 21, 0), (None, 40, 40)]
    assert remove_repeats(frame.where("false"), length=16).count() == 0
    with pytest.raises(ValueError):
        remove_repeats(frame, length=12)


def test_windows_of_long_texts_are_each_in_one_piece(monkeypatch):
    rnd = random.Random(4)
    text = "".join(rnd.choice("abcd") for _ in range(3000))
    whole = sampled_cells(np.frombuffer(text.encode(), np.uint8), np.array([3000]), 40)
    anchors = dict(zip((w for lo, last in zip(whole[1], whole[3]) for w in range(lo, last + 1)), np.repeat(whole[0], whole[3] - whole[1] + 1)))
    monkeypatch.setattr(suffix_dedup, "_BUFFER", 500)
    seen = {}
    for data, ends, first, base in suffix_dedup._buffers([text, "short"], 40):
        anchor, lo, hi, last, n, core, bucket = sampled_cells(data, ends, 40)
        for a, start, stop in zip(anchor, lo, last):
            for w in range(start, stop + 1):
                assert first == 0 and w + base not in seen
                seen[w + base] = a + base
    assert seen == anchors
