"""Token operators against the tokenizers library, packing against its contract and small brute force."""

import hashlib
import itertools
import random
import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm.bpe import PrefixCodec, encode_documents
from tallyspark.llm.packing import Encoder, _dominant, _Stock, pack_documents, pack_lengths
from tallyspark.llm.token_count import MergeCounter, count_tokens

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, length string, piece string, rank int"
ODD = [None, "", " ", "\n", "a", "a" * 5000, "the the", "<|endoftext|>x<|endoftext|>", "Σας ΑΣ İ ß é ẞ ﬁ", "'s 'RE 12 ...", "中文 \U0001f600", "x՘ y"]


@pytest.fixture(scope="module")
def byte_tokenizer():
    return tokenizers.Tokenizer.from_file(BYTE)


@pytest.fixture(scope="module")
def word_tokenizer():
    return tokenizers.Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def counter():
    return MergeCounter(BYTE)


@pytest.fixture(scope="module")
def codec():
    return PrefixCodec(WORD)


@pytest.fixture(scope="module")
def encoder():
    made = Encoder(BYTE)
    assert made.fast is not None
    return made


WORDS = st.lists(
    st.one_of(st.text(max_size=12), st.sampled_from(["'s", "'ll", " ", "  ", "\n", "the", "ing", "<|endoftext|>", "<|startoftext|>", "Σ", "12"])),
    max_size=25).map("".join)


@settings(max_examples=300, deadline=None)
@given(text=WORDS)
def test_library_agrees(byte_tokenizer, word_tokenizer, counter, codec, encoder, text):
    ids = byte_tokenizer.encode(text, add_special_tokens=False).ids
    assert counter.count(text) == len(ids)
    assert encoder(text) == struct.pack(f"<{len(ids)}I", *ids)
    ids = word_tokenizer.encode(text, add_special_tokens=False).ids
    assert codec.encode(text) == ids
    assert codec.decode(ids) == word_tokenizer.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", [" " * 300_000, "\n" * 300_000 + "x", "a" * 100_000, "!?" * 50_000, "1" * 70_000, " a" * 70_000])
def test_long_runs(byte_tokenizer, counter, encoder, text):
    ids = byte_tokenizer.encode(text, add_special_tokens=False).ids
    assert counter.count(text) == len(ids)
    assert encoder(text) == struct.pack(f"<{len(ids)}I", *ids)


def _frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in enumerate(texts)] + [(None, "twice", "", "", 0)] * 2, SCHEMA)


def test_count_and_codec_frames(spark, byte_tokenizer, word_tokenizer):
    texts = [*ODD, "twice", "twice"]
    frame = _frame(spark, ODD)
    counts = count_tokens(frame, BYTE, limit=3).collect()
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in counts) == sorted(
        (len((t or "").encode()), n := len(byte_tokenizer.encode(t or "", add_special_tokens=False).ids), n > 3) for t in texts)
    got = encode_documents(frame, WORD).collect()
    want = []
    for t in texts:
        ids = word_tokenizer.encode(t or "", add_special_tokens=False).ids
        decoded = word_tokenizer.decode(ids, skip_special_tokens=False)
        want.append((len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), ids, decoded))
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids, r.decoded) for r in got) == sorted(want)


def test_empty_tables(spark):
    empty = _frame(spark, []).where("false")
    assert count_tokens(empty, BYTE).count() == 0
    assert encode_documents(empty, WORD).count() == 0
    assert pack_documents(empty, BYTE).count() == 0


def check_packing(rows, texts_by_id, tokenizer, capacity):
    sequences, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append(r)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert set(docs) == set(texts_by_id)
    for doc_id, parts in docs.items():
        ids = [*tokenizer.encode(texts_by_id[doc_id] or "", add_special_tokens=False).ids, 2]
        parts.sort(key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts)))
        assert all(r.length == capacity for r in parts[1:])
        at = 0
        for r in parts:
            own = ids[at : at + r.length]
            assert (r.start, r.length, r.ids_crc32) == (at, len(own), zlib.crc32(struct.pack(f"<{len(own)}I", *own)))
            at += r.length
        assert at == len(ids)
    return len(sequences)


def test_pack_documents(spark, byte_tokenizer):
    rnd = random.Random(5)
    texts = dict(enumerate([*ODD, *(" ".join(["word"] * rnd.randrange(90)) for _ in range(200))]))
    frame = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in texts.items()], SCHEMA).repartition(5)
    rows = pack_documents(frame, BYTE, capacity=64).collect()
    used = check_packing(rows, texts, byte_tokenizer, 64)
    assert all(len(r.ids) == 4 * r.length for r in rows)
    assert used <= sum(r.length for r in rows) / 64 + 2


def _fewest(items, capacity):
    """Optimal number of sequences of a few pieces, by exhaustive search."""
    best = [len(items)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for j in {r: j for j, r in enumerate(rooms)}.values():
            if rooms[j] >= items[i]:
                rooms[j] -= items[i]
                place(i + 1, rooms)
                rooms[j] += items[i]
        rooms.append(capacity - items[i])
        place(i + 1, rooms)
        rooms.pop()

    place(0, [])
    return best[0]


def test_every_fixed_set_keeps_an_optimal_packing():
    rnd = random.Random(7)
    for _ in range(400):
        items = sorted((rnd.randrange(1, 21) for _ in range(rnd.randrange(1, 9))), reverse=True)
        stock = _Stock({s: items.count(s) for s in items})
        for length in set(items):
            found = _dominant(stock, length, 20)
            if found:
                rest = list(items)
                for s in found:
                    rest.remove(s)
                assert sum(found) <= 20
                assert _fewest(rest, 20) + 1 == _fewest(items, 20), (items, found)


def test_pack_lengths_holds_all_pieces():
    rnd = random.Random(9)
    for _ in range(50):
        counts = {rnd.randrange(1, 101): rnd.randrange(1, 300) for _ in range(rnd.randrange(1, 60))}
        patterns = pack_lengths(counts, 100)
        used = defaultdict(int)
        for content, times in patterns:
            assert sum(content) <= 100 and times > 0
            for length in content:
                used[length] += times
        assert dict(used) == counts
    assert pack_lengths({}, 100) == []
    with pytest.raises(ValueError):
        pack_lengths({101: 1}, 100)
    assert len(list(itertools.chain.from_iterable([c] * t for c, t in pack_lengths({50: 1000}, 100)))) == 500
