"""Token counts by byte-pair merging with a heap and a linked list, without making any ids."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

from tallyspark.llm.vocab import BYTE_LEVEL_PATTERN, Splitter, WordCache, byte_letters, load, special_splitter

_SHIFT = 32
_LOW = (1 << _SHIFT) - 1


class MergeCounter:
    """Counts tokens of a byte-level BPE file: initial symbols minus merges."""

    def __init__(self, path: str):
        spec = load(path)
        number: dict[str, int] = {}

        def code(symbol: str) -> int:
            return number.setdefault(symbol, len(number))

        self.byte_code = [code(letter) for letter in byte_letters()]
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for rank, (left, right) in enumerate(spec["model"]["merges"]):
            self.rank.setdefault(code(left) << _SHIFT | code(right), rank)
            self.made.append(code(left + right))
        self.special = special_splitter(spec)
        self.words = Splitter(BYTE_LEVEL_PATTERN)
        self.cache = WordCache(self.count_word)

    def count_word(self, word: str) -> int:
        """Symbols left in one word when no adjacent pair can be merged: the lowest rank first, then the leftmost."""
        codes = [self.byte_code[b] for b in word.encode("utf-8")]
        n = left = len(codes)
        rank_of = self.rank.get
        heap = [
            rank << _SHIFT | at for at in range(n - 1)
            if (rank := rank_of(codes[at] << _SHIFT | codes[at + 1])) is not None]
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            entry = heappop(heap)
            at, rank = entry & _LOW, entry >> _SHIFT
            other = after[at]
            # A symbol that was merged away, or a neighbour that changed, leaves an outdated entry behind.
            if codes[at] < 0 or other >= n or rank_of(codes[at] << _SHIFT | codes[other]) != rank:
                continue
            codes[at], codes[other] = self.made[rank], -1
            left -= 1
            following, leading = after[other], before[at]
            after[at] = following
            if following < n:
                before[following] = at
                if (new := rank_of(codes[at] << _SHIFT | codes[following])) is not None:
                    heappush(heap, new << _SHIFT | at)
            if leading >= 0 and (new := rank_of(codes[leading] << _SHIFT | codes[at])) is not None:
                heappush(heap, new << _SHIFT | leading)
        return left

    def count(self, text: str) -> int:
        parts = self.special.split(text) if self.special else [text]
        # Odd parts are the added tokens, one token each.
        return sum(sum(map(self.cache.__getitem__, self.words(part))) for part in parts[::2]) + len(parts) // 2


@lru_cache(maxsize=2)
def counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def count_tokens(
    docs: DataFrame, tokenizer: str, *, limit: int = 512, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every row's whole text.

    `tokenizer` is the path of a byte-level BPE file in the format of the tokenizers library. No begin, end or
    other special tokens are added; their strings inside a text count as one token. Null and empty texts have
    no bytes and no tokens. Repeated rows and null identifiers pass through; other columns are not read.

    Rows never move: each task splits its texts into words and merges each new word once. A worker keeps the
    counts of a bounded number of words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer).count
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens = [count(t) for t in texts]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()),
                pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_()),
            ], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
