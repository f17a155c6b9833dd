"""Best-fit packing of documents into sequences, after Martello-Toth dominance reduction."""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tallyspark.llm.common import small, stored
from tallyspark.llm.vocab import BYTE_LEVEL_POSSESSIVE, byte_letters, is_newer, load


class Encoder:
    """Ids as the tokenizers library gives them for a byte-level BPE file, as little-endian unsigned 32-bit bytes.

    Where merges are in the order of their ids, as in such files, a faster library with the same vocabulary does
    the work. Texts with code points that this Python does not know, and files in another order, go to the
    tokenizers library itself.
    """

    def __init__(self, path: str):
        self.exact = tokenizers.Tokenizer.from_file(path)
        self.exact.no_truncation()
        self.exact.no_padding()
        spec = load(path)
        byte_of = {letter: byte for byte, letter in enumerate(byte_letters())}
        vocab: dict[str, int] = spec["model"]["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        made = [vocab[left + right] for left, right in spec["model"]["merges"]]
        self.fast = None
        if made == sorted(made) and len(vocab) == len(made) + 256:
            ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in added}
            self.fast = tiktoken.Encoding("packing", pat_str=BYTE_LEVEL_POSSESSIVE, mergeable_ranks=ranks, special_tokens=added)

    def __call__(self, text: str) -> bytes:
        if self.fast is None or is_newer(text):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut_pieces(
    docs: DataFrame, tokenizer: str, *, capacity: int, end_id: int, with_ids: bool, id_col: str, text_col: str,
) -> DataFrame:
    """Pieces of every document with their place among the pieces of the same length in their partition.

    Columns: doc_id, piece, start, length, ids_crc32, ids (if asked for), part, nth. A document longer than
    the capacity is cut into full pieces; the first piece takes the rest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in small(batches):
            rows: list[int] = []
            columns: list[list] = [[] for _ in range(6)]
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = encode(text or "") + end
                total = len(ids) // 4
                at, length = 0, total % capacity or capacity
                piece = 0
                while at < total:
                    own = ids[4 * at : 4 * (at + length)]
                    rows.append(row)
                    for column, value in zip(
                        columns, (piece, at, length, zlib.crc32(own), own if with_ids else None, int(seen[length])), strict=True):
                        column.append(value)
                    seen[length] += 1
                    at, length, piece = at + length, capacity, piece + 1
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            arrays = [batch.column(0).take(pa.array(rows, pa.int64()))]
            arrays += [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            arrays.append(pa.array(np.full(len(rows), part, np.int64)))
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "nth", "part"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, ids binary, nth long, part long")


Pattern = tuple[tuple[int, ...], int]


class _Stock:
    """Lengths and how many pieces of each are left."""

    def __init__(self, counts: dict[int, int]):
        self.left = Counter({length: n for length, n in counts.items() if n > 0})
        self.sizes = sorted(self.left)

    def take(self, lengths: tuple[int, ...], times: int) -> None:
        for length in lengths:
            self.left[length] -= times
        self.sizes = [s for s in self.sizes if self.left[s] > 0]

    def smallest(self, without: int, n: int, above: int = 0) -> list[int]:
        """The n smallest lengths left that are greater than `above`, besides one piece of `without`."""
        out: list[int] = []
        for size in self.sizes[bisect_right(self.sizes, above):]:
            out += [size] * min(self.left[size] - (size == without), n - len(out))
            if len(out) == n:
                break
        return out

    def largest_within(self, room: int, *without: int) -> int | None:
        for size in reversed(self.sizes[:bisect_right(self.sizes, room)]):
            if self.left[size] > without.count(size):
                return size
        return None

    def best_pair_within(self, room: int, without: int) -> tuple[int, int] | None:
        """The two lengths left with the largest sum within the room."""
        best: tuple[int, int] | None = None
        for size in reversed(self.sizes[:bisect_left(self.sizes, room)]):
            if self.left[size] > (size == without):
                other = self.largest_within(min(size, room - size), without, size)
                if other is not None and (best is None or size + other > sum(best)):
                    best = (size, other)
        return best


def _dominant(stock: _Stock, length: int, capacity: int) -> tuple[int, ...] | None:
    """A set with a piece of this length that some optimal packing contains as one sequence, if one is seen.

    A set dominates another if its pieces can stand in for the other's, each for some that are no longer in
    sum. Some best packing then uses it, so it can be fixed:
    * nothing else fits: the piece alone;
    * the longest piece that fits fills the sequence, or no two pieces fit beside: that pair;
    * no three pieces fit beside: the pair again if the longest piece is at least as long as any two that fit,
      or else the best two if one is the longest that fits and no two pieces longer than the other fit.
    Taking pieces away only removes alternatives, so a set stays dominant while it has pieces.
    """
    room = capacity - length
    longest = stock.largest_within(room, length)
    if longest is None:
        return (length,)
    low = stock.smallest(length, 3)
    if longest == room or len(low) < 2 or sum(low[:2]) > room:
        return (length, longest)
    if len(low) < 3 or sum(low) > room:
        pair = stock.best_pair_within(room, length)
        if pair is None or longest >= sum(pair):
            return (length, longest)
        above = stock.smallest(length, 2, above=pair[1])
        if pair[0] == longest and (len(above) < 2 or sum(above) > room):
            return (length, *pair)
    return None


def reduce_by_dominance(stock: _Stock, capacity: int) -> list[Pattern]:
    """Fix dominating sets until none is found, the longest pieces first, each as often as it has pieces."""
    fixed: list[Pattern] = []
    again = True
    while again and stock.sizes:
        again = False
        for length in reversed(stock.sizes):
            while stock.left[length] > 0 and (found := _dominant(stock, length, capacity)):
                times = min(stock.left[s] // n for s, n in Counter(found).items())
                stock.take(found, times)
                fixed.append((found, times))
                again = True
    return fixed


def best_fit(stock: _Stock, capacity: int) -> list[Pattern]:
    """Best fit, the longest pieces first, for all pieces of a length and all equal sequences at once."""
    open_: dict[int, dict[tuple[int, ...], int]] = {}
    for length in reversed(list(stock.sizes)):
        left = stock.left[length]
        while left:
            room = min((r for r in open_ if r >= length), default=None)
            if room is None:
                # A new sequence goes on being the tightest one for its length until it is full.
                fill = capacity // length
                whole, rest = divmod(left, fill)
                for times, n in ((whole, fill), (1, rest)):
                    if times and n:
                        group = open_.setdefault(capacity - n * length, {})
                        group[(length,) * n] = group.get((length,) * n, 0) + times
                break
            group = open_[room]
            content, times = next(iter(group.items()))
            fill = min(room // length, left)
            whole = min(times, left // fill)
            if whole == times:
                del group[content]
            else:
                group[content] = times - whole
            if not group:
                del open_[room]
            target = open_.setdefault(room - fill * length, {})
            grown = content + (length,) * fill
            target[grown] = target.get(grown, 0) + whole
            left -= whole * fill
    return [(content, times) for group in open_.values() for content, times in group.items()]


def pack_lengths(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Sequences as (lengths in order, how many such): dominance reduction first, best fit for what remains."""
    if any(not 0 < length <= capacity for length in counts):
        raise ValueError("a piece is empty or longer than a sequence")
    stock = _Stock(counts)
    return reduce_by_dominance(stock, capacity) + best_fit(stock, capacity)


def _places(patterns: list[Pattern]) -> dict[int, np.ndarray]:
    """Per length: rows (first rank, first sequence, offset); ranks of a length run on through its rows."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    taken: Counter[int] = Counter()
    sequence = 0
    for content, times in patterns:
        offset = 0
        for length in content:
            rows.setdefault(length, []).append((taken[length], sequence, offset))
            taken[length] += times
            offset += length
        sequence += times
    return {length: np.array(r, np.int64) for length, r in rows.items()}


def pack_documents(
    docs: DataFrame, tokenizer: str, *, capacity: int = 1024, end_id: int = 2, with_ids: bool = True,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """All documents in as few sequences of at most `capacity` tokens as best fit finds.

    A document is its text's ids and then `end_id`; only a longer one is cut, into full pieces of which the
    first may be shorter. Null and empty texts are the end id alone. Returns one row per piece: doc_id, piece,
    start, length, ids_crc32, sequence_id, offset and, unless told otherwise, ids (little-endian unsigned
    32-bit). Sequences are filled from offset 0 without gaps. Repeated rows are separate documents, null
    identifiers pass through, an empty table gives no rows; other columns are not read.

    Packing only needs how many pieces of each length there are. That histogram has at most `capacity` rows
    whatever the size of the table; it alone goes to the driver, which packs all pieces of a length at once.
    The plan has a few rows per length and goes back with the tasks. A piece finds its place by its rank among
    the pieces of its length: its rank in its partition, counted while the text is read, plus the number in
    the partitions before. So no length, however common, is gathered anywhere.
    """
    pieces = stored(
        cut_pieces(docs, tokenizer, capacity=capacity, end_id=end_id, with_ids=with_ids, id_col=id_col, text_col=text_col),
        "pieces")
    per_part = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = _places(pack_lengths(counts, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            ranks = batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
            for length in np.unique(lengths):
                own, runs = lengths == length, places[int(length)]
                at = np.searchsorted(runs[:, 0], ranks[own], side="right") - 1
                sequence[own] = runs[at, 1] + ranks[own] - runs[at, 0]
                offset[own] = runs[at, 2]
            names = batch.schema.names
            kept = [(n, batch.column(n)) for n in names if n != "rank"]
            kept += [("sequence_id", pa.array(sequence)), ("offset", pa.array(offset))]
            yield pa.RecordBatch.from_arrays([c for _, c in kept], [n for n, _ in kept])

    ranked = pieces.join(offsets, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []),
        (F.col("nth") + F.col("earlier")).alias("rank"))
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema.fields if f.name != "rank"]
    return ranked.mapInArrow(place, ", ".join([*kinds, "sequence_id long", "offset long"]))
