"""Near-duplicate groups: fast similarity sketches, banding, exact verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tallyspark.llm.common import small, stored, with_row
from tallyspark.llm.components import star_components
from tallyspark.llm.hashing import mix, shingle_set

_AT_ONCE = 4096
_HASH_BITS = np.uint64(48)
_HASH = np.uint64((1 << 48) - 1)


class Sketcher:
    """Fast similarity sketches of `size` coordinates.

    In each of the first `size` rounds every element is thrown into a bin by that round's hash; a bin keeps
    the least (round, hash) that reached it. Bins that no round has filled get theirs from a round of their
    own in which all elements are hashed, so every coordinate is filled. A coordinate of two sets agrees with
    a probability of their Jaccard similarity, and the number of agreements is concentrated around it.
    """

    def __init__(self, size: int):
        self.size = size
        self.seeds = mix(np.arange(1, 2 * size + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))

    def __call__(self, elements: np.ndarray) -> np.ndarray:
        t = self.size
        out = np.zeros(t, np.uint64)
        open_ = np.ones(t, bool)
        first = 0
        while first < t and open_.any():
            # Later rounds never change a bin that an earlier one has filled, so several go at once.
            rounds = np.arange(first, min(t, first + max(1, _AT_ONCE // len(elements))), dtype=np.uint64)
            h = mix(elements[None, :] ^ self.seeds[rounds.astype(np.int64)][:, None])
            bins = ((h >> np.uint64(48)) * np.uint64(t) >> np.uint64(16)).astype(np.int64).ravel()
            value = ((rounds[:, None] << _HASH_BITS) | (h & _HASH)).ravel()
            order = np.lexsort((value, bins))
            bins, value = bins[order], value[order]
            lead = np.concatenate([[True], bins[1:] != bins[:-1]])
            bins, value = bins[lead], value[lead]
            new = open_[bins]
            out[bins[new]] = value[new]
            open_[bins] = False
            first += len(rounds)
        for b in np.flatnonzero(open_):
            out[b] = (np.uint64(t + b) << _HASH_BITS) | (mix(elements ^ self.seeds[t + b]) & _HASH).min()
        return out


def _band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    parts = sketch.reshape(-1, rows)
    key = np.arange(len(parts), dtype=np.uint64) + np.uint64(1)
    for i in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, i])
    return key.view(np.int64)


def _signatures(rows: DataFrame, words: int, bands: int, band_rows: int) -> DataFrame:
    """Set size, digest of the set and band keys of every row."""
    sketcher = Sketcher(bands * band_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            size, digest, keys = [], [], []
            for text in batch.column(2).to_pylist():
                own = shingle_set((text or "").encode("utf-8"), words)
                size.append(len(own))
                if len(own):
                    digest.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    keys.append(_band_keys(sketcher(own), band_rows))
                else:
                    digest.append(None)
                    keys.append(None)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(digest, pa.binary()),
                pa.array(keys, pa.list_(pa.int64())),
            ], ["_row", "doc_id", "n", "digest", "bands"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_row long, doc_id {kind}, n long, digest binary, bands array<long>")


def _bits(items: np.ndarray) -> np.ndarray:
    """A bit per item by its hash, in a power of two of bits, at least eight for each item."""
    size = max(64, 1 << int(8 * len(items) - 1).bit_length())
    out = np.zeros(size, bool)
    out[(mix(items) & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").view(np.int64)


def most_common(x: np.ndarray, y: np.ndarray, size_a: int, size_b: int) -> int:
    """An upper bound of the number of items that two sets share, from their bits.

    Every bit that only one set has is an item that the other lacks. Of two lengths the longer one is folded.
    """
    x, y = x.view(np.uint64), y.view(np.uint64)
    size = min(len(x), len(y))
    x, y = np.bitwise_or.reduce(x.reshape(-1, size)), np.bitwise_or.reduce(y.reshape(-1, size))
    return min(size_a - int(np.bitwise_count(x & ~y).sum()), size_b - int(np.bitwise_count(y & ~x).sum()))


def _sets(rows: DataFrame, words: int) -> DataFrame:
    """The whole shingle set of each (node, text), and its bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            sets = [shingle_set((t or "").encode("utf-8"), words) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("node"), pa.array([len(x) for x in sets], pa.int64()), pa.array([_bits(x) for x in sets], pa.list_(pa.int64())),
                pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "n", "bits", "items"])

    return rows.select("node", "text").mapInArrow(run, "node long, n long, bits array<long>, items binary")


def _arrays(column: pa.Array) -> list[np.ndarray]:
    return np.split(np.asarray(column.flatten()), np.cumsum(np.asarray(column.value_lengths()))[:-1]) if len(column) else []


def _may_reach(percent: int) -> Column:
    """What a join of a node with a pivot can tell from their counts and, if they have equally many, their bits."""
    def reaches(both: Column) -> Column:
        return (100 + percent) * both >= percent * (F.col("n") + F.col("pivot_n"))

    # Bits that both have; every other bit of a set is an item that the other lacks.
    both = F.aggregate(F.zip_with("bits", "pivot_bits", lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda total, x: total + x)
    shared = both + F.least(F.col("n") - F.col("ones"), F.col("pivot_n") - F.col("pivot_ones"))
    return reaches(F.least("common", "pivot_common")) & (
        (F.array_size("bits") != F.array_size("pivot_bits")) | reaches(shared))


def _plausible(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs whose bits do not rule the similarity out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            keep = []
            sizes = (batch.column(c).to_pylist() for c in ("n", "pivot_n"))
            for a, b, n, m in zip(_arrays(batch.column("bits")), _arrays(batch.column("pivot_bits")), *sizes, strict=True):
                both = most_common(a, b, n, m)
                keep.append(100 * both >= percent * (n + m - both))
            yield batch.select(["node", "pivot"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("node", "pivot", "bits", "pivot_bits", "n", "pivot_n").mapInArrow(run, "node long, pivot long")


def _shared_sizes(sets: DataFrame) -> DataFrame:
    """(node, n, bits, ones, common): the bits set, and how many items of each set another of the sets has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            for node, items in zip(batch.column("node").to_pylist(), batch.column("items").to_pylist(), strict=True):
                own = np.frombuffer(items, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), node)), pa.array(own)], ["node", "item"])

    single = sets.select("node", "items").mapInArrow(run, "node long, item long").groupBy("item").agg(
        F.count(F.lit(1)).alias("sets"), F.min("node").alias("node")).where("sets = 1").groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    return sets.select("node", "n", "bits").join(single, "node", "left").select(
        "node", "n", "bits", F.aggregate("bits", F.lit(0), lambda total, x: total + F.bit_count(x)).alias("ones"),
        (F.col("n") - F.coalesce("alone", F.lit(0))).alias("common"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose whole sets reach the similarity, in whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            keep = []
            for x, y in zip(batch.column("items").to_pylist(), batch.column("pivot_items").to_pylist(), strict=True):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select(["node", "pivot"]).filter(pa.array(keep, pa.bool_()))

    pivots = sets.select(F.col("node").alias("pivot"), F.col("items").alias("pivot_items"))
    joined = pairs.join(sets, "node").join(pivots, "pivot")
    return joined.select("node", "pivot", "items", "pivot_items").mapInArrow(run, "node long, pivot long")


def near_duplicates(
    docs: DataFrame, *, words: int = 5, percent: int = 80, bands: int = 28, band_rows: int = 4,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Every row with its group of near-duplicates: _row, doc_id, n_shingles, component_id, kept, component_row.

    A document's set are its distinct runs of `words` words (blanks separate words, A-Z in lower case), or all
    its words as one if it has fewer. Documents are linked if 100 * intersection >= percent * union, confirmed
    on the whole sets. component_id is the smallest identifier that links lead to, kept is doc_id =
    component_id. A row without words, or with a null text, is alone with n_shingles 0. Repeated rows are in
    one group; a null identifier is never the smallest of a group with others, alone it is its own. An empty
    table gives no rows; other columns are not read. `_row` numbers the rows of the stored table as `with_row` does.
    component_row is the `_row` of one row of the group: it tells groups apart whose identifiers are null or repeated.

    Equal sets are one node. Nodes meet in buckets of equal band keys; with 28 bands of 4 coordinates a pair
    at 80 % shares none with a probability of 4e-7. A bucket is finished when its nodes are in one component or
    all pairs between components are decided, without listing all pairs. First all are compared with the
    bucket's smallest node; links found anywhere merge components, which finishes most buckets. In those still
    open, a set can share at most the items that another open set has too: nodes and pairs for which that is too
    little are decided by counting, and so are pairs by a bit per item. For the rest some nodes of each bucket are pivots and the nodes of other
    components are compared with those only; their number grows eightfold from round to round, so a bucket of
    many unlinked nodes takes a logarithmic number of rounds. Before two sets move they have to pass a bound
    from a bit per item, which never rules out a link.
    """
    rows = with_row(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), "doc_id", "text")
    all_rows = stored(_signatures(rows.select("_row", "doc_id", "text"), words, bands, band_rows), "near-signatures")
    nodes = stored(
        all_rows.where("n > 0").groupBy("digest")
        .agg(F.min(F.struct("_row", "bands")).alias("first"), F.min("doc_id").alias("least"))
        .select(F.col("first._row").alias("node"), "digest", "least", "first.bands"),
        "near-nodes")
    dealt = nodes.select("node", F.explode("bands").alias("key"))
    shared = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("pivot")).where("size > 1")
    buckets = stored(dealt.join(shared, "key").select("key", "node", "pivot"), "near-buckets")
    wanted = buckets.select("node").distinct()
    sets = stored(_sets(rows.select(F.col("_row").alias("node"), "text").join(wanted, "node"), words), "near-sets")

    small = sets.select("node", "n", "bits")
    pivot_small = sets.select(F.col("node").alias("pivot"), F.col("n").alias("pivot_n"), F.col("bits").alias("pivot_bits"))

    def links(pairs: DataFrame) -> DataFrame:
        sized = pairs.join(small, "node").join(pivot_small, "pivot").where(
            100 * F.least("n", "pivot_n") >= percent * F.greatest("n", "pivot_n"))
        return stored(_verified(stored(_plausible(sized, percent), "near-pairs"), sets, percent), "near-links")

    def undecided(labels: DataFrame, members: DataFrame) -> DataFrame:
        """The members of buckets with more than one component."""
        member = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        open_keys = member.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
        return member.join(open_keys, "key")

    # First round: the smallest node of each bucket is the pivot of all others.
    edges = links(buckets.where("node <> pivot").select("node", "pivot").distinct())
    labels = star_components(edges.select(F.col("node").alias("u"), F.col("pivot").alias("v")))
    left = stored(undecided(labels, buckets.where("node <> pivot").select("key", "node")).select("key", "node"), "near-open")
    counted = _shared_sizes(sets.join(left.select("node").distinct(), "node", "left_semi")).where(100 * F.col("common") >= percent * F.col("n"))
    left = stored(left.join(counted, "node"), "near-counted")
    pivots_each = 8
    while True:
        # All but the component with most nodes have to be compared; what stays undecided is one component.
        left = stored(undecided(labels, left).select("key", "node", "n", "bits", "ones", "common", "label"), "near-left")
        main = left.groupBy("key", "label").agg(F.count(F.lit(1)).alias("size")).groupBy("key").agg(
            F.max(F.struct("size", "label")).alias("most"))
        order = Window.partitionBy("key").orderBy("node")
        chosen = stored(
            left.join(main, "key").where("label <> most.label").withColumn("nth", F.row_number().over(order))
            .where(F.col("nth") <= pivots_each).select(
                "key", *(F.col(c).alias(f"pivot_{c}") for c in ("n", "bits", "ones", "common", "label")), F.col("node").alias("pivot")), "near-pivots")
        if chosen.isEmpty():
            break
        met = (left["key"] == chosen["key"]) & (F.col("label") != F.col("pivot_label")) & _may_reach(percent)
        found = links(left.join(chosen, met).select("node", "pivot").distinct())
        if not found.isEmpty():
            labels = star_components(
                labels.select(F.col("node").alias("u"), F.col("label").alias("v")).unionByName(
                    found.select(F.col("node").alias("u"), F.col("pivot").alias("v"))))
        left = left.drop("label").join(chosen.select("key", F.col("pivot").alias("node")), ["key", "node"], "left_anti")
        pivots_each *= 8

    grouped = nodes.select("node", "digest", "least").join(labels, "node", "left").withColumn(
        "label", F.coalesce("label", "node"))
    smallest = grouped.groupBy("label").agg(F.min("least").alias("component_id"))
    component = stored(
        grouped.join(smallest, "label").select("digest", "component_id", F.col("label").alias("component_row")), "near-components")
    with_words = all_rows.where("n > 0").select("_row", "doc_id", "n", "digest").join(component, "digest").select(
        "_row", "doc_id", F.col("n").alias("n_shingles"), "component_id", "component_row")
    without = all_rows.where("n = 0").select(
        "_row", "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"),
        F.col("_row").alias("component_row"))
    return with_words.unionByName(without).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
