"""Largest inner products by an inverted file with adaptive dimension scans."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tallyspark.llm.common import stored

_SEED = 12


class Lists:
    """Rotation, centroids and what a scan needs of the sample; small, and sent along with the tasks.

    With all vectors lifted to the same length M by one more coordinate, sqrt(M^2 - |x|^2), the largest inner
    product is the smallest Euclidean distance.
    """

    def __init__(self, sample: np.ndarray, longest: float, lists: int):
        rng = np.random.default_rng(_SEED)
        self.dim, self.longest = sample.shape[1], longest
        self.turn = np.linalg.qr(rng.normal(size=(self.dim + 1, self.dim + 1)))[0]
        self.sample = self.lifted(sample)
        count = max(1, min(lists, len(sample) // 32))
        self.centroids = self.sample[rng.permutation(len(sample))[:count]].copy()
        for _ in range(12):
            of = self.nearest(self.sample)
            for i in range(count):
                if len(own := self.sample[of == i]):
                    self.centroids[i] = own.mean(axis=0)
        self.sample_list = self.nearest(self.sample)

    def lifted(self, vectors: np.ndarray, query: bool = False) -> np.ndarray:
        """Rotated and lifted vectors. A query is not lifted: that adds the same to all its distances."""
        more = np.zeros(len(vectors)) if query else np.sqrt(np.maximum(0, self.longest**2 - (vectors**2).sum(axis=1)))
        return np.hstack([vectors, more[:, None]]) @ self.turn

    def distances(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.maximum(0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T)

    def nearest(self, vectors: np.ndarray) -> np.ndarray:
        return self.distances(vectors, self.centroids).argmin(axis=1)


def scan(queries: np.ndarray, bound: np.ndarray, vectors: np.ndarray, epsilon: float, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, vector) that no test abandons, for rotated vectors.

    Columns come in blocks. After d of D columns the partial squared distance, times D/d, estimates the whole one;
    if it exceeds the query's bound by more than a factor (1 + epsilon / sqrt(d))^2, the hypothesis that the
    vector lies within the bound is rejected and the pair is not looked at again.
    """
    dims = queries.shape[1]
    limit = bound * (1 + 1e-9) + 1e-12
    first = queries[:, :step], vectors[:, :step]
    partial = (first[0] ** 2).sum(axis=1)[:, None] + (first[1] ** 2).sum(axis=1)[None, :] - 2 * first[0] @ first[1].T
    seen = min(step, dims)
    slack = lambda d: d / dims * (1 + epsilon / math.sqrt(d)) ** 2 if d < dims else 1.0
    q, v = np.nonzero(partial <= (limit * slack(seen))[:, None] + 1e-9)
    partial = partial[q, v]
    while seen < dims and len(q):
        block = slice(seen, min(seen + step, dims))
        partial = partial + ((queries[q, block] - vectors[v, block]) ** 2).sum(axis=1)
        seen = block.stop
        stay = partial <= limit[q] * slack(seen) + 1e-9
        q, v, partial = q[stay], v[stay], partial[stay]
    return q, v


def _best(query: np.ndarray, vec_id: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query, ties to the smaller identifier."""
    order = np.lexsort((vec_id, -score, query))
    sorted_query = query[order]
    start = np.concatenate([[True], sorted_query[1:] != sorted_query[:-1]])
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(start, np.arange(len(order)), 0))
    return order[rank < k]


def nearest_by_product(
    vectors: DataFrame, is_query, *, k: int = 20, lists: int = 64, coverage: float = 0.85, epsilon: float = 2.1, step: int = 16,
    sample_rows: int = 4096, block_rows: int = 256, query_rows: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """The k rows of largest inner product for every query: query_id, rank (from 1), vec_id, score.

    Queries are the rows for which the column `is_query` holds, candidates all rows but the query's own.
    Vectors that are null, zero, of another length than the longest, or with null or non-finite components take no part, nor do
    rows with a null identifier; rows with the same identifier count once, with their largest product. Ties go
    to the smaller identifier. The score is the product of the original vectors in double precision. Fewer
    candidates than k give fewer rows, no candidates or an empty table none. Other columns are not read.

    Rotation and centroids are fitted on `sample_rows` vectors (chosen by a hash of the identifier) on the
    driver; every row is indexed. A query probes the nearest lists until they hold a share `coverage` of all
    rows. The sampled vectors in its lists give it a distance that the k-th best is expected to stay within, and
    the adaptive scan abandons candidates against it. A list is split into blocks of about `block_rows` rows and
    queries into blocks of about `query_rows`; a task holds one of each, so neither a list with most of the rows
    nor many queries gather anywhere. A higher coverage finds more; near-uniform vectors, where lists say
    little, need most of the rows.
    """
    spark = vectors.sparkSession
    number = F.col("embedding")
    usable = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"), is_query.alias("is_query")).where(
        F.col("vec_id").isNotNull() & number.isNotNull()
        & F.forall(number, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(number, lambda x: x != 0))
    size = usable.agg(
        F.max(F.array_size("embedding")).alias("dim"), F.count(F.lit(1)).alias("rows"),
        F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)).alias("square"),
    ).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not size["rows"]:
        return spark.createDataFrame([], schema)
    dim = size["dim"]
    usable = usable.where(F.array_size("embedding") == dim)
    sample = usable.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("embedding").toArrow()
    index = Lists(np.array(sample.column(0).to_pylist(), float), math.sqrt(size["square"]), lists)
    shared = spark.sparkContext.broadcast(index)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                data = np.asarray(batch.column("embedding").flatten()).reshape(-1, dim)
                of = shared.value.nearest(shared.value.lifted(data))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(of.astype(np.int32))], [*batch.schema.names, "list"])

    listed = stored(usable.mapInArrow(assign, "vec_id long, embedding array<double>, is_query boolean, list int"), "ann-lists")
    sizes = dict(listed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect())
    list_rows = np.array([sizes.get(i, 0) for i in range(len(index.centroids))])
    parts = [max(1, math.ceil(n / block_rows)) for n in list_rows]
    n_queries = listed.where("is_query").count()
    query_blocks = max(1, math.ceil(n_queries / query_rows))
    parts_of = F.get(F.array(*[F.lit(p) for p in parts]), F.col("list"))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            data = own.lifted(np.asarray(batch.column("embedding").flatten()).reshape(-1, dim), query=True)
            order = own.distances(data, own.centroids).argsort(axis=1)
            held = np.cumsum(list_rows[order], axis=1)
            enough = max(coverage * list_rows.sum(), min(k + 1, list_rows.sum()))
            take = np.argmax(held >= enough, axis=1) + 1
            probes, bounds = [], []
            near = own.distances(data, own.sample)
            for row in range(len(data)):
                mine = order[row, : take[row]]
                # One of the sampled may be the query itself, and a test may err: a few more than k make the bound.
                known = near[row, np.isin(own.sample_list, mine)]
                rank = k + 8
                bounds.append(float(np.partition(known, rank)[rank]) if len(known) > rank else math.inf)
                probes.append(mine)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("embedding"), pa.array(bounds, pa.float64()), pa.array(probes, pa.list_(pa.int32()))],
                ["query_id", "query", "bound", "lists"])

    queries = listed.where("is_query").select("vec_id", "embedding").mapInArrow(
        probe, "query_id long, query array<double>, bound double, lists array<int>")
    asked = queries.select("query_id", "query", "bound", F.explode("lists").alias("list")).select(
        "query_id", "query", "bound", "list", F.explode(F.sequence(F.lit(0), parts_of - 1)).alias("part"),
        F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int").alias("block"))
    held = listed.select(
        "vec_id", "embedding", "list", F.pmod(F.xxhash64("vec_id"), parts_of).cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("block"))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        own = shared.value
        if not (left.num_rows and right.num_rows):
            return pa.Table.from_pydict(
                {"query_id": [], "vec_id": [], "score": []},
                schema=pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))
        query_id, vec_id = left.column("query_id").to_numpy(), right.column("vec_id").to_numpy()
        query = np.asarray(left.column("query").combine_chunks().flatten()).reshape(-1, dim)
        data = np.asarray(right.column("embedding").combine_chunks().flatten()).reshape(-1, dim)
        q, v = scan(own.lifted(query, query=True), left.column("bound").to_numpy(), own.lifted(data), epsilon, step)
        other = query_id[q] != vec_id[v]
        q, v = q[other], v[other]
        score = np.einsum("ij,ij->i", query[q], data[v])
        best = _best(query_id[q], vec_id[v], score, k)
        return pa.table({"query_id": query_id[q[best]], "vec_id": vec_id[v[best]], "score": score[best]})

    found = asked.groupBy("list", "part", "block").cogroup(held.groupBy("list", "part", "block")).applyInArrow(
        cell, "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
