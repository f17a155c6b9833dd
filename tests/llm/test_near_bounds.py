"""Bounds that decide pairs of a bucket before their sets move."""

import numpy as np

from pyspark.sql import functions as F

from tallyspark.llm.components import star_components
from tallyspark.llm.minhash import _bits, _may_reach, _shared_sizes, most_common

PERCENT = 80


def test_pairs_are_kept_exactly_when_counts_and_bits_allow_them(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(1, 1 << 62, 200, dtype=np.int64)
    sets = []
    for size, fresh in ((100, 0), (100, 5), (100, 12), (100, 60), (70, 3), (120, 0), (40, 0), (101, 9), (1, 0), (99, 99)):
        sets.append(np.unique(np.concatenate([base[: size - fresh], rng.integers(1, 1 << 62, fresh, dtype=np.int64)])))
    rows = [(i, len(x), _bits(x.view(np.uint64)).tolist(), bytearray(x.tobytes())) for i, x in enumerate(sets)]
    counted = _shared_sizes(spark.createDataFrame(rows, "node long, n long, bits array<long>, items binary"))
    common = {r.node: r.common for r in counted.collect()}
    pivots = counted.select(*(F.col(c).alias("pivot" if c == "node" else f"pivot_{c}") for c in counted.columns))
    got = {(r.node, r.pivot) for r in counted.crossJoin(pivots).where("node <> pivot").where(_may_reach(PERCENT)).collect()}
    want = set()
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            x, y = (np.array(rows[k][2], np.int64) for k in (i, j))
            # Of sets with lists of different lengths only the counts decide here.
            bounds = [min(common[i], common[j])] + ([most_common(x, y, len(a), len(b))] if len(x) == len(y) else [])
            if i != j and all(100 * s >= PERCENT * (len(a) + len(b) - s) for s in bounds):
                want.add((i, j))
    assert got == want and (0, 1) in got and (0, 3) not in got
    # The lists of a pair are gone through once: a bucket with many open pairs spends its time there.
    assert str(_may_reach(PERCENT)).count("zip_with") == 1


def test_components_of_a_path_a_star_and_a_clique(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 130)]
    clique = [(a, b) for a in range(200, 206) for b in range(200, 206)]
    got = dict(star_components(spark.createDataFrame(path + star + clique, "u long, v long")).collect())
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), **dict.fromkeys(range(200, 206), 200)}
