"""Merkle manifest of a table: one tree of row leaves per group, one tree of group subroots, and a proof per row.

Proofs are built as an octopus multiproof. Leaves are dealt into aligned blocks of 2**BLOCK_BITS positions;
every block builds its own interior nodes and needs from outside only the siblings of its block node's path,
which are the interior of the next round's blocks. So each block takes the missing coordinates once, from the
round above, joined by its parent block (never more than 2**BLOCK_BITS rows to a key), and expands the proofs
of its own rows locally. No round gathers more than one block in a task, whatever the size of a group.

Hashes: H(x) is the lowercase hex SHA-256 of x in UTF-8; inputs are concatenated, digests as hex text.
On a level of more than one node every 2 consecutive nodes become their H, the last run being one node when
the count is odd; a level of one node is the top. A group of one leaf has that leaf as its subroot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import stored

BLOCK_BITS = 10
STEP = "struct<sibling:string,left:boolean>"
PATH = f"array<{STEP}>"


def field(value: Column) -> Column:
    """A leaf field: `-` for null, else its UTF-8 byte count, `:` and its text (integers in decimal)."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(*values: Column) -> Column:
    """H of the fields of a row, in the given order."""
    return F.sha2(F.concat(*(field(v) for v in values)), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The top a leaf reaches along a proof path: H(sibling, node) or H(node, sibling) per step, H(node) without one."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(
        F.when(step["sibling"].isNull(), node).when(step["left"], F.concat(step["sibling"], node))
        .otherwise(F.concat(node, step["sibling"])), 256))


def proof_digest(path: Column) -> Column:
    """H of the proof's siblings, from the leaf upwards."""
    return F.sha2(F.array_join(F.transform(F.filter(path, lambda s: s["sibling"].isNotNull()), lambda s: s["sibling"]), ""), 256)


def _h(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def _build_block(block: pd.DataFrame, bits: int) -> pd.DataFrame:
    """Interior nodes of one aligned block; a path for each of its nodes and the block's top node.

    Columns in: key, idx, hash, cnt (nodes on this level of the key's tree). Rows out: one per node with its
    path (top = false), then the top node with its index and count on the level reached (top = true).
    """
    block = block.sort_values("idx", kind="stable")
    key = block["key"].iloc[0]
    first, count = int(block["idx"].iloc[0]), int(block["cnt"].iloc[0])
    level = block["hash"].tolist()
    paths: list[list[dict]] = [[] for _ in level]
    steps = 0
    while count > 1 and steps < bits:
        for j, path in enumerate(paths):
            place = j >> steps
            other = place ^ 1
            path.append({"sibling": level[other] if other < len(level) else None, "left": other < place})
        level = [_h("".join(level[i : i + 2])) for i in range(0, len(level), 2)]
        count = (count + 1) // 2
        steps += 1
    rows = pd.DataFrame({
        "key": [key] * (len(paths) + 1), "idx": [*block["idx"].tolist(), first >> steps],
        "path": [*paths, []], "hash": [None] * len(paths) + [level[0]], "cnt": [None] * len(paths) + [count],
        "top": [False] * len(paths) + [True]})
    return rows


def _rounds(nodes: DataFrame, key_type: str) -> tuple[list[DataFrame], DataFrame]:
    """Paths of every round's nodes (key, idx, path) and the top node of each key (key, hash).

    `nodes`: key, idx (0 up, gapless per key), hash, cnt (nodes of the key). Every round is a stored table.
    """
    schema = f"key {key_type}, idx long, path {PATH}, hash string, cnt long, top boolean"
    bits = BLOCK_BITS
    paths = []
    while True:
        built = stored(
            nodes.groupBy("key", F.shiftright("idx", bits).alias("_block")).applyInPandas(partial(_build_block, bits=bits), schema),
            "merkle-round")
        paths.append(built.where(~F.col("top")).select("key", "idx", "path"))
        nodes = built.where("top").select("key", "idx", "hash", "cnt")
        if nodes.where("cnt > 1").isEmpty():
            return paths, nodes.select("key", "hash")


def _compose(paths: list[DataFrame], above: DataFrame, bits: int) -> DataFrame:
    """Full paths of the first round's nodes: each round's own steps, then those of its block node above.

    `above`: key, path, carry (columns taken down to every node) for the top node of each key.
    """
    full = above.select("key", F.lit(0).cast("long").alias("idx"), "path", "carry")
    for own in reversed(paths):
        full = own.alias("o").join(
            full.alias("u"), (F.col("o.key").eqNullSafe(F.col("u.key"))) & (F.shiftright("o.idx", bits) == F.col("u.idx"))
        ).select(F.col("o.key").alias("key"), F.col("o.idx").alias("idx"), F.concat("o.path", "u.path").alias("path"), "u.carry")
    return full


def positioned(df: DataFrame, key: Column, order: Sequence[Column]) -> DataFrame:
    """Rows with `_key` and `_pos`, their place (0 up, gapless) in the order within their key.

    Rows are range-partitioned by (key, order) and numbered within their part; a part's count of rows per key
    gives its offset. No key is gathered in one task. The numbered table is stored, so numbers never change.
    """
    sort = [F.col("_key").asc_nulls_first(), *(c.asc_nulls_first() for c in order)]
    ranged = df.withColumn("_key", key).repartitionByRange(*sort).sortWithinPartitions(*sort)
    numbered = stored(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_mono", F.monotonically_increasing_id()), "merkle-rows")
    parts = numbered.groupBy("_key", "_part").agg(F.min("_mono").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        F.col("_key").alias("_k"), F.col("_part").alias("_p"), "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"), F.sum("_n").over(Window.partitionBy("_key")).alias("_count"))
    out = numbered.join(parts, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_part") == F.col("_p")))
    return out.withColumn("_pos", F.col("_offset") + F.col("_mono") - F.col("_first")).drop("_k", "_p", "_part", "_mono", "_first", "_offset")


def manifest(
    docs: DataFrame, *, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "lang",
    order: Sequence[str] = ("doc_id",), keep: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """Leaf, subroot, root and proof path of every row: columns `keep`, leaf, group value `_group`, subroot, root, path.

    A leaf is H of `fields` (see `field`). Within a value of `group`, leaves ascend by `order`, ties by leaf;
    a group's tree gives its subroot. Subroots ordered by the group value (null first, UTF-8 bytewise) give the
    root the same way. A path lists per level the sibling in the node's run (null when the run is the node
    alone) and whether it stands left; `fold(leaf, path)` gives the root.

    Nulls in any column are fields like any other (`-`); repeated rows are leaves of their own; an empty table
    gives no rows. Only the named columns are read, so other columns, also clashing ones, are ignored.
    Very long texts are hashed by Spark and never leave the JVM.
    """
    leaves = docs.select(*dict.fromkeys([*keep, group, *order]), leaf_of(*(F.col(c) for c in fields)).alias("leaf"))
    rows = positioned(leaves, F.col(group), [*(F.col(c) for c in order), F.col("leaf")])
    key_type = docs.schema[group].dataType.simpleString()
    leaf_nodes = rows.select(F.col("_key").alias("key"), F.col("_pos").alias("idx"), F.col("leaf").alias("hash"), F.col("_count").alias("cnt"))
    leaf_paths, subroots = _rounds(leaf_nodes, key_type)
    # The group tree: one key for all subroots.
    groups = positioned(subroots.withColumnRenamed("key", "grp"), F.lit(0), [F.col("grp")])
    group_paths, top = _rounds(
        groups.select(F.lit(0).alias("key"), F.col("_pos").alias("idx"), "hash", F.col("_count").alias("cnt")), "int")
    per_group = _compose(group_paths, top.select("key", F.array().cast(PATH).alias("path"), F.col("hash").alias("carry")), BLOCK_BITS)
    per_group = per_group.join(groups.select(F.col("_pos").alias("idx"), "grp", F.col("hash").alias("subroot")), "idx").select(
        F.col("grp").alias("key"), "path", F.struct("subroot", F.col("carry").alias("root")).alias("carry"))
    per_leaf = _compose(leaf_paths, per_group, BLOCK_BITS)
    per_leaf = per_leaf.select(F.col("key").alias("_k"), F.col("idx").alias("_i"), "path", "carry")
    out = rows.join(per_leaf, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_pos") == F.col("_i")))
    return out.select(
        *keep, "leaf", F.col("_key").alias("_group"), F.col("carry.subroot").alias("subroot"), F.col("carry.root").alias("root"), "path")
