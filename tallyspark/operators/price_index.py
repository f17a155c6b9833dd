"""Interval price index: per price key one sorted array of validity segments, looked up by binary search.

Price lists are small per key but usage is the big table. Joining usage to prices by a range condition makes
Spark either nest loops or shuffle usage by SKU whole, so that one hot SKU lands in one task, and rows that
overlap in time double usage silently. Here every key's windows are flattened into non-overlapping segments
once; usage meets its key's array by an equality join (broadcast when the measured index is small, else by
salted keys so that a hot key is spread over many tasks) and finds its segment by binary search in the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# An index up to this many bytes is sent whole to every task; a larger one is joined by salted keys.
BROADCAST_BYTES = 64 << 20
SALTS = 32
# Bytes a key and a segment take at most in the estimate, beyond their data.
_ROW_BYTES, _SEGMENT_BYTES = 48, 40


def price_index(prices: DataFrame, keys: Sequence[str], price: Column, start: str, end: str) -> DataFrame:
    """One row per key: the keys and `segments`, array<struct<from, to, price>> ascending and without overlap.

    A window is valid from `start` up to, not including, `end`; a null end never ends, a null start or an end
    not after the start is never valid. Where windows overlap, the one that started last holds (equal starts:
    the one that ends last, then the greatest price). Keys are compared as given, nulls included.
    """
    never = F.lit("9999-12-31 23:59:59").cast("timestamp")
    windows = prices.select(
        *keys, F.struct(F.col(start).alias("from"), F.coalesce(F.col(end), never).alias("to"), price.alias("price")).alias("w")
    ).where(F.col("w.from").isNotNull() & (F.col("w.from") < F.col("w.to")))
    grouped = windows.groupBy(*keys).agg(F.collect_list("w").alias("_ws"))
    bounds = F.array_sort(F.array_distinct(F.flatten(F.transform("_ws", lambda w: F.array(w["from"], w["to"])))))

    def segment(k: Column) -> Column:
        lo, hi = F.try_element_at(F.col("_b"), k + 1), F.try_element_at(F.col("_b"), k + 2)
        covering = F.filter("_ws", lambda w: (w["from"] <= lo) & (hi <= w["to"]))
        newest = F.aggregate(covering, F.lit(None).cast(windows.schema["w"].dataType), lambda acc, w: F.greatest(acc, w))
        return F.struct(lo.alias("from"), hi.alias("to"), newest["price"].alias("price"), F.size(covering).alias("n"))

    steps = F.when(F.size("_b") >= 2, F.sequence(F.lit(0), F.size("_b") - 2)).otherwise(F.array().cast("array<int>"))
    cut = F.transform(steps, segment)
    held = F.filter(cut, lambda s: s["n"] > 0)
    return grouped.withColumn("_b", bounds).select(
        *keys, F.transform(held, lambda s: F.struct(s["from"].alias("from"), s["to"].alias("to"), s["price"].alias("price"))).alias("segments"))


def find_segment(segments: Column, at: Column) -> Column:
    """The price of the segment holding `at`, by binary search over the segments' starts; NULL outside all."""
    n = F.size(segments)
    rounds = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.log2(n + 2)).cast("int")))

    def step(acc: Column, _: Column) -> Column:
        mid = F.shiftright(acc["lo"] + acc["hi"], 1)
        wide = acc["hi"] - acc["lo"] > 1
        below = F.try_element_at(segments, F.greatest(mid, F.lit(1)))["from"] <= at
        return F.struct(
            F.when(wide & below, mid).otherwise(acc["lo"]).alias("lo"),
            F.when(wide & ~below, mid).otherwise(acc["hi"]).alias("hi"))

    found = F.aggregate(rounds, F.struct(F.lit(0).alias("lo"), (n + 1).alias("hi")), step)["lo"]
    hit = F.try_element_at(segments, F.greatest(found, F.lit(1)))
    return F.when(at.isNotNull() & (found >= 1) & (at < hit["to"]), hit["price"])


def with_price(
    usage: DataFrame, index: DataFrame, on: Sequence[tuple[Column, str]], at: Column, name: str, *, spread: Sequence[Column] = (),
) -> DataFrame:
    """Usage with column `name`: the price of its key valid at `at` (NULL without one); no row is added or lost.

    `on` pairs a usage column with the index key it equals (null keys never match). The index is measured:
    up to BROADCAST_BYTES it is broadcast and usage does not move; beyond it usage and index meet on
    (key, salt), the salt a hash of `at` and `spread` over SALTS values, with every index row copied to each salt.
    """
    key_bytes = sum((F.coalesce(F.octet_length(F.col(key).cast("string")), F.lit(0)) for _, key in on), F.lit(0))
    sizes = index.agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(key_bytes), F.lit(0)).alias("key_bytes"),
        F.coalesce(F.sum(F.size("segments")), F.lit(0)).alias("segments")).first()
    estimate = sizes["rows"] * _ROW_BYTES + sizes["key_bytes"] + sizes["segments"] * _SEGMENT_BYTES
    right = index.select(*(F.col(key).alias(f"_ix_{i}") for i, (_, key) in enumerate(on)), F.col("segments").alias("_segments"))
    same = [c == F.col(f"_ix_{i}") for i, (c, _) in enumerate(on)]
    if estimate <= BROADCAST_BYTES:
        joined = usage.join(F.broadcast(right), _all(same), "left")
    else:
        salted = usage.withColumn("_salt", F.pmod(F.xxhash64(at, *spread), F.lit(SALTS)))
        copies = right.withColumn("_ix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(copies, _all([*same, F.col("_salt") == F.col("_ix_salt")]), "left").drop("_salt", "_ix_salt")
    out = joined.withColumn(name, find_segment(F.col("_segments"), at))
    return out.drop("_segments", *(f"_ix_{i}" for i in range(len(on))))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
