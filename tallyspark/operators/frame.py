"""Small helpers the operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

NONE_LABEL = "(none)"
UNKNOWN_LABEL = "(unknown)"


def in_short_methods(df: DataFrame, column: str) -> DataFrame:
    """The same rows; the projection that derives them is compiled as many short methods.

    The rules of a wide plane, fused with its scan and joins, make one generated loop of more than the 8,000 bytes that the
    JVM compiles, and it is interpreted for every row. A lambda keeps the projection out of that loop.
    """
    return df.withColumn(column, F.transform(F.array(column), lambda v: v).getItem(0))


def month_date(c: str | Column) -> Column:
    """'YYYY-MM' text as the first day of that month."""
    col = F.col(c) if isinstance(c, str) else c
    return F.to_date(F.concat(col, F.lit("-01")))


def month_start(c: Column) -> Column:
    return F.trunc(c, "MM")


def sum_if(value: Column, condition: Column) -> Column:
    """Sum over matching rows; NULL when none match."""
    return F.sum(F.when(condition, value))


def max_by_present(value: Column, weight: Column) -> Column:
    """Heaviest row's value among rows that have one; equal weights go to the greatest value."""
    return F.max_by(value, F.when(value.isNotNull(), F.struct(weight, value)))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def ratio(a: Column, b: Column) -> Column:
    """Double division, NULL on a zero denominator."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def top_rows(df: DataFrame, n: int | None, *order: Column) -> DataFrame:
    """Global top n (Spark keeps n rows per partition before merging), or all rows without a number."""
    return df if n is None else df.orderBy(*order).limit(n)


def exact_avg(c: str) -> Column:
    """Average of a double by its exact decimal sum, so that the order of summation never decides a rounding."""
    return ratio(F.sum(F.col(c).cast("decimal(18,6)")), F.count(c))


def wide(df: DataFrame, c: str) -> Column:
    """A column for sums: whole numbers as decimals, because byte counts of many rows add up past a bigint."""
    col = F.col(c)
    return col.cast("decimal(20,0)") if isinstance(df.schema[c].dataType, IntegralType) else col


def ranked(df: DataFrame, keys: list[str], order: list[Column], n: int | None = 1) -> DataFrame:
    """First n rows of each key, or all rows without a number."""
    if n is None:
        return df
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def broadcast_single(df: DataFrame) -> DataFrame:
    """Mark a one-row (global aggregate) frame as broadcastable."""
    return F.broadcast(df)


def latest_by_key(df: DataFrame, keys: list[str], version: str, columns: list[str]) -> DataFrame:
    """Newest row per key as one partial-friendly aggregate, not a per-key sort.

    NULL versions lose to any dated version. Equal versions go to the greatest remaining values.
    """
    payload = F.struct(*[F.col(c) for c in columns])
    rank = F.struct(F.col(version), payload)
    newest = F.max_by(payload, rank)
    return df.groupBy(*keys).agg(newest.alias("_row")).select(*keys, "_row.*")


# Bits of the significand that each level of refinement adds to a value's bucket; 52 bits make buckets exact.
_LEVEL_BITS = (10, 11, 11, 11, 9)
# Targets joined to the rows by a broadcast up to this many; more go by a shuffled join.
_BROADCAST_TARGETS = 1 << 20


def _ordered_parts(v: Column) -> tuple[Column, Column, Column]:
    """Sign, binary exponent and 52-bit significand of a double, so that (sign, sign * exponent, sign * significand)
    sorts like the value. Zero is sign 0; infinities and NaN take exponents beyond every finite one."""
    a = F.abs(v)
    guess = F.floor(F.log2(a))
    exp = guess - (a < F.pow(F.lit(2.0), guess)).cast("int") + (a >= F.pow(F.lit(2.0), guess + 1)).cast("int")
    finite = ~F.isnan(v) & (a != F.lit(float("inf")))
    sign = F.when(F.isnan(v) | (v > 0), 1).when(v < 0, -1).otherwise(0)
    # Infinity sorts past every finite exponent (at most 1023) of its sign, NaN past positive infinity.
    exp = F.when(F.isnan(v), F.lit(8192)).when(~finite, F.lit(4096)).when(sign == 0, F.lit(0)).otherwise(exp.cast("long"))
    frac = F.when(finite & (sign != 0), ((a / F.pow(F.lit(2.0), exp)) - 1) * F.lit(float(1 << 52))).otherwise(F.lit(0.0))
    return sign, exp, frac.cast("long")


def _bucket(sign: Column, exp: Column, frac: Column, level: int) -> Column:
    """Bucket of a value at a level: its order among values, cut to the significand bits of all levels up to it."""
    kept = sum(_LEVEL_BITS[: level + 1])
    top = F.shiftright(frac, 52 - kept)
    if level == 0:
        return sign * ((exp + 2048) * F.lit(1 << kept) + top)
    return sign * top


def percentiles(df: DataFrame, keys: list[str], spec: dict[str, tuple[str, float]]) -> DataFrame:
    """Exact interpolated percentiles (p of (n - 1) between ranks) of several columns per key, in one pass.

    `spec` maps each output column to (value column, p). Per key and column, values are counted by bucket
    (sign, exponent and the leading bits of the significand), with the least and greatest value of each
    bucket. Prefix sums over the bucket totals find the bucket that holds each target rank. A bucket whose
    least and greatest value agree gives the value; only the other buckets that hold a rank are refined, by
    more bits of the significand over just their rows, until they do (at the last level a bucket is one value).
    No task sees more than one key's bucket totals, and no row of a group is gathered anywhere.

    Nulls in a column are left out of that column; a key without values has null percentiles. Returns one row
    per key that has a row (one row without keys).
    """
    columns = sorted({c for c, _ in spec.values()})
    stacked = df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("v")) for c in columns])).alias("_s"))
    rows = stacked.select(*keys, "_s.col", "_s.v").where(F.col("v").isNotNull())
    sign, exp, frac = _ordered_parts(F.col("v"))
    rows = rows.select(*keys, "col", "v", sign.alias("_sign"), exp.alias("_exp"), frac.alias("_frac"))
    group = [*keys, "col"]
    point_rows = [(name, c, float(p)) for name, (c, p) in spec.items()]
    points = df.sparkSession.createDataFrame(point_rows, "name string, col string, p double")

    # Level 0: every value of every column.
    level = 0
    code = _bucket(F.col("_sign"), F.col("_exp"), F.col("_frac"), 0)
    totals = rows.groupBy(*group, code.alias("_b")).agg(
        F.count(F.lit(1)).alias("_c"), F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    spans = totals.select(
        *group, "_b", "_c", "_lo", "_hi", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_from"),
        F.sum("_c").over(Window.partitionBy(*group)).alias("_n"))
    # Two ranks per point: below and above p of (n - 1).
    wanted = spans.select(*group, "_n").distinct().join(F.broadcast(points), "col").select(
        *group, "name", "_n", (F.col("p") * (F.col("_n") - 1)).alias("_t"))
    ranks = wanted.select(*group, "name", "_t", F.explode(F.array(
        F.struct(F.lit("low").alias("end"), F.floor("_t").alias("rank")),
        F.struct(F.lit("high").alias("end"), F.ceil("_t").alias("rank")))).alias("_r")).select(
        *group, "name", "_t", "_r.end", "_r.rank")
    found = ranks.join(spans, group).where((F.col("_from") <= F.col("rank")) & (F.col("rank") < F.col("_from") + F.col("_c")))
    found = found.select(*group, "name", "_t", "end", (F.col("rank") - F.col("_from")).alias("rank"), F.array("_b").alias("_path"), "_lo", "_hi")
    resolved = [found.where(F.col("_lo") == F.col("_hi")).select(*group, "name", "_t", "end", F.col("_lo").alias("value"))]
    open_ = found.where(F.col("_lo") != F.col("_hi")).select(*group, "name", "_t", "end", "rank", "_path")
    codes = [_bucket(F.col("_sign"), F.col("_exp"), F.col("_frac"), lv) for lv in range(len(_LEVEL_BITS))]
    while level + 1 < len(_LEVEL_BITS) and not open_.isEmpty():
        level += 1
        open_ = _stored(open_)
        # Only rows of the buckets that still hold a rank, refined by the next bits of the significand.
        buckets = open_.select(*group, "_path").distinct()
        hint = F.broadcast if buckets.count() <= _BROADCAST_TARGETS else (lambda d: d)
        mine = rows.select(*group, "v", F.array(*codes[:level]).alias("_path"), codes[level].alias("_b")).join(
            hint(buckets), [*group, "_path"], "left_semi")
        totals = mine.groupBy(*group, "_path", "_b").agg(F.count(F.lit(1)).alias("_c"), F.min("v").alias("_lo"), F.max("v").alias("_hi"))
        before = Window.partitionBy(*group, "_path").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        spans = totals.withColumn("_from", F.coalesce(F.sum("_c").over(before), F.lit(0)))
        found = open_.join(spans, [*group, "_path"]).where((F.col("_from") <= F.col("rank")) & (F.col("rank") < F.col("_from") + F.col("_c")))
        found = found.select(*group, "name", "_t", "end", (F.col("rank") - F.col("_from")).alias("rank"),
                             F.concat("_path", F.array("_b")).alias("_path"), "_lo", "_hi")
        resolved.append(found.where(F.col("_lo") == F.col("_hi")).select(*group, "name", "_t", "end", F.col("_lo").alias("value")))
        open_ = found.where(F.col("_lo") != F.col("_hi")).select(*group, "name", "_t", "end", "rank", "_path")
    values = union_all(resolved).groupBy(*group, "name").agg(
        F.max(F.when(F.col("end") == "low", F.col("value"))).alias("_low"), F.max(F.when(F.col("end") == "high", F.col("value"))).alias("_high"),
        F.max(F.col("_t") - F.floor("_t")).alias("_frac"))
    between = F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_frac")
    values = values.select(*keys, "name", F.when((F.col("_frac") == 0) | (F.col("_low") == F.col("_high")), F.col("_low")).otherwise(between).alias("value"))
    wide = [F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in spec]
    if not keys:
        return values.agg(*wide)
    present = df.select(*keys).distinct()
    return present.join(values.groupBy(*keys).agg(*wide), keys, "left")


def _stored(df: DataFrame) -> DataFrame:
    """Rank targets between refinement levels, written once to the shared work folder and read back."""
    from tallyspark.sinks.files import stored

    return stored(df, "percentile-targets")


def exact_percentiles(df: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Exact interpolated percentiles of one column per key; see `percentiles`."""
    return percentiles(df, keys, {name: (value, p) for name, p in points.items()})
