"""Idempotent Parquet sinks: a window, a key or a snapshot is replaced as a whole.

A new version is staged and checked completely before anything old is removed.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from tallyspark import schemas
from tallyspark.operators.frame import top_rows
from tallyspark.operators.mapping import assert_single_currency, dedupe_exact
from tallyspark.sinks.files import Folder, complete_swap, swap

BILL_KEYS = ["x_source_connector", "charge_month"]
# Hashes of repeated keys that a broadcast may hold: 8 MB of numbers.
MOST_REPEATS = 2**20


def months_between(start: str, end: str) -> list[str]:
    """'YYYY-MM' of every month touching the inclusive day range."""
    first, last = dt.date.fromisoformat(start), dt.date.fromisoformat(end)
    count = (last.year - first.year) * 12 + last.month - first.month
    base = first.year * 12 + first.month - 1
    return [f"{(base + i) // 12:04d}-{(base + i) % 12 + 1:02d}" for i in range(count + 1)]


def _stage(df: DataFrame, root: str, keys: list[str]) -> str:
    """Write partitioned data beside the table. Rebalancing splits a hot partition over tasks."""
    staging = f"{root.rstrip('/')}/_staging/{uuid.uuid4().hex}"
    df.hint("rebalance", *keys).write.partitionBy(*keys).option("compression", "zstd").parquet(staging)
    return staging


def _stage_bill(spark: SparkSession, folder: Folder, rows: DataFrame) -> str:
    """Write bill rows beside the table, one per dedupe key; whole rows move between tasks only where their key repeats.

    Every task writes its rows straight to their months, so *rows* is evaluated once. Only a hash per key is then shuffled
    to find the repeated ones. Without repeats the staged files are the result; otherwise they are written once more, where
    rows of a repeated hash meet by key and all others pass. More repeats than a broadcast may hold shuffle every row.
    """
    staging = f"{folder.root}/_staging/{uuid.uuid4().hex}"
    rows.write.partitionBy(*BILL_KEYS).option("compression", "zstd").parquet(staging)
    staged = spark.read.schema(rows.schema).parquet(staging)
    key = F.xxhash64("dedupe_key")
    found = staged.groupBy(key.alias("_key")).agg(F.count("*").alias("n")).where("n > 1").select("_key")
    found.write.parquet(f"{staging}/_repeated")
    repeated = spark.read.schema(found.schema).parquet(f"{staging}/_repeated")
    n = repeated.count()
    if n == 0:
        return staging
    if n > MOST_REPEATS:
        once = dedupe_exact(staged)
    else:
        # A hash is never null, so a row is either in or out of the repeated ones.
        keyed, names = staged.withColumn("_key", key), F.broadcast(repeated)
        once = keyed.join(names, "_key", "left_anti").unionByName(dedupe_exact(keyed.join(names, "_key", "left_semi"))).drop("_key")
    again = f"{folder.root}/_staging/{uuid.uuid4().hex}"
    once.write.partitionBy(*BILL_KEYS).option("compression", "zstd").parquet(again)
    folder.remove(staging)
    return again


def write_bill_window(
    spark: SparkSession, root: str, connector: str, start: str, end: str, rows: DataFrame,
    base_currency: str = "USD",
) -> None:
    """Replace every month of the window for one connector with *rows*.

    Months the source no longer reports disappear. A pull in a foreign currency is rejected with
    the old data intact. The swap is journaled: a failure while swapping is rolled forward by the next writer or
    reader of the root, so the window is never seen partial.
    """
    folder = Folder(spark, root)
    complete_swap(spark, root)
    months = months_between(start, end)
    scoped = rows.where((F.col("x_source_connector") == connector) & F.col("charge_month").isin(*months))
    staging = _stage_bill(spark, folder, scoped)
    target = f"{root.rstrip('/')}/x_source_connector={connector}"
    staged = f"{staging}/x_source_connector={connector}"
    fresh = folder.partitions(staged, "charge_month")
    try:
        if fresh:
            assert_single_currency(spark.read.parquet(staged), connector, base_currency)
    except Exception:
        folder.remove(staging)
        raise
    old = folder.partitions(target, "charge_month")
    moves = [(path, f"{target}/charge_month={month}") for month, path in fresh.items()]
    swap(folder, moves, [old[m] for m in months if m in old and m not in fresh], staging)


def _purge(folder: Folder, target: str, months: Iterable[str]) -> None:
    existing = folder.partitions(target, "charge_month")
    for month in months:
        if month in existing:
            folder.remove(existing[month])


def purge_connector(spark: SparkSession, root: str, connector: str) -> None:
    folder = Folder(spark, root)
    folder.remove(f"{folder.root}/x_source_connector={connector}")


def replace_partitions(df: DataFrame, root: str, keys: list[str]) -> None:
    """Replace exactly the partitions the rows belong to; others stay."""
    (df.hint("rebalance", *keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .option("compression", "zstd").partitionBy(*keys).parquet(root))


def _months_of(folder: Folder, keys: list[str], owners: list[tuple] | None, months: list[str]) -> dict[tuple, str]:
    """(owner names..., month) -> folder below the root, by the names that the folders stand for; of all owners without a list."""
    found = {(): folder.root}
    for depth, key in enumerate(keys):
        wanted = None if owners is None else {owner[: depth + 1] for owner in owners}
        found = {
            (*names, value): path
            for names, parent in found.items() for value, path in folder.values(parent, key).items()
            if (value in months if depth == len(keys) - 1 else wanted is None or (*names, value) in wanted)}
    return found


def write_efficiency(
    spark: SparkSession, root: str, rows: DataFrame, start: str, end: str,
    owners: list[tuple[str, str]] | None = None,
) -> None:
    """Replace (provider, connector, month) partitions of the window for the owners of this pull.

    Callers combine every source that shares a partition before writing it.
    """
    keys = ["provider_name", "x_source_connector", "charge_month"]
    _write_window(spark, root, rows, keys, start, end, owners)


def efficiency_plane(sources: dict[str, tuple[DataFrame, list[tuple[str, str]]]]) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Every efficiency source of one pull as one plane, and the (provider, connector) owners it replaces.

    Each source gives its rows and the owners it writes for. Rows are aligned to the efficiency schema (missing
    columns NULL) and unioned; the owners are the union of the declared ones. A row outside its source's owners
    is an error: written alone, it would replace a partition that another source fills. Several sources that
    share an owner and a month are thus written by one call and all survive.
    """
    frames, owners = [], set()
    for name, (rows, declared) in sources.items():
        aligned = rows.select(*[
            (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.EFFICIENCY.fields])
        allowed = {tuple(o) for o in declared}
        # Owner names of one source, not data: a handful of (provider, connector) pairs.
        found = {tuple(r) for r in aligned.select("provider_name", "x_source_connector").distinct().collect()}
        if not found <= allowed:
            raise ValueError(f"source {name} writes for owners it does not declare: {sorted(found - allowed, key=str)}")
        frames.append(aligned)
        owners |= allowed
    if not frames:
        raise ValueError("no efficiency source")
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out, sorted(owners, key=lambda o: tuple(x or "" for x in o))


def write_monthly_plane(
    spark: SparkSession, root: str, rows: DataFrame, start: str, end: str, owners: list[tuple[str]] | None = None
) -> None:
    """Driver health, AI usage and compute instances: replaced per provider and month in the window."""
    _write_window(spark, root, rows, ["provider_name", "charge_month"], start, end, owners)


def _write_window(spark, root, rows, keys, start, end, owners) -> None:
    complete_swap(spark, root)
    months = months_between(start, end)
    scoped = rows.where(F.col(keys[-1]).isin(*months))
    if owners is None:
        # Owner names (providers, connectors), not data.
        owners = [tuple(r) for r in scoped.select(*keys[:-1]).distinct().collect()]
    # Null and empty names share a folder.
    owners = [tuple(name or None for name in owner) for owner in owners]
    # Written once beside the table; then each month's folder takes the place of the old one, in one journaled swap.
    staging = _stage(scoped, root, keys)
    folder = Folder(spark, root)
    staged = Folder(spark, staging)
    old = _months_of(folder, keys, owners, months)
    fresh = _months_of(staged, keys, None, months)
    moves = [(path, folder.root + path.removeprefix(staged.root)) for path in fresh.values()]
    swap(folder, moves, [path for names, path in old.items() if names not in fresh], staging)


def repartition_legacy_metrics(spark: SparkSession, root: str, target: str) -> None:
    """Rewrite (provider, month) data with the connector as a partition level."""
    legacy = spark.read.option("mergeSchema", True).parquet(root)
    replace_partitions(legacy, target, ["provider_name", "x_source_connector", "charge_month"])


def write_snapshot(rows: DataFrame, root: str, keys: tuple[str, ...] = ("provider_name", "snapshot_month")) -> bool:
    """Replace the snapshots present in the pull; an empty pull keeps the last good one."""
    if rows.isEmpty():
        return False
    replace_partitions(rows, root, list(keys))
    return True


def write_table_observability(rows: DataFrame, root: str) -> None:
    """Replace only the (cluster, day) pairs of the pull."""
    replace_partitions(rows, root, ["cluster_id", "observation_date"])


def account_usage_frame(rows: DataFrame, date_column: str | None, snapshot_month: str) -> DataFrame:
    """Lower-case names, plain doubles for decimals, and the month each row belongs to."""
    out = []
    for field in rows.schema.fields:
        c = F.col(f"`{field.name}`")
        out.append((c.cast("double") if isinstance(field.dataType, DecimalType) else c).alias(field.name.lower()))
    month: Column = F.lit(snapshot_month)
    if date_column is not None:
        month = F.date_format(F.col(date_column.lower()), "yyyy-MM")
    return rows.select(*out).withColumn("charge_month", month)


def write_account_usage(
    tables: dict[str, DataFrame], root: str, date_columns: dict[str, str], snapshot_month: str, provider: str = "Snowflake"
) -> None:
    """Each source view under its own folder, replaced by month; views without dates are snapshots."""
    for name, rows in tables.items():
        frame = account_usage_frame(rows, date_columns.get(name), snapshot_month).withColumn("provider_name", F.lit(provider))
        dated = frame.where(F.col("charge_month").isNotNull())
        replace_partitions(dated, f"{root.rstrip('/')}/{name.lower()}", ["provider_name", "charge_month"])


# --- publication ------------------------------------------------------------------------------------
def provider_group(provider: Column) -> Column:
    """Folder-safe name of a provider."""
    return F.trim(F.regexp_replace(F.lower(provider), "[^a-z0-9]+", "_"), F.lit("_"))


def _one_name_per_group(rows: DataFrame) -> None:
    """Refuse providers whose names fold to the same folder: their rows would be merged silently."""
    names = rows.groupBy("provider_group").agg(F.collect_set("provider_name").alias("names"))
    clash = names.where((F.size("names") > 1) | (F.col("provider_group") == "")).first()
    if clash:
        raise ValueError(f"providers {sorted(clash['names'])} cannot share the group {clash['provider_group']!r}")


def discover_providers(bill: DataFrame) -> DataFrame:
    names = bill.where(F.coalesce("provider_name", F.lit("")) != "").select("provider_name").distinct()
    return names.orderBy("provider_name")


def publish_gold(
    spark: SparkSession, root: str, provider_views: dict[str, DataFrame], fixed_views: dict[str, dict[str, DataFrame]]
) -> list[str]:
    """Publish '<group>/<view>': provider views split by provider in one write each.

    Everything is staged first; then, in one journaled swap, each view takes its place and groups that are no
    longer produced are removed. A crash during the swap is rolled forward by the next publication or reader.
    """
    folder = Folder(spark, root)
    complete_swap(spark, root)
    staging = f"{folder.root}/_staging/{uuid.uuid4().hex}"
    produced: dict[str, str] = {}
    try:
        for name, view in provider_views.items():
            path = f"{staging}/by_provider/{name}"
            named = view.where(F.trim(F.coalesce("provider_name", F.lit(""))) != "")
            rows = named.withColumn("provider_group", provider_group(F.col("provider_name")))
            # Tasks write to their groups themselves; names are checked in what is staged, so a view is derived and moved once.
            rows.write.option("compression", "zstd").partitionBy("provider_group").parquet(path)
            staged = spark.read.schema(rows.select("provider_name").schema).parquet(path).select("provider_name")
            _one_name_per_group(staged.withColumn("provider_group", provider_group(F.col("provider_name"))))
            for group, part in folder.partitions(path, "provider_group").items():
                produced[f"{group}/{name}"] = part
        for group, views in fixed_views.items():
            for name, view in views.items():
                path = f"{staging}/fixed/{group}/{name}"
                view.write.option("compression", "zstd").parquet(path)
                produced[f"{group}/{name}"] = path
        live = {key.split("/")[0] for key in produced}
        removes = []
        for group in folder.children(folder.root):
            if group == "_staging":
                continue
            if group not in live:
                removes.append(f"{folder.root}/{group}")
                continue
            removes += [f"{folder.root}/{group}/{name}" for name in folder.children(f"{folder.root}/{group}")
                        if f"{group}/{name}" not in produced]
    except Exception:
        folder.remove(staging)
        raise
    swap(folder, [(path, f"{folder.root}/{key}") for key, path in produced.items()], removes, staging)
    return sorted(produced)


# --- run log -------------------------------------------------------------------------------------------
def append_runs(rows: DataFrame, root: str) -> None:
    rows.write.mode("append").option("compression", "zstd").parquet(root)


def run_history(runs: DataFrame, n: int | None = None) -> DataFrame:
    """Runs of every connector, the n newest if a number is given."""
    return top_rows(runs, n, F.col("finished_at").desc(), F.col("run_id"), F.col("connector"))


def run_groups(runs: DataFrame, n: int | None = None) -> DataFrame:
    """One row per run with its span, rows and worst status; the n newest if a number is given."""
    grouped = runs.groupBy("run_id").agg(
        F.min("started_at").alias("started_at"), F.max("finished_at").alias("finished_at"), F.sum("rows").alias("rows"),
        F.count("connector").alias("connectors"),
        F.when(F.bool_or(F.col("status") == "failed"), "failed").otherwise("success").alias("status"))
    return top_rows(grouped, n, F.col("finished_at").desc(), F.col("run_id"))
