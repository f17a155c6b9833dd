"""Readers for exports and lake planes. Missing data reads as a typed empty frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType, ByteType, DataType, DoubleType, IntegerType, LongType, ShortType, StringType, StructField, StructType, TimestampType)

from tallyspark import schemas
from tallyspark.sinks.files import Folder, complete_swap


def scan_bill_export(
    spark: SparkSession, paths: list[str], start: str, end: str, services: list[str] | None = None
) -> DataFrame:
    """Export files united by name; window and service filters reach the Parquet scan."""
    rows = spark.read.option("mergeSchema", True).parquet(*paths)
    begin = F.col("ChargePeriodStart")
    out = rows.where((begin >= F.lit(start).cast("timestamp"))
                     & (begin < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp")))
    return out.where(F.col("ServiceName").isin(*services)) if services else out


def _period_overlaps(period: Column, start: str, end: str) -> Column:
    first = F.to_date(F.concat(period, F.lit("-01")))
    return (F.last_day(first) >= F.lit(start).cast("date")) & (first <= F.lit(end).cast("date"))


_FILE_KEYS = ("key", "url", "s3Key", "relativePath")


def resolve_manifest_files(
    manifests: DataFrame, bucket: str, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Current data-file URLs named by manifest documents.

    *manifests*: (path, document). Entries of `dataFiles` may be strings or objects under any
    known key; a manifest without them is searched for .parquet strings. A period 'YYYY-MM' in
    the manifest path outside the window is skipped.
    """
    doc = F.col("document")
    entries = F.from_json(F.get_json_object(doc, "$.dataFiles"), "array<string>")
    listed = F.transform(entries, lambda e: F.coalesce(
        *[F.nullif(F.get_json_object(e, f"$.{k}"), F.lit("")) for k in _FILE_KEYS],
        F.when(~F.ltrim(e).startswith("{"), e)))
    named = F.filter(listed, lambda v: v.isNotNull() & (v != ""))
    anywhere = F.regexp_extract_all(doc, F.lit(r'"([^"]*\.parquet)"'), F.lit(1))
    raw = F.when(F.size(F.coalesce(named, F.array())) > 0, named).otherwise(anywhere)
    folder = F.replace(F.regexp_extract("path", "(?s)^(.*)/[^/]*$", 1), F.lit("/metadata/"), F.lit("/data/"))
    rows = manifests
    if start and end:
        period = F.regexp_extract("path", r"(?:BILLING_PERIOD|billing_period)=(\d{4}-\d{2})", 1)
        rows = rows.where((period == "") | _period_overlaps(period, start, end))
    value = F.col("value")
    url = (F.when(value.startswith("s3://"), value)
           .when(value.contains("/"), F.concat(F.lit(f"s3://{bucket}/"), F.regexp_replace(value, "^/+", "")))
           .otherwise(F.concat(F.lit(f"s3://{bucket}/"), F.col("folder"), F.lit("/"), value)))
    return rows.select(folder.alias("folder"), F.explode(raw).alias("value")).select(url.alias("url")).distinct()


def scan_csv_chunks(spark: SparkSession, paths: list[str], columns: list[str], header: bool = False) -> DataFrame:
    """Staged CSV chunks with a known column list, every column text."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    return spark.read.schema(schema).csv(paths, header=header, multiLine=False)


def _has_data(spark: SparkSession, root: str) -> bool:
    folder = Folder(spark, root)
    if not folder.exists(root):
        return False
    status = folder._fs.listStatus(folder._path(root))
    return any(not s.getPath().getName().startswith(("_", ".")) for s in status)


def scan_plane(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """A lake plane in its fixed schema; columns older files lack read as NULL. A swap a crash interrupted is finished first."""
    complete_swap(spark, root)
    if not _has_data(spark, root):
        return schemas.empty(spark, schema)
    # A given schema needs no footer merge, and partition values keep their declared text type.
    return spark.read.schema(schema).parquet(root).select(*schema.names)


def scan_bronze_bill(spark: SparkSession, root: str) -> DataFrame:
    return scan_plane(spark, root, schemas.BILL)


def scan_driver_health(spark: SparkSession, root: str, legacy_root: str) -> DataFrame:
    """New partitions win: legacy rows count only for provider-months the new layout lacks."""
    primary = scan_plane(spark, root, schemas.DRIVER_HEALTH)
    legacy = scan_plane(spark, legacy_root, schemas.DRIVER_HEALTH)
    covered = primary.select("provider_name", "charge_month").distinct()
    return primary.unionByName(legacy.join(covered, ["provider_name", "charge_month"], "left_anti"))


_WIDTH = {"boolean": 0, "tinyint": 1, "smallint": 2, "int": 3, "bigint": 4, "float": 5, "double": 6}


def _wider(a: DataType, b: DataType) -> DataType:
    """The type that holds values of both: the wider number (decimals as doubles), else text."""
    names = [t.simpleString() for t in (a, b)]
    if names[0] == names[1]:
        return a
    numeric = [("double" if n.startswith("decimal") else n) for n in names]
    if all(n in _WIDTH for n in numeric):
        return DoubleType() if "double" in numeric or "float" in numeric else _parse(max(numeric, key=_WIDTH.get))
    if {"date", "timestamp"} >= set(names):
        return TimestampType()
    return StringType()


def _parse(name: str) -> DataType:
    return {"boolean": BooleanType(), "tinyint": ByteType(), "smallint": ShortType(), "int": IntegerType(), "bigint": LongType()}[name]


def scan_account_usage(spark: SparkSession, root: str, table: str, flat_root: str | None = None) -> DataFrame | None:
    """One source view: lake partitions first, else a flat file, else None; lower-case names, no partition keys.

    Months written at different times may disagree on a column's type: each month is read in its own schema and
    every column is widened to a type that holds all of them (wider numbers, decimals as doubles, dates and times
    as times, anything else as text). Columns a month lacks read as NULL.
    """
    path = f"{root.rstrip('/')}/{table}"
    complete_swap(spark, path)
    if _has_data(spark, path):
        folder = Folder(spark, path)
        parts = [p for provider in folder.children(path) for p in (f"{path}/{provider}/{m}" for m in folder.children(f"{path}/{provider}"))]
        frames = [spark.read.parquet(p) for p in parts] or [spark.read.parquet(path)]
        if len(parts) > 1:
            frames = [f.toDF(*[c.lower() for c in f.columns]) for f in frames]
            widest: dict[str, DataType] = {}
            for frame in frames:
                for field in frame.schema.fields:
                    widest[field.name] = _wider(widest[field.name], field.dataType) if field.name in widest else field.dataType
            aligned = [f.select(*[(F.col(n) if n in f.columns else F.lit(None)).cast(t).alias(n) for n, t in widest.items()]) for f in frames]
            rows = aligned[0]
            for frame in aligned[1:]:
                rows = rows.unionByName(frame)
        else:
            rows = frames[0]
    elif flat_root and Folder(spark, flat_root).exists(f"{flat_root}/{table}.parquet"):
        rows = spark.read.parquet(f"{flat_root}/{table}.parquet")
    else:
        return None
    return rows.toDF(*[c.lower() for c in rows.columns]).drop("provider_name", "charge_month")


def scan_turn_log(spark: SparkSession, *roots: str) -> DataFrame:
    out = schemas.empty(spark, schemas.TURN_LOG)
    for root in roots:
        if _has_data(spark, root):
            rows = spark.read.option("mergeSchema", True).parquet(root)
            out = out.unionByName(schemas.conform(rows, schemas.TURN_LOG))
    return out


def scan_gold(spark: SparkSession, root: str, group: str, view: str) -> DataFrame:
    """One published relation, also visible to SQL as '<group>__<view>'."""
    complete_swap(spark, root)
    rows = spark.read.parquet(f"{root.rstrip('/')}/{group}/{view}")
    rows.createOrReplaceTempView(f"{group}__{view}")
    return rows
