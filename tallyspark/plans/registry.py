"""Named queries over the driver tables: one entry per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegralType

Query = Callable[[SparkSession, str], DataFrame]

# Doubles that come out of exact inputs by a fixed formula are left as they are.
EXACT = -1

QUERIES: dict[str, Query] = {}


def query(name: str, round_to: dict[str, int] | int | None = None) -> Callable[[Query], Query]:
    """Register a query; its result is presented with plain double, bigint and text columns."""

    def wrap(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return present(fn(spark, sf_dir), round_to)

        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        return fn

    return wrap


def present(df: DataFrame, round_to: dict[str, int] | int | None = None) -> DataFrame:
    """Decimals as doubles, integers as bigint, doubles rounded so sum order does not show."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, DecimalType):
            c = c.cast("double")
        elif isinstance(field.dataType, IntegralType):
            c = c.cast("bigint")
        elif field.dataType.typeName() == "double" and round_to != EXACT:
            digits = round_to.get(field.name, 4) if isinstance(round_to, dict) else (4 if round_to is None else round_to)
            c = F.round(c, digits)
        out.append(c.alias(field.name))
    return df.select(*out)
