"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import stored


def star_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every end of the edges (u, v): label is the smallest node of its component.

    Alternates two steps until nothing changes: each node hands its larger neighbours to its smallest one, then
    its smaller neighbours and itself. Both only need the smallest neighbour, an aggregate that shrinks before
    the shuffle, so a node with very many neighbours is no burden; the number of steps grows with the logarithm of
    the size of a component.
    """
    now = stored(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = stored(
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        handed = large.join(least, "u")
        now = stored(
            handed.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "small-star")
        # Done when every node but the smallest of its component has one edge, to a node that has none upwards.
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("top")).unionByName(
            now.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("top")))
        counted = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.max("top").alias("top"))
        if counted.where("ups > 1 or ups = 1 and top = 1").isEmpty():
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
