"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _apart(least: DataFrame) -> DataFrame:
    """least, dealt by something else than its key: a join by the key then shuffles both of its sides, and Spark can split
    the one with a hub's many edges."""
    return least.repartition(F.xxhash64("w"))


def _starred(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (u, v), u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")).select("w", F.least("w", "m").alias("m"))
    large = both.join(_apart(least), F.col("u") == F.col("w")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
    large = checkpointed(large)
    least = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
    small = large.join(_apart(least), F.col("u") == F.col("w"))
    return small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """id and component (its smallest id) of every id that edges (a, b) name. Ids are not null.

    Each step keeps the edges' number in bounds and none gathers a component in one task; the number of
    steps grows with the logarithm of the components' diameters.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    now, mark = checkpointed(now), None
    while True:
        sums = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (sums["n"], sums["h"]) == mark or not sums["n"]:
            break
        mark = (sums["n"], sums["h"])
        now = checkpointed(_starred(now))
    # Stars: every id points at its component's smallest.
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
