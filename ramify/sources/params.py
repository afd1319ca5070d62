"""Parameter rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rng


def drawn(ids: DataFrame, seed: int = 0, d_mean: float = 20.0, d_std: float = 5.0) -> DataFrame:
    """One parameter row per network_id: epsilon U(4, 10), randmarg U(2, 4), d0 N(d_mean, d_std), n in 6..14."""
    draw = lambda name: rng.uniform(F.lit(seed), F.col("network_id"), F.lit("params"), name)
    return ids.select(
        F.col("network_id").cast("long").alias("network_id"),
        F.lit(seed).cast("long").alias("seed"),
        rng.integer(draw("n"), 6, 14).alias("n"),
        (F.lit(d_mean) + F.lit(d_std) * rng.normal(draw("d0a"), draw("d0b"))).alias("d0"),
        F.lit(3).alias("k"),
        rng.between(draw("epsilon"), 4.0, 10.0).alias("epsilon"),
        rng.between(draw("randmarg"), 2.0, 4.0).alias("randmarg"),
        F.lit(5).alias("sigma"),
        F.lit(True).alias("stochparams"),
    )


def generated(spark: SparkSession, networks: int = 5, seed: int = 0) -> DataFrame:
    """Parameters of networks numbered from 0."""
    return drawn(spark.range(networks).withColumnRenamed("id", "network_id"), seed)
