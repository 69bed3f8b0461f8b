"""Synthetic points, the same for the same seed."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOBS = ((39.9, 116.3), (40.0, 116.5), (39.8, 116.4))


def uniform(spark: SparkSession, n: int, low: float = 39.0, high: float = 41.0, seed: int = 42) -> DataFrame:
    side = lambda k: F.lit(low) + F.rand(seed + k) * (high - low)
    return spark.range(n).select(F.col("id").alias("pt_id"), side(0).alias("lat"), side(1).alias("lon"))


def blobs(spark: SparkSession, n: int, sigma: float = 0.01, noise: float = 0.1, seed: int = 42, centres: tuple = BLOBS) -> DataFrame:
    """n points around the centres, in random shares, and noise * n more spread over [39.7, 40.1] x [116.2, 116.7]."""
    import random

    draw = random.Random(seed)
    shares = [-math.log(1 - draw.random()) for _ in centres]  # a flat Dirichlet draw
    cuts = [sum(shares[: k + 1]) / sum(shares) * n for k in range(len(centres))]
    extra = int(n * noise)
    which = F.lit(len(centres))
    for k in reversed(range(len(centres))):
        which = F.when(F.col("id") < cuts[k], k).otherwise(which)
    rows = spark.range(n + extra).withColumn("blob", F.when(F.col("id") >= n, -1).otherwise(which))
    centre = lambda axis: F.element_at(F.array(*[F.lit(c[axis]) for c in centres]), F.least(F.col("blob") + 1, F.lit(len(centres))))
    spread = lambda k, low, high: F.lit(low) + F.rand(seed + k) * (high - low)
    lat = F.when(F.col("blob") < 0, spread(3, 39.7, 40.1)).otherwise(centre(0) + F.randn(seed + 1) * sigma)
    lon = F.when(F.col("blob") < 0, spread(4, 116.2, 116.7)).otherwise(centre(1) + F.randn(seed + 2) * sigma)
    return rows.select(F.col("id").alias("pt_id"), lat.alias("lat"), lon.alias("lon"), (F.col("blob") + 1).alias("label"))
