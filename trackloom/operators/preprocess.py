"""Cleaning, outliers, resampling and the pipeline that joins them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import REGION, in_region, known
from ..functions.time import micros
from ..work import materialise
from .trajectory import in_time, movement_features, trajectory_stats


@dataclass(frozen=True)
class Preprocessing:
    min_length: int = 10
    max_speed_kmh: float = 200.0
    max_acceleration: float = 10.0
    interval_s: int = 60
    remove_outliers: bool = True
    region: dict = field(default_factory=lambda: dict(REGION))
    years: tuple = (2000, 2030)


def remove_invalid(points: DataFrame, region: dict = REGION, years: tuple = (2000, 2030)) -> DataFrame:
    """Known coordinates inside the region, a time in the years (all inclusive)."""
    return points.filter(in_region(F.col("lat"), F.col("lon"), region) & F.col("ts").isNotNull() & F.year("ts").between(*years))


def clean(points: DataFrame, region: dict = REGION) -> DataFrame:
    """Rows with coordinates and time, whole duplicates once, inside the region."""
    there = points.filter(known(F.col("lat")) & known(F.col("lon")) & F.col("ts").isNotNull() & in_region(F.col("lat"), F.col("lon"), region))
    return there.dropDuplicates()


def long_enough(points: DataFrame, least: int, key: str = "taxi_id") -> DataFrame:
    return points.withColumn("_n", F.count("*").over(W.partitionBy(key))).filter(F.col("_n") >= least).drop("_n")


def filter_outliers(featured: DataFrame, max_speed_kmh: float = 200.0, max_acceleration: float = 10.0, key: str = "taxi_id") -> DataFrame:
    """Drop points strictly over the limits; first points and trajectories under three points stay as they are."""
    short = F.count("*").over(W.partitionBy(key)) < 3
    kept = featured.withColumn("_short", short)
    fast = (F.col("speed_kmh") > max_speed_kmh) | (F.abs("acceleration") > max_acceleration)
    return kept.filter(F.col("_short") | (F.col("rn") == 1) | ~F.coalesce(fast, F.lit(False))).drop("_short")


def resample(points: DataFrame, interval_s: int = 60, key: str = "taxi_id", carry: tuple = ("lat", "lon", "speed", "direction")) -> DataFrame:
    """Points at a regular grid of times from first to last, each the nearest original; ties: the earlier.

    Trajectories under two points stay. An as-of join by windows: ticks and points in one
    order, the last point before and the first after each tick.
    """
    # read four times below, so written once
    us = materialise(points.select(key, "pt_id", "ts", *carry, micros(F.col("ts")).alias("_us")), "resample")
    ends = us.groupBy(key).agg(F.min("_us").alias("_a"), F.max("_us").alias("_b"), F.count("*").alias("_n"))
    step = int(interval_s * 1_000_000)
    # ticks in two steps, so that no array grows long with a trajectory's time
    block = 4096 * step
    blocks = ends.filter("_n > 1").select(key, "_b", F.explode(F.sequence("_a", "_b", F.lit(block))).alias("_a"))
    ticks = blocks.select(key, F.explode(F.sequence("_a", F.least("_b", F.col("_a") + F.lit(block - step)), F.lit(step))).alias("_us"))
    payload = F.struct("_us", *carry)
    marked = us.join(ends.filter("_n > 1").select(key), key, "left_semi").select(key, "_us", F.lit(0).alias("_tick"), "pt_id", payload.alias("_p")).unionByName(ticks.select(key, "_us", F.lit(1).alias("_tick"), F.lit(None).cast("long").alias("pt_id")), allowMissingColumns=True)
    # points of one time: the first in order answers for all, so a tick takes it from either side
    order = ["_us", "_tick", "pt_id"]
    back = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(key).orderBy(F.col("_us"), F.col("_tick"), F.col("pt_id")).rowsBetween(0, W.unboundedFollowing)
    firsts = marked.withColumn("_rank", F.row_number().over(W.partitionBy(key, "_us", "_tick").orderBy("pt_id")))
    firsts = firsts.filter("_rank = 1")
    found = firsts.withColumn("_before", F.last("_p", ignorenulls=True).over(back)).withColumn("_after", F.first("_p", ignorenulls=True).over(ahead)).filter("_tick = 1")
    near = F.when(F.col("_after").isNull() | (F.col("_us") - F.col("_before._us") <= F.col("_after._us") - F.col("_us")), F.col("_before")).otherwise(F.col("_after"))
    grid = found.select(key, F.timestamp_micros("_us").cast("timestamp_ntz").alias("ts"), near.alias("p")).select(key, "ts", *[F.col(f"p.{c}").alias(c) for c in carry])
    alone = us.join(ends.filter("_n <= 1").select(key), key, "left_semi").select(key, "ts", *carry)
    return grid.unionByName(alone)


def preprocess(points: DataFrame, p: Preprocessing = Preprocessing(), key: str = "taxi_id") -> DataFrame:
    """Clean, drop short trajectories, add features, drop outliers, resample; short ones go after each step."""
    kept = long_enough(remove_invalid(points, p.region, p.years), p.min_length, key)
    featured = movement_features(kept, key)
    if p.remove_outliers:
        featured = long_enough(filter_outliers(featured, p.max_speed_kmh, p.max_acceleration, key), p.min_length, key)
    return long_enough(resample(featured, p.interval_s, key), p.min_length, key)


def preprocess_stats(points: DataFrame, p: Preprocessing = Preprocessing(), key: str = "taxi_id") -> DataFrame:
    """Statistics of the resampled trajectories (speeds carried over, distance between grid points)."""
    from ..functions.geo import haversine_m

    grid = preprocess(points, p, key)
    w = W.partitionBy(key).orderBy("ts")
    d = haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    return trajectory_stats(grid.withColumn("rn", F.row_number().over(w)).withColumn("distance_from_prev", d), key)
