"""Trajectories: runs, segments, statistics. Points carry taxi_id, ts, pt_id, lat, lon."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import bearing_deg, haversine_m
from ..functions.time import elapsed_s, micros


def in_time(key: str = "taxi_id"):
    """Points of a trajectory in time, ties by pt_id."""
    return W.partitionBy(key).orderBy("ts", "pt_id")


def run_split(points: DataFrame, order: list[str], within: list[str] | None = None) -> DataFrame:
    """``run_id`` from 0: a new run whenever taxi_id differs from the previous row's.

    Rows are ordered by ``order`` within ``within`` (a file); runs are not a grouping by taxi.
    """
    w = W.partitionBy(*(within or [F.lit(0)])).orderBy(*order)
    turned = F.when(F.col("taxi_id").eqNullSafe(F.lag("taxi_id").over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return points.withColumn("_new", turned).withColumn("run_id", (F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)) - 1).cast("long")).drop("_new")


def movement_features(points: DataFrame, key: str = "taxi_id") -> DataFrame:
    """Distance, time, speed, bearing and acceleration from the previous point.

    First point: speed, direction and acceleration 0, the rest null; the second point's
    acceleration is 0; a step of no or negative time counts as one second. Trajectories of
    one point keep nulls.
    """
    w = in_time(key)
    lat, lon = F.lag("lat").over(w), F.lag("lon").over(w)
    dt = elapsed_s(F.lag("ts").over(w), F.col("ts"))
    step = points.select(
        "*",
        F.row_number().over(w).alias("rn"),
        F.count("*").over(W.partitionBy(key)).alias("_n"),
        haversine_m(lat, lon, F.col("lat"), F.col("lon")).alias("distance_from_prev"),
        F.when(dt <= 0, 1.0).otherwise(dt).alias("time_from_prev"),
        bearing_deg(lat, lon, F.col("lat"), F.col("lon")).alias("_bearing"),
    )
    v = F.col("distance_from_prev") / F.col("time_from_prev")
    first = (F.col("rn") == 1) & (F.col("_n") > 1)
    moved = step.withColumn("speed", F.when(first, 0.0).otherwise(v)).withColumn("speed_kmh", v * 3.6).withColumn("direction", F.when(first, 0.0).otherwise(F.col("_bearing")))
    gain = (F.col("speed") - F.lag("speed").over(w)) / F.col("time_from_prev")
    return moved.withColumn("acceleration", F.when((F.col("rn") <= 2) & (F.col("_n") > 1), 0.0).otherwise(gain)).drop("_n", "_bearing")


def segments(points: DataFrame, max_gap_minutes: float = 30, key: str = "taxi_id") -> DataFrame:
    """Points of segments: cut where the gap is over the limit; single points are dropped.

    segment_id is ``{taxi}_segment_{k}``, k counting the kept segments of a trajectory from 0.
    """
    w = in_time(key)
    gap = micros(F.col("ts")) - F.lag(micros(F.col("ts"))).over(w)
    cut = points.withColumn("_cut", F.when(gap > int(max_gap_minutes * 60e6), 1).otherwise(0))
    cut = cut.withColumn("_seg", F.sum("_cut").over(w.rowsBetween(W.unboundedPreceding, 0)))
    kept = cut.withColumn("_n", F.count("*").over(W.partitionBy(key, "_seg"))).filter("_n > 1")
    k = F.dense_rank().over(W.partitionBy(key).orderBy("_seg")) - 1
    return kept.withColumn("segment_id", F.concat(F.col(key).cast("string"), F.lit("_segment_"), k.cast("string"))).drop("_cut", "_seg", "_n")


def segment_stats(segmented: DataFrame) -> DataFrame:
    """Points, length, duration, start and end of each segment."""
    w = W.partitionBy("segment_id").orderBy("ts", "pt_id")
    d = haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    return (
        segmented.withColumn("_d", d)
        .groupBy("taxi_id", "segment_id")
        .agg(F.count("*").alias("n_points"), F.sum("_d").alias("length_m"), F.min("ts").alias("start_time"), F.max("ts").alias("end_time"))
        .withColumn("duration_s", elapsed_s(F.col("start_time"), F.col("end_time")))
    )


def trajectory_stats(featured: DataFrame, key: str = "taxi_id") -> DataFrame:
    """Totals of each trajectory with movement features; means and maxima leave out the first point; 0 where undefined."""
    later = F.when(F.col("rn") > 1, F.col("speed"))
    return (
        featured.groupBy(key)
        .agg(
            F.count("*").alias("n_points"),
            F.min("ts").alias("start_time"),
            F.max("ts").alias("end_time"),
            F.coalesce(F.sum("distance_from_prev"), F.lit(0.0)).alias("total_distance_m"),
            F.coalesce(F.avg(later), F.lit(0.0)).alias("avg_speed"),
            F.coalesce(F.max(later), F.lit(0.0)).alias("max_speed"),
        )
        .withColumn("duration_s", elapsed_s(F.col("start_time"), F.col("end_time")))
        .withColumn("total_distance_km", F.col("total_distance_m") / 1000)
        .withColumn("duration_hours", F.col("duration_s") / 3600)
        .withColumn("avg_speed_kmh", F.col("avg_speed") * 3.6)
        .withColumn("max_speed_kmh", F.col("max_speed") * 3.6)
        .withColumn("point_density_per_km", F.when(F.col("total_distance_m") > 0, F.col("n_points") / (F.col("total_distance_m") / 1000)).otherwise(0.0))
        .withColumn("sampling_rate_per_hour", F.when(F.col("duration_s") > 0, F.col("n_points") / (F.col("duration_s") / 3600)).otherwise(0.0))
    )


def is_valid(stats: DataFrame, min_points: int = 5, min_distance_km: float = 0.1) -> DataFrame:
    return stats.withColumn("is_valid", (F.col("n_points") >= min_points) & (F.col("total_distance_km") >= min_distance_km))


def bbox_centroid(points: DataFrame, key: str = "taxi_id") -> DataFrame:
    return points.groupBy(key).agg(F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"), F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"), F.avg("lat").alias("centroid_lat"), F.avg("lon").alias("centroid_lon"))


def as_points(points: DataFrame, key: str = "taxi_id") -> DataFrame:
    """One row a trajectory: its points in order as an array of structs (for the edge of the API only)."""
    cols = [c for c in points.columns if c not in (key, "ts", "pt_id")]
    return points.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ts", "pt_id", *cols))).alias("points"))
