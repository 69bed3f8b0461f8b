"""Exploratory summaries of points."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import REGION, in_region


def missing_profile(df: DataFrame) -> DataFrame:
    """column_name, n_missing, pct_missing, in one pass."""
    n = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull() | (F.isnan(c) if t in ("double", "float") else F.lit(False))).alias(c) for c, t in df.dtypes])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_missing")) for c in df.columns]))
    return n.select("_n", each.alias("x")).select("x.column_name", "x.n_missing", F.when(F.col("_n") > 0, F.round(F.col("x.n_missing") / F.col("_n") * 100, 2)).otherwise(0.0).alias("pct_missing"))


def duplicate_count(df: DataFrame) -> DataFrame:
    """One row: rows that equal an earlier row."""
    return df.groupBy(*df.columns).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.count_distinct(c).alias(f"n_{c}") for c in columns])


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, n, mean, std, min, q25, q50, q75, max, with exact quartiles."""
    stats = lambda c: F.struct(
        F.lit(c).alias("column_name"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"),
        F.percentile(c, 0.25).alias("q25"), F.percentile(c, 0.5).alias("q50"), F.percentile(c, 0.75).alias("q75"), F.max(c).alias("max"),
    )
    return df.agg(*[stats(c).alias(f"s{i}") for i, c in enumerate(columns)]).select(F.explode(F.array(*[F.col(f"s{i}") for i in range(len(columns))])).alias("s")).select("s.*")


PARTS = {"hour": F.hour, "weekday": F.weekday, "day": F.dayofmonth, "month": F.month}


def counts_by(points: DataFrame, part: str) -> DataFrame:
    """Points by hour, weekday (Monday 0), day of the month or month."""
    return points.groupBy(PARTS[part]("ts").alias(part)).agg(F.count("*").alias("n")).orderBy(part)


def taxi_activity(points: DataFrame, key: str = "taxi_id") -> DataFrame:
    return points.groupBy(key).agg(
        F.count("*").alias("n_points"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        F.round(F.avg("lat"), 4).alias("mean_lat"), F.round(F.stddev_samp("lat"), 4).alias("std_lat"), F.round(F.avg("lon"), 4).alias("mean_lon"), F.round(F.stddev_samp("lon"), 4).alias("std_lon"),
    )


def histogram(values: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """bin (from 0), low, high, n over equal bins, the last closed; empty bins have rows too."""
    e = values.agg(F.min(column).alias("a"), F.max(column).alias("b")).first()
    if e["a"] is None:
        return values.sparkSession.createDataFrame([], "bin int, low double, high double, n long")
    a, b = float(e["a"]), float(e["b"])
    if a == b:
        a, b = a - 0.5, b + 0.5
    width = (b - a) / bins
    k = F.least(F.floor((F.col(column) - F.lit(a)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    n = values.filter(F.col(column).isNotNull()).groupBy(k.alias("bin")).agg(F.count("*").alias("n"))
    frame = values.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), (F.lit(a) + F.col("id") * width).alias("low"), (F.lit(a) + (F.col("id") + 1) * width).alias("high"))
    return frame.join(F.broadcast(n), "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"))


def pareto(activity: DataFrame, key: str = "taxi_id", levels: tuple = (20, 50, 80)) -> DataFrame:
    """level, n_taxis, pct_taxis: how many of the busiest reach each share of all points.

    The order is by count; equal counts by key. Counts of counts come first, so what one
    task orders are the distinct counts, not the taxis.
    """
    grouped = activity.groupBy("n_points").agg(F.count("*").alias("k"))
    w = W.orderBy(F.col("n_points").desc())
    whole = W.partitionBy()
    run = grouped.select(
        "n_points", "k",
        (F.sum("k").over(w) - F.col("k")).alias("before"), (F.sum(F.col("n_points") * F.col("k")).over(w) - F.col("n_points") * F.col("k")).alias("sum_before"),
        F.sum("k").over(whole).alias("taxis"), F.sum(F.col("n_points") * F.col("k")).over(whole).alias("total"),
    )
    level = F.explode(F.array(*[F.lit(x) for x in levels])).alias("level")
    r = run.select("*", level)
    need = F.ceil((F.col("level") * F.col("total") / 100 - F.col("sum_before")) / F.col("n_points"))
    first = r.withColumn("need", F.greatest(need, F.lit(1))).filter(F.col("need") <= F.col("k"))
    return first.groupBy("level").agg(F.min(F.col("before") + F.col("need")).alias("n_taxis"), F.first("taxis").alias("taxis")).select("level", "n_taxis", F.round(F.col("n_taxis") / F.col("taxis") * 100, 4).alias("pct_taxis"))


def pareto_share(activity: DataFrame, key: str = "taxi_id") -> DataFrame:
    """taxi, n_points, rank, cumulative share in percent, busiest first."""
    w = W.orderBy(F.col("n_points").desc(), key)
    total = F.sum("n_points").over(W.partitionBy())
    return activity.select(key, "n_points", F.row_number().over(w).alias("rank"), (F.sum("n_points").over(w.rowsBetween(W.unboundedPreceding, 0)) / total * 100).alias("cum_share"))


def in_bounds_share(points: DataFrame, region: dict = REGION) -> DataFrame:
    inside = in_region(F.col("lat"), F.col("lon"), region)
    n = points.agg(F.count("*").alias("n_points"), F.count_if(inside).alias("n_inside"))
    return n.select("n_points", "n_inside", (F.col("n_points") - F.col("n_inside")).alias("n_outside"), F.when(F.col("n_points") > 0, F.col("n_inside") / F.col("n_points") * 100).otherwise(0.0).alias("pct_inside"))


def hexbin(points: DataFrame, gridsize: int = 30, bounds: dict | None = None) -> DataFrame:
    """cx, cy, lattice, n: counts in hexagons over x = lon, y = lat.

    Two rectangular lattices, one shifted by half a cell; a point belongs to the nearer
    centre, distances taken with y scaled by sqrt 3 (the usual hexagonal binning).
    """
    e = bounds or points.agg(F.min("lon").alias("x0"), F.max("lon").alias("x1"), F.min("lat").alias("y0"), F.max("lat").alias("y1")).first().asDict()
    if e["x0"] is None:
        return points.sparkSession.createDataFrame([], "cx double, cy double, lattice int, n long")
    nx, ny = gridsize, int(gridsize / math.sqrt(3))
    sx, sy = ((e["x1"] - e["x0"]) or 1.0) / nx, ((e["y1"] - e["y0"]) or 1.0) / ny
    x, y = (F.col("lon") - F.lit(e["x0"])) / F.lit(sx), (F.col("lat") - F.lit(e["y0"])) / F.lit(sy)
    near = lambda c: F.floor(c + 0.5)
    square = lambda c: c * c
    d1 = square(x - near(x)) + 3.0 * square(y - near(y))
    d2 = square(x - F.floor(x) - 0.5) + 3.0 * square(y - F.floor(y) - 0.5)
    first = d1 < d2
    kx = F.when(first, near(x).cast("double")).otherwise(F.floor(x) + 0.5)
    ky = F.when(first, near(y).cast("double")).otherwise(F.floor(y) + 0.5)
    n = points.select(kx.alias("kx"), ky.alias("ky"), F.when(first, 0).otherwise(1).alias("lattice")).groupBy("kx", "ky", "lattice").agg(F.count("*").alias("n"))
    return n.select((F.lit(e["x0"]) + F.col("kx") * sx).alias("cx"), (F.lit(e["y0"]) + F.col("ky") * sy).alias("cy"), "lattice", "n")


def area_density(points: DataFrame) -> DataFrame:
    """Area of the bounding box in square degrees, and points in one."""
    e = points.agg(F.count("*").alias("n_points"), ((F.max("lat") - F.min("lat")) * (F.max("lon") - F.min("lon"))).alias("area_deg2"))
    return e.withColumn("points_per_deg2", F.when(F.col("area_deg2") > 0, F.col("n_points") / F.col("area_deg2")).otherwise(0.0))


def dataset_summary(points: DataFrame, stats: DataFrame) -> DataFrame:
    """One row: points, taxis, time span, mean trajectory length, duration and distance."""
    p = points.agg(F.count("*").alias("n_points"), F.count_distinct("taxi_id").alias("n_taxis"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    t = stats.agg(F.avg("n_points").alias("mean_points"), F.avg("duration_hours").alias("mean_hours"), F.avg("total_distance_km").alias("mean_km"))
    return p.crossJoin(t)  # one row each


def spatial_summary(points: DataFrame, attribute: str | None = None) -> DataFrame:
    """One row for a map: points, taxis, centre, bounds, and the range of an attribute."""
    out = [F.count("*").alias("n_points"), F.count_distinct("taxi_id").alias("n_taxis"), F.avg("lat").alias("center_lat"), F.avg("lon").alias("center_lon")]
    out += [f(c).alias(f"{n}_{c}") for c in ("lat", "lon", *([attribute] if attribute else [])) for n, f in (("min", F.min), ("max", F.max))]
    return points.agg(*out)


def data_quality(points: DataFrame, columns: list[str], kept: DataFrame) -> DataFrame:
    """column, least, most, missing_pct by column, and the share of rows that cleaning kept (``kept``)."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("e")
    n = points.select(each).groupBy("e.column").agg(F.min("e.x").alias("least"), F.max("e.x").alias("most"), (F.count_if(F.col("e.x").isNull()) / F.count("*") * 100).alias("missing_pct"), F.count("*").alias("n"))
    share_kept = kept.agg(F.count("*").alias("k"))
    return n.crossJoin(share_kept).select("column", "least", "most", "missing_pct", (F.col("k") / F.col("n") * 100).alias("retention_pct"))  # one row joined to few


def chunk_ranges(n: int, chunk: int, spark) -> DataFrame:
    """start, stop of fixed-size index ranges."""
    return spark.range(0, max(0, -(-n // chunk))).select((F.col("id") * chunk).alias("start"), F.least((F.col("id") + 1) * chunk, F.lit(n)).alias("stop"))


def in_chunks(points: DataFrame, chunk: int) -> DataFrame:
    return points.withColumn("chunk", F.floor(F.col("pt_id") / chunk))


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)
