"""Registered queries over the driver's tables, each with the same computation in DuckDB SQL.

The tables hold no positions, so trajectories are derived from ``events`` by integer
arithmetic that both engines do alike: three hot spots and a thin spread. Doubles are
rounded on both sides (degrees to 6 places, metres and speeds to 3).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import haversine_m
from ..functions.time import parse_timestamp
from ..operators import explore, merge, neighbors, partition, perf, preprocess, trajectory, tuning
from ..operators import dbscan as clustering
from . import sql

EPS, MIN_SAMPLES, EPS_M = sql.EPS, sql.MIN_SAMPLES, sql.EPS_M
REGION = {"min_lat": 39.75, "max_lat": 40.05, "min_lon": 116.25, "max_lon": 116.55}
PIPELINE = preprocess.Preprocessing(min_length=5, max_speed_kmh=60.0, max_acceleration=5.0, interval_s=3600)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pt_id, taxi_id, ts, lat, lon of every event."""
    k = F.col("event_id")
    unit = lambda a, b, m: ((k * a + b) % m).cast("double") / F.lit(float(m))
    a, b, c, d = unit(7919, 13, 10007), unit(104729, 7, 9973), unit(1299709, 3, 10009), unit(15485863, 11, 9967)
    g = (k * 31) % 10
    spot = lambda *v: F.when(g < 3, v[0]).when(g < 6, v[1]).when(g < 9, v[2]).otherwise(v[3])
    lat = spot(39.9, 40.0, 39.8, 39.7) + F.when(g < 9, (a + b - 1.0) * 0.02).otherwise(a * 0.4)
    lon = spot(116.3, 116.5, 116.4, 116.2) + F.when(g < 9, (c + d - 1.0) * 0.02).otherwise(c * 0.5)
    return table(spark, sf_dir, "events").select(k.alias("pt_id"), F.col("user_id").alias("taxi_id"), "ts", lat.alias("lat"), lon.alias("lon"))


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points with every 97th latitude missing and every 50th row twice."""
    p = points(spark, sf_dir).withColumn("lat", F.when(F.col("pt_id") % 97 == 0, None).otherwise(F.col("lat")))
    return p.unionAll(p.filter("pt_id % 50 = 0"))


def rounded(df: DataFrame, **places: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) + F.lit(0.0) for c, n in places.items()})  # no negative zero


QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _stats_cols(df: DataFrame) -> DataFrame:
    return rounded(df, total_distance_km=3, duration_hours=4, avg_speed_kmh=3, max_speed_kmh=3, point_density_per_km=3, sampling_rate_per_hour=3).select(
        "taxi_id", "n_points", "start_time", "end_time", "total_distance_km", "duration_hours", "avg_speed_kmh", "max_speed_kmh", "point_density_per_km", "sampling_rate_per_hour"
    )


def featured(spark, sf_dir) -> DataFrame:
    return trajectory.movement_features(points(spark, sf_dir))


def edges_of(spark, sf_dir) -> DataFrame:
    return neighbors.eps_edges(points(spark, sf_dir), EPS)


def labels_of(spark, sf_dir) -> DataFrame:
    return clustering.dbscan(points(spark, sf_dir), EPS, MIN_SAMPLES)


@query(sql.POINTS)
def points_derived(spark, sf_dir):
    return rounded(points(spark, sf_dir), lat=6, lon=6)


@query(sql.CLEAN_POINTS)
def clean_points(spark, sf_dir):
    return rounded(preprocess.remove_invalid(dirty(spark, sf_dir), REGION), lat=6, lon=6)


@query(sql.CLEAN_DEDUP)
def clean_dedup(spark, sf_dir):
    return rounded(preprocess.clean(dirty(spark, sf_dir), REGION), lat=6, lon=6)


@query(sql.TRAJECTORY_RUNS)
def trajectory_runs(spark, sf_dir):
    """Runs of equal event type along each user's events, as a file's rows."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("taxi_id"))
    return trajectory.run_split(e, ["ts", "event_id"], ["user_id"]).groupBy("user_id", "run_id", "taxi_id").agg(F.count("*").alias("n_points"))


@query(sql.MOVEMENT_FEATURES)
def movement_features(spark, sf_dir):
    f = rounded(featured(spark, sf_dir), distance_from_prev=3, time_from_prev=3, speed=3, speed_kmh=3, direction=3, acceleration=3)
    return f.select("pt_id", "taxi_id", "rn", "distance_from_prev", "time_from_prev", "speed", "speed_kmh", "direction", "acceleration")


@query(sql.OUTLIER_FILTER)
def outlier_filter(spark, sf_dir):
    return preprocess.filter_outliers(featured(spark, sf_dir), 60.0, 5.0).select("pt_id", "taxi_id", F.round("speed_kmh", 3).alias("speed_kmh"))


@query(sql.SEGMENTS)
def segments(spark, sf_dir):
    return trajectory.segments(points(spark, sf_dir), 360).select("pt_id", "taxi_id", "segment_id")


@query(sql.SEGMENT_STATS)
def segment_stats(spark, sf_dir):
    return rounded(trajectory.segment_stats(trajectory.segments(points(spark, sf_dir), 360)), length_m=3, duration_s=3)


@query(sql.TRAJECTORY_STATS)
def trajectory_stats(spark, sf_dir):
    return _stats_cols(trajectory.trajectory_stats(featured(spark, sf_dir)))


@query(sql.TRAJECTORY_VALIDITY)
def trajectory_validity(spark, sf_dir):
    return trajectory.is_valid(trajectory.trajectory_stats(featured(spark, sf_dir)), 60, 500.0).select("taxi_id", "n_points", "is_valid")


@query(sql.BBOX_CENTROID)
def bbox_centroid(spark, sf_dir):
    return rounded(trajectory.bbox_centroid(points(spark, sf_dir)), min_lat=6, max_lat=6, min_lon=6, max_lon=6, centroid_lat=6, centroid_lon=6)


@query(sql.SAMPLING_RATE)
def sampling_rate(spark, sf_dir):
    return trajectory.trajectory_stats(featured(spark, sf_dir)).select("taxi_id", F.round("sampling_rate_per_hour", 6).alias("sampling_rate_per_hour"))


@query(sql.RESAMPLE)
def resample_nearest(spark, sf_dir):
    return rounded(preprocess.resample(points(spark, sf_dir), 3600, carry=("lat", "lon")), lat=6, lon=6)


@query(sql.PIPELINE)
def preprocess_pipeline(spark, sf_dir):
    out = preprocess.preprocess(points(spark, sf_dir), PIPELINE)
    return out.select("taxi_id", "ts", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.round("speed", 3).alias("speed"))


@query(sql.PIPELINE_STATS)
def preprocess_trajectory_stats(spark, sf_dir):
    return _stats_cols(preprocess.preprocess_stats(points(spark, sf_dir), PIPELINE))


@query(sql.HAVERSINE_PAIRS)
def haversine_pairs(spark, sf_dir):
    w = trajectory.in_time()
    p = points(spark, sf_dir)
    return p.select("pt_id", F.round(haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")), 3).alias("distance_m"))


@query(sql.DISTANCE_MATRIX)
def distance_matrix_small(spark, sf_dir):
    """Between the nations' made-up places: a whole small table."""
    k = F.col("n_nationkey").cast("double")
    p = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("pt_id"), (F.lit(39.5) + k * 0.03).alias("lat"), (F.lit(116.0) + (k * 7.0) % 25.0 * 0.04).alias("lon"))
    return rounded(neighbors.distance_matrix(p, "haversine"), dist=3)


@query(sql.REGION_QUERY)
def region_query(spark, sf_dir):
    return neighbors.region_query(points(spark, sf_dir), 39.9, 116.3, 0.01).select("pt_id", F.round("dist", 6).alias("dist"))


@query(sql.EPS_NEIGHBORS)
def eps_neighbors(spark, sf_dir):
    # DuckDB's round of a double that is not negative; Spark's goes through a decimal of each row
    return edges_of(spark, sf_dir).withColumn("dist", F.floor(F.col("dist") * 1e6 + 0.5).cast("double") / 1e6)


@query(sql.NEIGHBOR_COUNTS)
def neighbor_counts(spark, sf_dir):
    return neighbors.neighbor_counts(points(spark, sf_dir), EPS)


@query(sql.CORE_POINTS)
def core_points(spark, sf_dir):
    return clustering.core_points(points(spark, sf_dir), EPS, MIN_SAMPLES).select("pt_id", "is_core")


@query(sql.LABELS)
def dbscan_labels_euclidean(spark, sf_dir):
    return labels_of(spark, sf_dir).select("pt_id", "is_core", "cluster_id")


@query(sql.LABELS_HAVERSINE)
def dbscan_labels_haversine(spark, sf_dir):
    return clustering.dbscan(points(spark, sf_dir), EPS_M, MIN_SAMPLES, "haversine").select("pt_id", "is_core", "cluster_id")


@query(sql.LEGACY)
def dbscan_legacy_labels(spark, sf_dir):
    return clustering.dbscan_legacy(points(spark, sf_dir), EPS, MIN_SAMPLES)


@query(sql.CLUSTER_STATS)
def cluster_stats(spark, sf_dir):
    return clustering.cluster_stats(labels_of(spark, sf_dir))


@query(sql.CLUSTER_SIZES)
def cluster_sizes(spark, sf_dir):
    return clustering.cluster_sizes(labels_of(spark, sf_dir))


@query(sql.TOP_CLUSTERS)
def cluster_sizes_top10(spark, sf_dir):
    """The first ten clusters by id, which is the report's order."""
    return clustering.cluster_sizes(labels_of(spark, sf_dir)).orderBy("cluster_id").limit(10)


@query(sql.CENTROIDS)
def cluster_centroids(spark, sf_dir):
    return rounded(clustering.cluster_centroids(labels_of(spark, sf_dir)), lat=6, lon=6)


@query(sql.SHAPES)
def cluster_shape_stats(spark, sf_dir):
    return rounded(clustering.cluster_shape_stats(labels_of(spark, sf_dir)), density=0, radius=6, compactness=0)


@query()
def cluster_hull_area(spark, sf_dir):
    return clustering.hull(labels_of(spark, sf_dir)).select("cluster_id", "n_points", F.round("area", 9).alias("area"), F.size("polygon").alias("n_corners"))


@query(sql.MAJORITY)
def trajectory_majority_label(spark, sf_dir):
    labels = labels_of(spark, sf_dir)
    moved = neighbors.nearest_label(points(spark, sf_dir), labels.select("pt_id", "lat", "lon", F.col("cluster_id").alias("label")), 0.001)
    return neighbors.majority_label(points(spark, sf_dir).select("pt_id", "taxi_id").join(moved, "pt_id"))


@query(sql.GRID)
def grid_partition(spark, sf_dir):
    return partition.grid_partition(points(spark, sf_dir), 9, 0.1).select("partition_id", "pt_id", "is_halo")


@query(sql.GRID_INFO)
def grid_partition_info(spark, sf_dir):
    return rounded(partition.partition_info(partition.grid_partition(points(spark, sf_dir), 9, 0.1)), avg_size=4, std_size=4)


@query(sql.PARTITION_SUMMARY)
def partition_summary(spark, sf_dir):
    s = partition.partition_summary(partition.grid_partition(points(spark, sf_dir), 9, 0.1))
    return rounded(s, min_x=6, max_x=6, min_y=6, max_y=6, centroid_x=6, centroid_y=6)


@query(sql.HASH)
def hash_partition(spark, sf_dir):
    return partition.hash_partition(points(spark, sf_dir), 16, 0.1).select("partition_id", "pt_id")


@query()
def kd_partition(spark, sf_dir):
    return partition.kd_partition(points(spark, sf_dir), 8).select("partition_id", "pt_id")


@query(sql.PARTITION_MERGE)
def partition_balance(spark, sf_dir):
    s = partition.partition_summary(partition.hash_partition(points(spark, sf_dir), 16, 0.1))
    total = s.agg(F.sum("n_points")).first()[0]
    return partition.merge_small(s, total / 4)


@query(sql.LABELS)
def dbscan_partitioned(spark, sf_dir):
    return partition.dbscan_partitioned(points(spark, sf_dir), EPS, MIN_SAMPLES, n_partitions=64).select("pt_id", "is_core", "cluster_id")


@query(sql.SCHEDULE)
def schedule_lpt(spark, sf_dir):
    s = partition.partition_summary(partition.hash_partition(points(spark, sf_dir), 16, 0.1))
    return rounded(partition.schedule(s, 4, "haversine"), estimate_s=6)


@query(sql.IMBALANCE)
def load_imbalance(spark, sf_dir):
    s = partition.partition_summary(partition.hash_partition(points(spark, sf_dir), 16, 0.1))
    return rounded(partition.load_imbalance(partition.schedule(s, 4, "haversine")), min_load=6, max_load=6, avg_load=6, imbalance=6)


def _labelings(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events")
    a = e.select(F.col("event_id").alias("pt_id"), (F.col("user_id") % 7).cast("int").alias("label"))
    b = e.select(F.col("event_id").alias("pt_id"), F.when(F.col("event_id") % 3 == 0, F.col("user_id") % 7).otherwise((F.col("user_id") * 3 + F.col("event_id") % 2) % 9).cast("int").alias("label"))
    return a, b


@query(sql.MERGE)
def merge_clusters(spark, sf_dir):
    return merge.merge_clusters(list(_labelings(spark, sf_dir)), 0.3)


@query(sql.CONTINGENCY)
def label_contingency(spark, sf_dir):
    return merge.contingency(*_labelings(spark, sf_dir))


@query(sql.ARI)
def adjusted_rand(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    side = lambda i: (F.col("embedding")[i] > 0).cast("int")
    a = e.select(F.col("vec_id").alias("pt_id"), F.col("label").cast("int").alias("label"))
    b = e.select(F.col("vec_id").alias("pt_id"), (side(0) * 2 + side(1) + 1).cast("int").alias("label"))
    return rounded(merge.agreement(a, b), adjusted_rand=9, match_rate=9)


@query(sql.GRID_SEARCH)
def param_grid(spark, sf_dir):
    return tuning.param_grid(points(spark, sf_dir), [EPS / 2, EPS], [5, 10]).drop("position")


@query(sql.MISSING)
def missing_profile(spark, sf_dir):
    return explore.missing_profile(dirty(spark, sf_dir))


@query(sql.DUPLICATES)
def duplicate_count(spark, sf_dir):
    return explore.duplicate_count(dirty(spark, sf_dir))


@query(sql.DISTINCT)
def distinct_counts(spark, sf_dir):
    return explore.distinct_counts(dirty(spark, sf_dir), ["taxi_id", "ts", "lat", "lon"])


@query(sql.DESCRIBE)
def describe_exact(spark, sf_dir):
    return rounded(explore.describe(dirty(spark, sf_dir), ["lat", "lon"]), mean=6, std=6, min=6, q25=6, q50=6, q75=6, max=6)


for _part in explore.PARTS:
    _name = {"hour": "hourly"}.get(_part, _part) + "_counts"
    QUERIES[_name] = lambda spark, sf_dir, part=_part: explore.counts_by(points(spark, sf_dir), part)
    ORACLES[_name] = sql.counts_by(_part)


@query(sql.ACTIVITY)
def taxi_activity(spark, sf_dir):
    return explore.taxi_activity(points(spark, sf_dir))


@query(sql.HISTOGRAM)
def activity_histogram(spark, sf_dir):
    return rounded(explore.histogram(explore.taxi_activity(points(spark, sf_dir)), "n_points", 30), low=6, high=6)


@query(sql.PARETO_SHARE)
def pareto_share(spark, sf_dir):
    return rounded(explore.pareto_share(explore.taxi_activity(points(spark, sf_dir))), cum_share=6)


@query(sql.PARETO)
def pareto_levels(spark, sf_dir):
    return explore.pareto(explore.taxi_activity(points(spark, sf_dir)))


@query(sql.IN_BOUNDS)
def in_bounds_share(spark, sf_dir):
    return rounded(explore.in_bounds_share(points(spark, sf_dir), REGION), pct_inside=6)


@query(sql.HEXBIN)
def hexbin_density(spark, sf_dir):
    bounds = {"x0": 116.0, "x1": 117.0, "y0": 39.5, "y1": 40.5}
    return rounded(explore.hexbin(points(spark, sf_dir), 50, bounds), cx=6, cy=6)


@query(sql.AREA)
def area_density(spark, sf_dir):
    return rounded(explore.area_density(points(spark, sf_dir)), area_deg2=6, points_per_deg2=2)


@query(sql.SUMMARY)
def dataset_summary(spark, sf_dir):
    s = explore.dataset_summary(points(spark, sf_dir), trajectory.trajectory_stats(featured(spark, sf_dir)))
    return rounded(s, mean_points=4, mean_hours=4, mean_km=3)


@query(sql.CHUNKS)
def chunk_ranges(spark, sf_dir):
    return explore.in_chunks(points(spark, sf_dir), 1000).groupBy("chunk").agg(F.min("pt_id").alias("start"), (F.max("pt_id") + 1).alias("stop"), F.count("*").alias("n_points"))


def _runs(spark, sf_dir) -> DataFrame:
    """A made-up series of measurements from the region keys."""
    k = F.col("r_regionkey").cast("double")
    return table(spark, sf_dir, "region").select(F.concat(F.lit("impl_"), F.col("r_regionkey").cast("string")).alias("implementation"), F.pow(F.lit(2.0), k).cast("int").alias("n_jobs"), (100.0 * (k + 1) * (k + 1)).alias("n"), (0.5 + 0.2 * (k + 1) * (k + 1) + 0.03 * k * k * k).alias("seconds"), (12.0 / (k + 1) + 1.5).alias("execution_time"), (50.0 + 10.0 * k).alias("memory_usage_mb"), (0.8 + 0.04 * k).alias("accuracy"))


@query(sql.COMPARISON)
def comparison_scores(spark, sf_dir):
    c = perf.comparison(_runs(spark, sf_dir).select("implementation", "execution_time", "memory_usage_mb", "accuracy"))
    return rounded(c, execution_time=6, relative_speed=6, memory_efficiency=6, overall_score=6, accuracy=6)


@query(sql.SCALABILITY)
def scalability_fit(spark, sf_dir):
    return rounded(perf.scalability_fit(_runs(spark, sf_dir).select("n", "seconds")), r2=6)


@query(sql.SPEEDUP)
def speedup_efficiency(spark, sf_dir):
    r = _runs(spark, sf_dir).select("n_jobs", F.col("execution_time").alias("seconds"))
    return rounded(perf.speedup_efficiency(r), seconds=6, speedup=6, efficiency=6, parallel_fraction=6)


@query(sql.COMPLEXITY)
def complexity_exponent(spark, sf_dir):
    return rounded(perf.complexity(_runs(spark, sf_dir).select("n", "seconds")), exponent=6)


@query(sql.BOTTLENECKS)
def bottleneck_rank(spark, sf_dir):
    calls = table(spark, sf_dir, "events").select(F.col("event_type").alias("function"), F.abs("value").alias("seconds"))
    return rounded(perf.bottlenecks(calls), seconds=3, share=6)


@query(sql.MEMORY)
def memory_peaks(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.sum("value").alias("mb"))
    return rounded(perf.memory_peaks(e.select(F.datediff("day", F.lit("1970-01-01")).cast("long").alias("seq"), F.round("mb", 3).alias("mb"))), mb=3, diff_mb=3)


def _snapshots(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.sum("value").alias("mb"))
    return e.select(F.datediff("day", F.lit("1970-01-01")).cast("long").alias("seq"), F.round("mb", 3).alias("mb"))


def _valued(spark, sf_dir):
    return points(spark, sf_dir).join(table(spark, sf_dir, "events").select(F.col("event_id").alias("pt_id"), "value"), "pt_id")


@query(sql.MEMORY_TREND)
def memory_trend(spark, sf_dir):
    return rounded(perf.memory_trend(_snapshots(spark, sf_dir)), least_mb=3, most_mb=3, growth_mb=3, growth_per_step=6)


@query(sql.CALLS_TOP)
def top_functions(spark, sf_dir):
    calls = table(spark, sf_dir, "events").select(F.col("event_type").alias("function"), F.col("value").alias("seconds"))
    return rounded(perf.top_functions(calls, 3), seconds=3)


@query(sql.SPATIAL)
def spatial_summary(spark, sf_dir):
    s = explore.spatial_summary(_valued(spark, sf_dir), "value")
    return rounded(s, center_lat=6, center_lon=6, min_lat=6, max_lat=6, min_lon=6, max_lon=6, min_value=6, max_value=6)


@query(sql.QUALITY)
def data_quality(spark, sf_dir):
    v = _valued(spark, sf_dir)
    return rounded(explore.data_quality(v, ["lat", "lon", "value"], preprocess.remove_invalid(v)), least=6, most=6, missing_pct=4, retention_pct=4)


@query(sql.TIMES)
def timestamp_parse(spark, sf_dir):
    """Every event's time written in one of the accepted forms or in none, and read again."""
    e = table(spark, sf_dir, "events")
    t = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    k = F.col("event_id") % 5
    text = F.when(k == 0, t).when(k == 1, F.concat(F.lit("  "), F.replace(t, F.lit("-"), F.lit("/")))).when(k == 2, F.substring(t, 1, 16)).when(k == 3, F.replace(F.substring(t, 1, 16), F.lit("-"), F.lit("/"))).otherwise("no time")
    return e.select("event_id", parse_timestamp(text).alias("ts"))


@query(sql.SAMPLE)
def point_sample(spark, sf_dir):
    """The max_points subset: exactly 500 points, the feature of the operator, in a fixed pseudo-random order."""
    p = points(spark, sf_dir)
    return p.withColumn("u", (F.col("pt_id") * 48271) % 2147483647).orderBy("u", "pt_id").limit(500).select("pt_id")
