"""Parameter search for the clustering."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from itertools import product

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..work import materialise
from .dbscan import cluster_stats, dbscan, summary


def param_grid(points: DataFrame, eps_range: list[float], min_samples_range: list[int], metric: str = "euclidean") -> DataFrame:
    """eps, min_samples, n_clusters, n_noise, n_core_points, position.

    Each pair of parameters is clustered over cells: a list of all neighbour pairs at the
    largest eps would grow with the square of the density. Up to four run at a time, as
    most of their jobs are too short to keep all cores busy.
    """
    spark = points.sparkSession
    pairs = list(product(eps_range, min_samples_range))
    with ThreadPoolExecutor(4) as pool:
        found = list(pool.map(inheritable_thread_target(spark)(lambda p: summary(points, *p, metric).first()), pairs))
    rows = [(float(e), int(m), int(s["n_clusters"]), int(s["n_noise"]), int(s["n_core_points"]), k) for k, ((e, m), s) in enumerate(zip(pairs, found, strict=True))]
    return spark.createDataFrame(rows, "eps double, min_samples int, n_clusters long, n_noise long, n_core_points long, position int")


def best_parameters(grid: DataFrame, default: tuple = (100.0, 5, 0)) -> dict:
    """Most clusters, the first of equals; the default for an empty grid."""
    r = grid.orderBy(F.col("n_clusters").desc(), "position").first()
    return {"eps": r["eps"], "min_samples": r["min_samples"], "n_clusters": r["n_clusters"]} if r else dict(zip(("eps", "min_samples", "n_clusters"), default, strict=True))


def hash_sample(points: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """Exactly k rows (all, if fewer), the same for the same input."""
    return points.orderBy(F.xxhash64("pt_id", F.lit(seed)), "pt_id").limit(k)


def estimate_n_clusters(points: DataFrame, eps: float, min_samples: int = 5, sample: int = 1000) -> int:
    """Clusters among a bounded sample (an estimate by its nature)."""
    return cluster_stats(dbscan(materialise(hash_sample(points, sample), "sample"), eps, min_samples)).first()["n_clusters"]
