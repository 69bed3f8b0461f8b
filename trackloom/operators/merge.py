"""Comparing and merging labelings (pt_id, label; 0 is noise)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contingency(a: DataFrame, b: DataFrame) -> DataFrame:
    """l1, l2, n over points that both labelings hold."""
    return a.select("pt_id", F.col("label").alias("l1")).join(b.select("pt_id", F.col("label").alias("l2")), "pt_id").groupBy("l1", "l2").agg(F.count("*").alias("n"))


def merge_two(a: DataFrame, b: DataFrame, overlap_threshold: float = 0.5) -> DataFrame:
    """Labels of A with B's clusters merged in.

    For each cluster of B, ascending: the commonest cluster of A on its points (ties to the
    smaller) takes it if it holds at least the threshold's share of it, else it gets the
    next new id. Points that B calls noise keep A's label. The rule over clusters runs as a
    running count over the table of clusters, not over points.
    """
    table = contingency(a, b).filter("l2 <> 0")
    sizes = table.groupBy("l2").agg(F.sum("n").alias("size"))
    best = table.filter("l1 > 0").groupBy("l2").agg(F.max(F.struct("n", (-F.col("l1")).alias("m"))).alias("k")).select("l2", (-F.col("k.m")).alias("target"), F.col("k.n").alias("n"))
    rule = sizes.join(best, "l2", "left").withColumn("adopt", F.coalesce(F.col("n") / F.col("size") >= overlap_threshold, F.lit(False)))
    top = a.agg(F.coalesce(F.max("label"), F.lit(0))).first()[0]
    fresh = [r["l2"] for r in rule.filter("not adopt").select("l2").orderBy("l2").collect()]  # one row a cluster
    spark = a.sparkSession
    names = spark.createDataFrame([(int(l2), int(top + k + 1)) for k, l2 in enumerate(fresh)], "l2 long, fresh long")
    mapped = rule.join(names, "l2", "left").select("l2", F.when(F.col("adopt"), F.col("target")).otherwise(F.col("fresh")).alias("to"))
    both = a.select("pt_id", F.col("label").alias("l1")).join(b.select("pt_id", F.col("label").alias("l2")), "pt_id", "left")
    return both.join(mapped, "l2", "left").select("pt_id", F.coalesce("to", "l1").cast("int").alias("label"))


def merge_clusters(labelings: list[DataFrame], overlap_threshold: float = 0.5) -> DataFrame | None:
    """The labelings folded from the left; None for none."""
    return reduce(lambda a, b: merge_two(a, b, overlap_threshold), labelings) if labelings else None


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: n_points, adjusted_rand, match_rate. Labelings of different sizes agree 0."""
    two = lambda c: c * (c - 1) / 2
    n = contingency(a, b).select("l1", "l2", F.col("n").cast("double").alias("n"))
    cells = n.agg(F.sum(two(F.col("n"))).alias("s"), F.sum("n").alias("n"), F.sum(F.when(F.col("l1") == F.col("l2"), F.col("n")).otherwise(0.0)).alias("same"))
    rows = n.groupBy("l1").agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("s1"))
    cols = n.groupBy("l2").agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("s2"))
    sizes = a.agg(F.count("*").alias("na")).crossJoin(b.agg(F.count("*").alias("nb")))  # one row each
    one = cells.crossJoin(rows).crossJoin(cols).crossJoin(sizes)
    expected = F.col("s1") * F.col("s2") / two(F.col("n"))
    best = (F.col("s1") + F.col("s2")) / 2
    ari = F.when(F.col("na") != F.col("nb"), 0.0).when(best == expected, 1.0).otherwise((F.col("s") - expected) / (best - expected))
    return one.select(F.col("n").cast("long").alias("n_points"), ari.alias("adjusted_rand"), F.when(F.col("na") != F.col("nb"), 0.0).otherwise(F.col("same") / F.col("n")).alias("match_rate"))
