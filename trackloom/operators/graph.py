"""Connected components by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..work import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of each node's component, from links (a, b) of nodes that can be ordered.

    Nodes that are their own root have no row. Each round is a written table, so a lost
    executor costs one round; a round's work is a few shuffles of the remaining links.
    """
    now = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = lambda x: x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    old = mark(now)
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("x"), F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, F.col("a") == F.col("x")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("x"), "m")
        stars = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        small = large.join(low, F.col("a") == F.col("x")).select(F.explode(stars).alias("e")).select("e.a", "e.b").filter("a <> b").distinct()
        then = materialise(small, "links")
        new = mark(then)
        discard(edges.sparkSession, now.trackloom_path)
        if old == new:
            return then.select(F.col("a").alias("node"), F.col("b").alias("root"))
        now, old = then, new
