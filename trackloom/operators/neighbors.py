"""Distance joins over points (pt_id, lat, lon).

A join by distance alone would be a nested loop over all pairs; here each point is keyed
by its grid cell, one side is exploded to the cells around, and an equi join on the cell
carries the exact test as residual. Its output is its work: cells of eps keep candidates
within a small factor of the true neighbours. For all points the pairs, not the bytes of the
points, are the work: a broadcast join would do them in the few tasks that read the points. So
square tiles of cells are dealt over all shuffle partitions, each with the cells around it; the
cells are exploded, as lists of their points, only there. What is written to disk is each point
once and again for tiles it borders on, never the nine cells of each point, nor the pairs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import METRES_PER_DEGREE, cell, check_metric, distance
from ..work import materialise


#: Cells along a side of a tile, which one task joins.
TILE = 4


def cell_sizes(eps: float, metric: str, widest_lat: float = 0.0) -> tuple[float, float]:
    """Sides in degrees of cells whose 3x3 block holds every neighbour within eps."""
    check_metric(metric)
    if metric == "euclidean":
        return eps * (1 + 1e-9), eps * (1 + 1e-9)
    lat = eps / METRES_PER_DEGREE * 1.01
    widest = min(89.0, widest_lat + lat)
    return lat, lat / math.cos(math.radians(widest)) * 1.01


def max_abs_lat(points: DataFrame, metric: str) -> float:
    if metric == "euclidean":
        return 0.0
    return float(points.agg(F.max(F.abs("lat"))).first()[0] or 0.0)


def _around(cells: list[Column], reach: int = 1) -> Column:
    steps = range(-reach, reach + 1)
    return F.explode(F.array(*[F.struct((cells[0] + i).alias("cx"), (cells[1] + j).alias("cy")) for i in steps for j in steps]))


def eps_edges(points: DataFrame, eps: float, metric: str = "euclidean", of: DataFrame | None = None) -> DataFrame:
    """Directed neighbour pairs (i, j, dist): i <> j, distance at most eps (inclusive). ``of``: only these points as i."""
    a, b = cell_sizes(eps, metric, max_abs_lat(points, metric))
    d = distance(metric, F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    pairs = _pairs_by_tile(points, a, b) if of is None else _pairs_of(points, of, a, b)
    return pairs.filter("i <> j").select("i", "j", d.alias("dist")).filter(F.col("dist") <= eps)


def _pairs_of(points: DataFrame, of: DataFrame, a: float, b: float) -> DataFrame:
    """Points of ``of`` (i, lat1, lon1) with the points (j, lat2, lon2) of the cells around."""
    place = lambda p: p.select("pt_id", "lat", "lon", cell(F.col("lat"), a).alias("cx"), cell(F.col("lon"), b).alias("cy"))
    left = place(of).select(F.col("pt_id").alias("i"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), _around([F.col("cx"), F.col("cy")]).alias("c"))
    left = left.select("i", "lat1", "lon1", F.col("c.cx").alias("cx"), F.col("c.cy").alias("cy"))
    right = place(points).select(F.col("pt_id").alias("j"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), "cx", "cy")
    return left.join(right, ["cx", "cy"])


def _pairs_by_tile(points: DataFrame, a: float, b: float) -> DataFrame:
    """The same of all points. Both sides read one exchange; what a point joins is a cell's lists, read in an inner loop."""
    cx, cy = cell(F.col("lat"), a), cell(F.col("lon"), b)
    tile = lambda c: F.floor(c / F.lit(TILE))
    tiles = lambda c: F.explode(F.sequence(tile(c - 1), tile(c + 1)))
    dealt = points.filter("pt_id IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL").select("pt_id", "lat", "lon", tiles(cx).alias("tx")).select("pt_id", "lat", "lon", "tx", tiles(cy).alias("ty"))
    dealt = dealt.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), "tx", "ty").withColumns({"cx": cx, "cy": cy})
    left = dealt.select("tx", "ty", F.col("pt_id").alias("i"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), F.col("cx").alias("cx1"), F.col("cy").alias("cy1"))
    right = dealt.groupBy("tx", "ty", "cx", "cy").agg(*[F.collect_list(c).alias(f"{c}s") for c in ("pt_id", "lat", "lon")]).hint("merge")
    own = (tile(F.col("cx1")) == F.col("tx")) & (tile(F.col("cy1")) == F.col("ty"))
    reach = F.when(own, 1).otherwise(-1)  # in the join's condition: a filter would go below the exchange, which each side would then write for itself
    near = (F.abs(F.col("cx1") - F.col("cx")) <= reach) & (F.abs(F.col("cy1") - F.col("cy")) <= 1)
    found = left.join(right, ["tx", "ty"]).filter(near).select("i", "lat1", "lon1", "lats", "lons", F.posexplode("pt_ids").alias("k", "j"))
    item = lambda c: F.get(F.col(c), F.col("k"))
    return found.select("i", "lat1", "lon1", "j", item("lats").alias("lat2"), item("lons").alias("lon2"))


def neighbor_counts(points: DataFrame, eps: float, metric: str = "euclidean", edges: DataFrame | None = None) -> DataFrame:
    """pt_id, n_neighbors (the point itself not counted; 0 if alone)."""
    edges = eps_edges(points, eps, metric) if edges is None else edges
    n = edges.groupBy(F.col("i").alias("pt_id")).agg(F.count("*").alias("n_neighbors"))
    return points.select("pt_id").join(n, "pt_id", "left").select("pt_id", F.coalesce("n_neighbors", F.lit(0)).alias("n_neighbors"))


def distance_matrix(points: DataFrame, metric: str = "euclidean") -> DataFrame:
    """All ordered pairs (i, j, dist), the diagonal 0: an operator for small sets by its nature."""
    check_metric(metric)
    a = points.select(F.col("pt_id").alias("i"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    b = points.select(F.col("pt_id").alias("j"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    d = distance(metric, F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    return a.crossJoin(b).select("i", "j", F.when(F.col("i") == F.col("j"), 0.0).otherwise(d).alias("dist"))


def region_query(points: DataFrame, lat: float, lon: float, eps: float, metric: str = "euclidean", exclude: int | None = None) -> DataFrame:
    """Points within eps of one place; ``exclude`` leaves out the query point itself."""
    a, b = cell_sizes(eps, metric, abs(lat) + 1)
    near = points.filter(F.col("lat").between(lat - a, lat + a) & F.col("lon").between(lon - b, lon + b))
    if exclude is not None:
        near = near.filter(F.col("pt_id") != exclude)
    return near.withColumn("dist", distance(metric, F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))).filter(F.col("dist") <= eps)


def spatial_index(points: DataFrame, size: float) -> DataFrame:
    """Points with their grid cell, for equi joins."""
    return points.withColumn("cx", cell(F.col("lat"), size)).withColumn("cy", cell(F.col("lon"), size))


def nearest_label(points: DataFrame, labelled: DataFrame, size: float = 0.01) -> DataFrame:
    """pt_id, label: the label of the nearest row of ``labelled`` (pt_id, lat, lon, label), ties to the smaller pt_id.

    A point where a labelled row stands takes its label at once. For the rest rings of cells
    grow until a point's nearest found lies within the ring that is fully searched, so no
    pair of all points with all points is formed. Each round is a written table.
    """
    ref = labelled.select(F.col("pt_id").alias("r_id"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"), "label")
    here = ref.groupBy("r_lat", "r_lon").agg(F.min_by("label", "r_id").alias("label"))
    same = points.select("pt_id", "lat", "lon").join(here, (F.col("lat") == F.col("r_lat")) & (F.col("lon") == F.col("r_lon")), "left")
    now = materialise(same.select("pt_id", "lat", "lon", "label", F.col("r_lat").isNotNull().alias("hit")), "nearest")
    done, side = now.filter("hit").select("pt_id", "label"), size
    none = ref.isEmpty()
    while side < 360 * 8 and not none:
        todo = now.filter("not hit").select("pt_id", "lat", "lon")
        if todo.isEmpty():
            break
        q = todo.select("pt_id", "lat", "lon", _around([cell(F.col("lat"), side), cell(F.col("lon"), side)]).alias("c")).select("pt_id", "lat", "lon", "c.cx", "c.cy")
        r = ref.withColumn("cx", cell(F.col("r_lat"), side)).withColumn("cy", cell(F.col("r_lon"), side))
        d = (F.col("lat") - F.col("r_lat")) * (F.col("lat") - F.col("r_lat")) + (F.col("lon") - F.col("r_lon")) * (F.col("lon") - F.col("r_lon"))
        best = q.join(r, ["cx", "cy"]).select("pt_id", "label", F.struct(d.alias("d"), "r_id").alias("k")).groupBy("pt_id").agg(F.min_by("label", "k").alias("label"), F.min("k.d").alias("d"))
        found = best.filter(F.col("d") <= side * side).select("pt_id", "label", F.lit(True).alias("hit"))
        now = materialise(todo.join(found, "pt_id", "left").select("pt_id", "lat", "lon", "label", F.coalesce("hit", F.lit(False)).alias("hit")), "nearest")
        done = done.unionByName(now.filter("hit").select("pt_id", "label"))
        side *= 8
    return done


def majority_label(transferred: DataFrame, key: str = "taxi_id") -> DataFrame:
    """key, label, n: the most frequent label of each trajectory, ties to the smallest."""
    n = transferred.groupBy(key, "label").agg(F.count("*").alias("n"))
    w = W.partitionBy(key).orderBy(F.col("n").desc(), "label")
    return n.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
