import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import dbscan as d
from trackloom.operators import merge, neighbors, partition, tuning
from trackloom.operators.graph import components

SCHEMA = "pt_id long, lat double, lon double"


def brute(xy, eps, least, dist=math.dist):
    """Clusters by expansion, point by point."""
    n = len(xy)
    near = [[j for j in range(n) if j != i and dist(xy[i], xy[j]) <= eps] for i in range(n)]
    core = [len(x) >= least for x in near]
    label, k = [0] * n, 0
    for i in range(n):
        if not core[i] or label[i]:
            continue
        k += 1
        todo = [i]
        while todo:
            p = todo.pop()
            if label[p]:
                continue
            label[p] = k
            if core[p]:
                todo += [q for q in near[p] if not label[q]]
    return label, core


def haversine(a, b):
    p1, p2 = math.radians(a[0]), math.radians(b[0])
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371000.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def frame(spark, xy):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], SCHEMA)


def labels(df):
    return [(r["cluster_id"], r["is_core"]) for r in df.orderBy("pt_id").collect()]


FIXED = [
    ([(0, 0), (0, 1), (1, 0), (10, 10), (10, 11), (11, 10), (50, 50)], 1, 2, [1, 1, 1, 2, 2, 2, 0], [0, 0, 0, 1, 1, 1, 0]),
    ([(x, 0) for x in (0.0, -0.5, -0.6, 1.0, 2.0, 2.5, 2.6)], 1, 3, [1, 1, 1, 1, 2, 2, 2], [0, 0, 0, 1, 1, 1, 1]),
]


@pytest.mark.parametrize("xy,eps,least,want,legacy", FIXED)
def test_fixed(spark, xy, eps, least, want, legacy):
    p = frame(spark, xy)
    got = d.dbscan(p, eps, least)
    assert [k for k, _ in labels(got)] == want
    old = d.legacy_labels(p, neighbors.eps_edges(p, eps), got).orderBy("pt_id").collect()
    assert [r["label"] for r in old] == legacy


@pytest.mark.parametrize("seed,eps,least", [(1, 0.05, 4), (2, 0.03, 3)])
def test_random_points_and_partitions(spark, seed, eps, least):
    xy = np.random.default_rng(seed).random((250, 2)).round(3)
    want = list(zip(*brute(xy.tolist(), eps, least), strict=True))
    p = frame(spark, xy)
    assert labels(d.dbscan(p, eps, least)) == want
    for n in (1, 9):
        assert labels(partition.dbscan_partitioned(p, eps, least, n_partitions=n)) == want


def test_haversine(spark):
    xy = np.random.default_rng(3).random((150, 2)) * 0.02 + [39.9, 116.3]
    want = list(zip(*brute(xy.tolist(), 150.0, 3, haversine), strict=True))
    assert labels(d.dbscan(frame(spark, xy), 150.0, 3, "haversine")) == want
    assert labels(partition.dbscan_partitioned(frame(spark, xy), 150.0, 3, "haversine", 4)) == want


def test_partitions_write_no_list_of_pairs(spark, monkeypatch):
    """What partitions write grows with the points where they crowd, and hot squares are cut to size."""
    rng = np.random.default_rng(8)
    xy = np.concatenate([rng.normal(0.5, 0.004, (400, 2)), rng.random((60, 2)), np.full((40, 2), 0.25), [[0.5, 0.9]]])
    want = list(zip(*brute(xy.tolist(), 0.02, 4), strict=True))
    written, write = [], partition.materialise
    monkeypatch.setattr(partition, "materialise", lambda df, tag, *a, **k: written.append(write(df, tag, *a, **k)) or written[-1])
    assert labels(partition.dbscan_partitioned(frame(spark, xy), 0.02, 4, n_partitions=4)) == want
    assert written and all(df.count() <= 2 * len(xy) for df in written)
    sizes, local = [], partition._local
    monkeypatch.setattr(partition, "_local", lambda eps, least, metric, squares, reach: sizes.append([len(h) for h in squares.heavy]) or local(eps, least, metric, squares, reach))
    assert labels(partition.dbscan_partitioned(frame(spark, xy), 0.02, 4, n_partitions=4, most_points=50)) == want
    assert len(sizes[0]) > 1


def test_partitions_keep_points_without_a_place(spark):
    rows = [(i, 1.0, 1.0) for i in range(4)] + [(4, None, 1.0), (5, float("nan"), 1.0), (6, 1.0, None), (7, 1.5, 1.0)]
    p = spark.createDataFrame(rows, SCHEMA)
    for eps in (0.0, 0.1):
        assert labels(partition.dbscan_partitioned(p, eps, 3)) == [(1, True)] * 4 + [(0, False)] * 4


def test_empty_and_unknown_metric(spark):
    p = frame(spark, [])
    assert d.dbscan(p, 1.0, 2).count() == 0 and partition.dbscan_partitioned(p, 1.0, 2).count() == 0
    with pytest.raises(ValueError):
        neighbors.eps_edges(p, 1.0, "manhattan")


def test_distances(spark):
    p = frame(spark, [(0, 0), (1, 0), (0, 1)])
    m = {(r["i"], r["j"]): r["dist"] for r in neighbors.distance_matrix(p, "haversine").collect()}
    assert abs(m[0, 1] - 111194.927) < 1e-3 and m[1, 1] == 0 and len(m) == 9
    assert {r["pt_id"] for r in neighbors.region_query(p, 0.0, 0.0, 1.0, exclude=0).collect()} == {1, 2}


def test_nearest_label(spark):
    rng = np.random.default_rng(4)
    p, ref = rng.random((60, 2)) * 3, rng.random((40, 2))
    df = spark.createDataFrame([(i, float(a), float(b), i % 5) for i, (a, b) in enumerate(ref)], SCHEMA + ", label int")
    want = {i: int(np.argmin(((ref - x) ** 2).sum(axis=1))) % 5 for i, x in enumerate(p)}
    assert {r["pt_id"]: r["label"] for r in neighbors.nearest_label(frame(spark, p), df, 0.05).collect()} == want


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = rng.integers(0, 300, (200, 2)).tolist()
    root = list(range(300))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(i, i) == find(i) for i in range(300))


def test_merge_and_agreement(spark):
    frame_of = lambda v: spark.createDataFrame(list(enumerate(v)), "pt_id long, label int")
    a, b = frame_of([1, 1, 2, 2, 0, 0]), frame_of([5, 5, 5, 7, 7, 0])
    assert [r["label"] for r in merge.merge_clusters([a, b], 0.5).orderBy("pt_id").collect()] == [1, 1, 1, 2, 2, 0]
    assert merge.merge_clusters([]) is None
    assert merge.agreement(a, a).first()["adjusted_rand"] == 1.0
    assert merge.agreement(a, b.limit(3)).first()["adjusted_rand"] == 0.0


def test_partitions(spark):
    xy = np.random.default_rng(6).random((300, 2))
    p = frame(spark, xy)
    grid = partition.grid_partition(p, 9, 0.1)
    assert grid.filter("not is_halo").count() == 300 and grid.count() > 300
    kd = partition.kd_partition(p, 4)
    assert kd.count() == 300 and kd.select("partition_id").distinct().count() >= 4
    info = partition.partition_info(partition.hash_partition(p, 16)).first()
    assert info["total_points"] == 300
    s = spark.createDataFrame([(i, n) for i, n in enumerate([5, 50, 3, 3, 60])], "partition_id int, n_points long")
    assert [r["merged_id"] for r in partition.merge_small(s, 50).orderBy("partition_id").collect()] == [0, 0, 1, 1, 1]
    plan = partition.schedule(s, 2)
    assert [r["partition_id"] for r in plan.orderBy("position").collect()] == [4, 1, 0, 2, 3]
    assert partition.load_imbalance(plan).first()["n_workers"] == 2


def test_tuning(spark):
    xy = np.random.default_rng(7).random((120, 2))
    grid = tuning.param_grid(frame(spark, xy), [0.05, 0.1], [2, 4])
    for r in grid.collect():
        want, core = brute(xy.tolist(), r["eps"], r["min_samples"])
        assert (r["n_clusters"], r["n_noise"], r["n_core_points"]) == (max(want), want.count(0), sum(core))
    assert tuning.best_parameters(tuning.param_grid(frame(spark, xy), [], [])) == {"eps": 100.0, "min_samples": 5, "n_clusters": 0}
    assert tuning.hash_sample(frame(spark, xy), 50).count() == 50


def test_hull(spark):
    xy = [(0, 0), (0, 2), (2, 2), (2, 0), (1, 1), (5, 5), (6, 6)]
    df = frame(spark, xy).withColumn("cluster_id", F.when(F.col("pt_id") < 5, 1).otherwise(2).cast("int")).withColumn("is_core", F.lit(True))
    got = {r["cluster_id"]: (r["n_points"], r["area"], len(r["polygon"])) for r in d.hull(df, 2).collect()}
    assert got == {1: (5, 4.0, 4), 2: (2, 0.0, 2)}
