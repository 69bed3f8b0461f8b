"""What the density queries may form: work dealt over all tasks, no list of all pairs where none is asked for."""

import math
import random

import pytest

from trackloom.operators import dbscan, neighbors, tuning
from trackloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture
def joins(monkeypatch):
    """Distance joins made: whether they are of all points."""
    made, join = [], neighbors.eps_edges

    def kept(points, eps, metric="euclidean", of=None):
        out = join(points, eps, metric, of)
        made.append(of is None)
        return out

    for module in (neighbors, dbscan, tuning):
        monkeypatch.setattr(module, "eps_edges", kept, raising=False)
    return made


def test_the_distance_join_is_dealt_by_cell(spark):
    df = QUERIES["eps_neighbors"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    assert df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def written(plan) -> int:
    """Rows that the exchanges of an executed plan wrote; an exchange that is read again counts once."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return written(plan.executedPlan())
    if name.endswith("QueryStage"):
        return written(plan.plan())
    if name == "ReusedExchange":
        return 0
    below = plan.children()
    own = plan.metrics().apply("shuffleRecordsWritten").value() if name == "Exchange" else 0
    return own + sum(written(below.apply(k)) for k in range(below.size()))


def test_the_distance_join_writes_each_point_about_once(spark):
    df = QUERIES["eps_neighbors"](spark, SF)
    assert df.collect()
    rows = written(df._jdf.queryExecution().executedPlan())
    assert 1000 <= rows < 3 * 1000  # nine cells of each point and the point once more were 10,000


@pytest.mark.parametrize("metric", ["euclidean", "haversine"])
def test_the_distance_join_over_tiles_equals_brute_force(spark, metric):
    rng, eps = random.Random(5), 1.0 if metric == "euclidean" else 111_000.0
    places = [(rng.randrange(-40, 41) / 2, rng.randrange(-20, 21) / 2) for _ in range(300)] + [(8.0, 8.0)] * 5 + [(-8.0, 7.5)] * 3
    rows = [(k, x, y) for k, (x, y) in enumerate(places)] + [(900, None, 1.0), (901, 1.0, None), (902, float("nan"), 1.0), (None, 1.0, 1.0)]
    points = spark.createDataFrame(rows, "pt_id long, lat double, lon double")
    got = [(r["i"], r["j"]) for r in neighbors.eps_edges(points, eps, metric).collect()]

    def dist(p, q):
        if metric == "euclidean":
            return math.hypot(p[0] - q[0], p[1] - q[1])
        a, b, c, d = map(math.radians, (*p, *q))
        return 2 * 6371000.0 * math.asin(math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2))

    want = [(i, j) for i, p in enumerate(places) for j, q in enumerate(places) if i != j and dist(p, q) <= eps]
    assert len(want) > 300 and sorted(got) == sorted(want)


@pytest.mark.parametrize("name", ["dbscan_legacy_labels", "param_grid"])
def test_no_list_of_all_pairs(spark, joins, name):
    QUERIES[name](spark, SF)
    assert joins and not any(joins)
