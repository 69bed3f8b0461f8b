import datetime as dt

import pytest
from pyspark.sql import functions as F

from trackloom.functions.geo import bearing_deg, haversine_m, in_region
from trackloom.functions.time import parse_timestamp
from trackloom.operators import explore, perf, preprocess, trajectory
from trackloom.sources import generate, gps
from trackloom.streaming import points as stream

BASE = dt.datetime(2008, 2, 2, 12)
SCHEMA = "pt_id long, taxi_id string, ts timestamp_ntz, lat double, lon double"


def frame(spark, seconds, taxi="a", step=0.001):
    return spark.createDataFrame([(i, taxi, BASE + dt.timedelta(seconds=s), 39.9 + i * step, 116.3) for i, s in enumerate(seconds)], SCHEMA)


def test_geometry(spark):
    r = spark.range(1).select(
        haversine_m(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("d"), bearing_deg(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("n"), bearing_deg(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("e"),
        in_region(F.lit(float("nan")), F.lit(116.0)).alias("nan"), in_region(F.lit(39.4), F.lit(117.4)).alias("edge"),
    ).first()
    assert abs(r["d"] - 111194.927) < 1e-3 and r["n"] == 0 and abs(r["e"] - 90) < 1e-12 and not r["nan"] and r["edge"]


def test_segments(spark):
    got = trajectory.segments(frame(spark, [60 * m for m in (0, 10, 45, 50, 120)]), 30).orderBy("pt_id").collect()
    assert [(r["pt_id"], r["segment_id"]) for r in got] == [(0, "a_segment_0"), (1, "a_segment_0"), (2, "a_segment_1"), (3, "a_segment_1")]
    assert trajectory.segments(frame(spark, [0, 1800]), 30).count() == 2  # exactly the gap does not cut
    stats = trajectory.segment_stats(trajectory.segments(frame(spark, [0, 60]), 30)).first()
    assert stats["duration_s"] == 60 and stats["n_points"] == 2


def test_resample(spark):
    got = preprocess.resample(frame(spark, [0, 50, 130]), 60, carry=("lat", "lon")).orderBy("ts").collect()
    assert [(r["ts"] - BASE).seconds for r in got] == [0, 60, 120]
    assert [round((r["lat"] - 39.9) * 1000) for r in got] == [0, 1, 2]
    tie = preprocess.resample(frame(spark, [0, 120]), 60, carry=("lat", "lon")).orderBy("ts").collect()
    assert [round((r["lat"] - 39.9) * 1000) for r in tie] == [0, 0, 1]
    assert preprocess.resample(frame(spark, [5]), 60, carry=("lat", "lon")).count() == 1


def test_features(spark):
    rows = trajectory.movement_features(frame(spark, [0, 10, 10, 30])).orderBy("pt_id").collect()
    first = rows[0]
    assert first["speed"] == first["direction"] == first["acceleration"] == 0 and first["distance_from_prev"] is None and first["speed_kmh"] is None
    assert rows[1]["acceleration"] == 0 and rows[2]["time_from_prev"] == 1.0
    assert abs(rows[2]["acceleration"] - (rows[2]["speed"] - rows[1]["speed"])) < 1e-9
    alone = trajectory.movement_features(frame(spark, [0])).first()
    assert alone["speed"] is None and alone["acceleration"] is None


def test_outliers(spark):
    f = trajectory.movement_features(frame(spark, [0, 100, 101, 200]))
    top = f.filter("pt_id = 1").first()["speed_kmh"]
    assert {r["pt_id"] for r in preprocess.filter_outliers(f, top, 1e9).collect()} >= {0, 1}
    assert 2 not in {r["pt_id"] for r in preprocess.filter_outliers(f, top * 1.5, 1e9).collect()}
    assert preprocess.filter_outliers(trajectory.movement_features(frame(spark, [0, 1])), 0.0, 0.0).count() == 2


def test_clean(spark):
    nan = float("nan")
    rows = [(0, "a", BASE, 39.9, 116.3), (0, "a", BASE, 39.9, 116.3), (1, "a", BASE, nan, 116.3), (2, "a", None, 39.9, 116.3), (3, "a", BASE, 0.0, 116.3), (4, "a", BASE.replace(year=1990), 39.9, 116.3)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert preprocess.remove_invalid(df).count() == 2
    assert sorted(r["pt_id"] for r in preprocess.clean(df).collect()) == [0, 4]


def test_raw_files(spark, tmp_path):
    (tmp_path / "b.csv").write_text("A,2008-02-02 15:36:08,116.5,39.9\nA,2008/02/02 15:37,116.6,39.9,extra\nshort,row\nB,no time,116.5,39.9\nB,2008-02-02 15:36,oops,39.9\nA,2008-02-02 16:00:00,116.5,39.9\n")
    (tmp_path / "a.csv").write_text("C,2008-02-02 15:36:08,116.5,39.9\n")
    (tmp_path / "z.txt").write_text("D,2008-02-02 15:36:08,116.5,39.9\n")
    rows = gps.load_all(spark, str(tmp_path)).filter(F.col("file").endswith("b.csv")).orderBy("pos").collect()
    assert [(r["taxi_id"], r["run_id"]) for r in rows] == [("A", 0), ("A", 0), ("B", 1), ("A", 2)]
    assert rows[2]["ts"] is None and rows[1]["ts"] == dt.datetime(2008, 2, 2, 15, 37)
    assert gps.load_all(spark, str(tmp_path), limit_per_file=1).count() == 3
    assert gps.load_all(spark, str(tmp_path), 0.5).count() == 1  # the first of two files by name
    with pytest.raises(ValueError):
        gps.load_all(spark, str(tmp_path), 0.1)
    info = gps.dataset_info(spark, str(tmp_path)).first()
    assert info["n_files"] == 2 and info["file_names"] == ["a.csv", "b.csv"]
    assert gps.read_frame(spark, str(tmp_path / "a.csv")).first()["lat"] == 39.9
    assert [len(c) for c in gps.chunks(spark.range(5), 2)] == [2, 2, 1]


@pytest.mark.parametrize("form", ["parquet", "csv", "json"])
def test_sinks(spark, tmp_path, form):
    p = trajectory.movement_features(frame(spark, [0, 10]))
    gps.write_points(p, str(tmp_path / "out"), form)
    back = spark.read.format(form).option("header", "true").load(str(tmp_path / "out"))
    assert back.count() == 2 and set(back.columns) <= set(gps.SINK_COLUMNS)
    with pytest.raises(ValueError):
        gps.write_points(p, str(tmp_path / "x"), "pickle")


def test_timestamps(spark):
    forms = {" 2008-02-02 15:36:08": (15, 36, 8), "2008/02/02 15:36:08": (15, 36, 8), "2008-02-02 15:36": (15, 36, 0), "2008/02/02 15:36": (15, 36, 0), "2008-02-02T15:36:08": (15, 36, 8), "never": None, "": None}
    got = {r["t"]: r["x"] for r in spark.createDataFrame([(f,) for f in forms], "t string").select("t", parse_timestamp(F.col("t")).alias("x")).collect()}
    assert {t: x and (x.hour, x.minute, x.second) for t, x in got.items()} == forms


def test_generators(spark):
    assert generate.uniform(spark, 100).agg(F.min("lat")).first()[0] >= 39
    b = generate.blobs(spark, 200)
    assert b.count() == 220 and b.filter("label = 0").count() == 20


def test_explore_edges(spark):
    empty = frame(spark, [])
    assert explore.missing_profile(empty).count() == 5 and explore.in_bounds_share(empty).first()["pct_inside"] == 0
    assert explore.hexbin(empty).count() == 0 and explore.histogram(empty, "lat").count() == 0
    same = explore.histogram(spark.range(3).select(F.lit(4.0).alias("v")), "v", 4).orderBy("bin").collect()
    assert [r["n"] for r in same] == [0, 0, 3, 0]
    assert explore.chunk_ranges(5, 2, spark).collect()[-1]["stop"] == 5


def test_perf(spark):
    one = spark.createDataFrame([("x", 1.0, 2.0, None)], "implementation string, execution_time double, memory_usage_mb double, accuracy double")
    assert perf.comparison(one).first()["overall_score"] is None
    runs = spark.createDataFrame([(float(n), 3.0 * n * n + 1) for n in (1, 2, 5, 9, 14)], "n double, seconds double")
    best = perf.scalability_fit(runs).filter("best").first()
    assert best["model"] == "quadratic" and abs(best["r2"] - 1) < 1e-9
    amdahl = spark.createDataFrame([(n, 10 * (0.25 + 0.75 / n)) for n in (1, 2, 4, 8)], "n_jobs int, seconds double")
    assert abs(perf.speedup_efficiency(amdahl).first()["parallel_fraction"] - 0.75) < 1e-9
    assert perf.measure(spark, {"r": lambda: spark.range(7)}).first()["n_rows"] == 7


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    frame(spark, [0, 60, 4000, 9000]).write.parquet(src)
    df = stream.read_chunks(spark, src, frame(spark, []).schema)
    for name, build in (("hours", stream.hourly_counts), ("trips", stream.trips), ("clean", stream.clean_stream)):
        out = build(df)
        q = out.writeStream.format("memory").queryName(name).outputMode("append" if name == "clean" else "complete" if name == "hours" else "append").start()
        q.processAllAvailable()
        q.stop()
    assert sorted(r["n"] for r in spark.sql("select * from hours").collect()) == [1, 1, 2]
    assert spark.sql("select * from clean").count() == 4


def test_call_tree_and_consumers(spark):
    from trackloom.operators import perf

    calls = spark.createDataFrame([("main", None, 9.0), ("load", "main", 4.0), ("load", "main", 1.0), ("parse", "load", 2.0), ("main", "parse", 1.0)], "function string, caller string, seconds double")
    got = {tuple(r["path"]): (r["depth"], r["seconds"], r["n_calls"]) for r in perf.call_tree(calls).collect()}
    assert got == {("main",): (1, 9.0, 1), ("main", "load"): (2, 5.0, 2), ("main", "load", "parse"): (3, 2.0, 1)}
    grown = spark.createDataFrame([("a", 5.0), ("a", 7.0), ("b", 1.0)], "function string, mb double")
    assert [tuple(r) for r in perf.memory_consumers(grown, 2.0).collect()] == [("a", 6.0)]


def test_load_sampled(spark, tmp_path):
    from trackloom.sources import gps

    for k in range(3):
        lines = [f"{k},2008-02-02 {15 + i // 60:02}:{i % 60:02}:00,{116.3 + i * 0.001},39.9" for i in range(90)]
        (tmp_path / f"{k}.csv").write_text("\n".join(lines))
    whole = gps.load_sampled(spark, str(tmp_path), 1.0)
    assert whole.count() == 135  # every 120 s of 90 minutes, three taxis
    some = gps.load_sampled(spark, str(tmp_path), 1.0, max_points=20)
    assert some.count() == 20 and some.columns == whole.columns
