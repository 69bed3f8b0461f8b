"""Reading raw position logs, describing data sets, writing points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.time import parse_timestamp
from ..operators.trajectory import run_split

#: Raw logs have no header; longitude stands before latitude.
RAW = T.StructType([T.StructField("taxi_id", T.StringType()), T.StructField("timestamp", T.StringType()), T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())])
SINK_COLUMNS = ["taxi_id", "timestamp", "latitude", "longitude", "speed", "direction"]


def list_files(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """(path, bytes) of the folder's csv files in order of name, or of its txt files if it has no csv."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted((s.getPath().toString(), s.getLen()) for s in fs.listStatus(path) if s.isFile())
    return [x for x in found if x[0].endswith(".csv")] or [x for x in found if x[0].endswith(".txt")]


def sample_files(files: list, sample_rate: float = 1.0) -> list:
    """The first int(n * rate) files: a share of whole files, not of rows."""
    return files[: int(len(files) * sample_rate)]


def parse_lines(lines: DataFrame) -> DataFrame:
    """Rows of (file, pos, value): short rows and rows with unreadable numbers go, unreadable times stay null."""
    parts = F.split("value", ",")
    out = lines.select("file", "pos", parts.alias("p")).filter(F.size("p") >= 4)
    out = out.select("file", "pos", F.trim(F.col("p")[0]).alias("taxi_id"), parse_timestamp(F.col("p")[1]).alias("ts"), F.trim(F.col("p")[2]).try_cast("double").alias("lon"), F.trim(F.col("p")[3]).try_cast("double").alias("lat"))
    return out.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull())


def read_trajectories(spark: SparkSession, paths: list[str] | str, limit_per_file: int | None = None) -> DataFrame:
    """file, run_id, pos, taxi_id, ts, lon, lat: a run ends where the next accepted row has another taxi.

    ``pos`` is a row's place in its file. ``limit_per_file`` keeps the first runs of each file
    (None: all). Files that can't be read are skipped, as ``ignoreCorruptFiles`` has it.
    """
    raw = spark.read.option("ignoreCorruptFiles", "true").text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("k"))
    # within a block rows have rising numbers, and blocks of a file rise with their start
    ordered = parse_lines(raw.select("file", F.struct("block", "k").alias("pos"), "value"))
    runs = run_split(ordered, ["pos"], ["file"])
    return runs if limit_per_file is None else runs.filter(F.col("run_id") < limit_per_file)


def load_all(spark: SparkSession, folder: str, sample_rate: float = 1.0, limit_per_file: int | None = None) -> DataFrame:
    files = [p for p, _ in sample_files(list_files(spark, folder), sample_rate)]
    if not files:
        raise ValueError(f"no files to read in {folder} at sample rate {sample_rate}")
    return read_trajectories(spark, files, limit_per_file)


def load_sampled(spark: SparkSession, folder: str, sample_rate: float = 0.001, max_points: int | None = None, limit_per_file: int | None = 100) -> DataFrame:
    """Trajectories of a share of the files, cleaned and resampled (five points, 150 km/h, 120 s); ``max_points`` of them by hash."""
    from ..operators.preprocess import Preprocessing, preprocess
    from ..operators.tuning import hash_sample

    raw = load_all(spark, folder, sample_rate, limit_per_file).withColumn("pt_id", F.xxhash64("file", "pos"))
    out = preprocess(raw, Preprocessing(min_length=5, max_speed_kmh=150.0, interval_s=120))
    if max_points is None:
        return out
    return hash_sample(out.withColumn("pt_id", F.xxhash64("taxi_id", "ts")), max_points).drop("pt_id")


def read_frame(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """Typed raw rows; rows that don't fit have nulls. ``n``: the first n rows of a file."""
    df = spark.read.schema(RAW).csv(path, header=False, mode="PERMISSIVE")
    return df if n is None else df.limit(n)


def chunks(df: DataFrame, size: int):
    """Rows at the edge of the API, ``size`` at a time; one partition is held at once."""
    rows = []
    for r in df.toLocalIterator():
        rows.append(r)
        if len(rows) == size:
            yield rows
            rows = []
    if rows:
        yield rows


def dataset_info(spark: SparkSession, folder: str) -> DataFrame:
    """One row: n_files, file_names, total_size_mb, data_dir."""
    files = list_files(spark, folder)
    row = (len(files), [p.rsplit("/", 1)[1] for p, _ in files], sum(n for _, n in files) / 1024 / 1024, folder)
    return spark.createDataFrame([row], "n_files long, file_names array<string>, total_size_mb double, data_dir string")


def sink_frame(points: DataFrame) -> DataFrame:
    return points.select("taxi_id", F.col("ts").alias("timestamp"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), *[c for c in ("speed", "direction") if c in points.columns])


def write_points(points: DataFrame, path: str, format: str = "parquet") -> None:
    """Flat points as parquet, csv (with header) or json lines."""
    if format not in ("parquet", "csv", "json"):
        raise ValueError(f"format must be parquet, csv or json, not {format!r}")
    writer = sink_frame(points).write.mode("overwrite").format(format)
    (writer.option("header", "true") if format == "csv" else writer).save(path)


def write_summary(summary: DataFrame, path: str, format: str = "json") -> None:
    """Small result frames (parameters, counts, timings) in one file."""
    writer = summary.coalesce(1).write.mode("overwrite").format(format)
    (writer.option("header", "true") if format == "csv" else writer).save(path)
