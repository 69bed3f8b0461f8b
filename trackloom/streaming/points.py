"""Streams of points: the stateless steps and windowed counts of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.geo import REGION
from ..operators.preprocess import remove_invalid


def read_chunks(spark: SparkSession, folder: str, schema: StructType, format: str = "parquet", files_per_trigger: int = 1) -> DataFrame:
    """Files of a folder as a stream, some at a time: bounded memory for data that arrives in pieces."""
    return spark.readStream.schema(schema).format(format).option("maxFilesPerTrigger", files_per_trigger).load(folder)


def clean_stream(points: DataFrame, region: dict = REGION) -> DataFrame:
    return remove_invalid(points, region)


def hourly_counts(points: DataFrame, late: str = "1 hour") -> DataFrame:
    """Points of each hour; rows later than the watermark are dropped."""
    ts = points.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", late)
    return ts.groupBy(F.window("event_time", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "n")


def trips(points: DataFrame, max_gap_minutes: int = 30, late: str = "1 hour") -> DataFrame:
    """Points of each trip: a gap over the limit ends one (a session ends at a gap of its length, hence the microsecond)."""
    ts = points.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", late)
    w = F.session_window("event_time", f"{max_gap_minutes * 60 * 1_000_000 + 1} microseconds")
    return ts.groupBy("taxi_id", w.alias("w")).agg(F.count("*").alias("n_points")).select("taxi_id", F.col("w.start").alias("start_time"), "n_points")
