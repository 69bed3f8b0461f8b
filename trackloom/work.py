"""The shared work folder and written intermediates."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share (``spark.checkpoint.dir``).

    Only in local mode without the setting (tests, a laptop) a temporary folder is used; on
    a cluster its absence is an error, as executors would not see the driver's folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="trackloom-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/trackloom-{spark.sparkContext.applicationId}"
    if path not in _marked:  # the application's own folder, deleted when its JVM ends
        hadoop, files = _files(spark, path)
        files.mkdirs(hadoop)
        files.deleteOnExit(hadoop)
        _marked.add(path)
    return path


_marked: set[str] = set()


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{work_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str, compression: str = "zstd", level: int | None = None, page: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    writer = df.write.option("compression", compression)
    if level is not None:
        writer = writer.option("parquet.compression.codec.zstd.level", str(level))
    if page is not None:
        writer = writer.option("parquet.page.size", str(page))
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.trackloom_path = path
    return out


def discard(spark: SparkSession, path: str) -> None:
    """Delete a written intermediate that no live plan reads any more."""
    hadoop, files = _files(spark, path)
    files.delete(hadoop, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's context cleaner drop shuffle files of finished plans.

    The cleaner acts when the driver's JVM collects the plans that own the files.
    """
    gc.collect()
    spark._jvm.System.gc()
