"""Shared plumbing of the corpus operators: column projection, written intermediates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..work import discard, fresh_path, materialise, release_shuffles, work_dir

__all__ = ["crc_of_id", "discard", "fresh_path", "materialise", "project", "release_shuffles", "work_dir"]


def project(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named inputs, under internal names, so extra columns never clash."""
    return df.select(*[F.col(f"`{src}`").alias(dst) for dst, src in columns.items()])


def crc_of_id(column: str) -> Column:
    """crc32 of an id written as text, the deal used by held-out splits (null id: of '')."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))
