"""Time expressions on zone-free timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accepted forms, tried in this order before the free form.
FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy/MM/dd HH:mm")


def parse_timestamp(c: Column) -> Column:
    """Zone-free timestamp of a string, null if no form fits."""
    text = F.trim(c)
    tried = [F.try_to_timestamp(text, F.lit(f)) for f in FORMATS]
    return F.coalesce(*tried, text.try_cast("timestamp")).cast("timestamp_ntz")


def seconds(c: Column) -> Column:
    """Seconds since the epoch with microseconds."""
    return F.unix_micros(c.cast("timestamp")) / F.lit(1e6)


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def elapsed_s(a: Column, b: Column) -> Column:
    """Seconds from a to b, with microseconds."""
    return (micros(b) - micros(a)) / F.lit(1e6)
