"""Time expressions that do not depend on the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(c: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone; null stays null."""
    col = F.col(c) if isinstance(c, str) else c
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), col.cast("timestamp_ntz"))


def month(c: str | Column) -> Column:
    """YYYY-MM of a timestamp, ``none`` if null."""
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.date_format(col.cast("timestamp_ntz"), "yyyy-MM"), F.lit("none"))
