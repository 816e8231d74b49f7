"""Calendar keys, buckets and durations as columns; all UTC, independent of the session's zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKETS = (60, 300, 900, 3600)


def _date(seconds: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86_400).cast("int"))


def utc_day(seconds: Column) -> Column:
    """YYYYMMDD."""
    return F.date_format(_date(seconds), "yyyyMMdd").cast("int")


def utc_month(seconds: Column) -> Column:
    """YYYYMM."""
    return F.date_format(_date(seconds), "yyyyMM").cast("int")


def bucket(seconds: Column, width: int) -> Column:
    """Start of the bucket that holds the second."""
    return (F.floor(seconds / width) * width).cast("long")


#: Milliseconds of the units of a duration.
UNITS = {"ns": 1e-6, "us": 1e-3, "µs": 1e-3, "μs": 1e-3, "ms": 1.0, "s": 1e3, "m": 6e4, "h": 3.6e6}
_PART = r"[0-9]+(?:\.[0-9]*)?|\.[0-9]+"


def duration_ms(text: Column) -> Column:
    """Milliseconds of a duration like 1m30s, -250ms, 1.5h or 0; units may repeat and come in any order; null where it is malformed."""
    units = "ns|us|µs|μs|ms|s|m|h"
    found = lambda group: F.regexp_extract_all(text, F.lit(f"({_PART})({units})"), F.lit(group))
    scale = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    parts = F.zip_with(found(1), found(2), lambda n, u: n.cast("double") * scale[u])
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    signed = F.when(F.startswith(text, F.lit("-")), -total).otherwise(total)
    return F.when(text.rlike("^[+-]?0$"), F.lit(0.0)).when(text.rlike(f"^[+-]?(?:(?:{_PART})(?:{units}))+$"), signed)
