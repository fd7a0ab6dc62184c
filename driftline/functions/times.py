"""Times without zone: literals, differences and text that no session zone moves."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_time(value: datetime) -> Column:
    """A datetime as a literal without zone."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def millis_between(start: Column, end: Column) -> Column:
    """Whole milliseconds from ``start`` to ``end``."""
    span = end - start
    minutes = (
        F.extract(F.lit("DAY"), span) * 1440
        + F.extract(F.lit("HOUR"), span) * 60
        + F.extract(F.lit("MINUTE"), span)
    )
    return minutes.cast("bigint") * 60_000 + F.floor(
        F.extract(F.lit("SECOND"), span) * 1000
    ).cast("bigint")


def local_time_text(column: Column, separator: str, digits: int) -> Column:
    """``yyyy-MM-dd``, separator, ``HH:mm:ss`` and a fraction of ``digits`` places."""
    text = column.cast("string")
    return F.concat(
        F.substring(text, 1, 10),
        F.lit(separator),
        F.substring(text, 12, 8),
        F.lit("."),
        F.rpad(F.substring(text, 21, min(digits, 6)), digits, "0"),
    )
