"""Full and bounded reads of source tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.times import local_time


def snapshot_scan(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """All rows of a table. Files written once give the consistent view."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def jdbc_scan(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str,
    lower: Any,
    upper: Any,
    partitions: int,
    **options: str,
) -> DataFrame:
    """All rows of a database table, read in parallel over a key range.

    The driver for ``url`` must be on the class path.
    """
    return (
        spark.read.format("jdbc")
        .option("url", url)
        .option("dbtable", table)
        .option("partitionColumn", partition_column)
        .option("lowerBound", lower)
        .option("upperBound", upper)
        .option("numPartitions", partitions)
        .options(**options)
        .load()
    )


def snapshot_window_scan(
    df: DataFrame, watermark_column: str, start: Any = None, end: Any = None
) -> DataFrame:
    """Rows with ``start <= watermark_column < end``; an open side is unbounded."""
    known = {name.lower(): name for name in df.columns}
    if watermark_column.lower() not in known:
        raise ValueError(f"no column {watermark_column!r}")
    kind = df.schema[known[watermark_column.lower()]].dataType

    def bound(value: Any) -> Column:
        if isinstance(value, datetime) and isinstance(kind, T.TimestampNTZType):
            return local_time(value)
        return F.lit(value).cast(kind)

    column = F.col(f"`{known[watermark_column.lower()]}`")
    if start is not None:
        df = df.where(column >= bound(start))
    if end is not None:
        df = df.where(column < bound(end))
    return df
