"""Change tables of a SQL Server database, read over JDBC.

The JDBC driver must be on the class path. The change function takes its
range as arguments, so only the wanted changes leave the server; ``splits``
cuts the range into parts that are read in parallel.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.lsn import lsn_format

_INSTANCE = re.compile(r"[A-Za-z0-9_]+")
_LSN = re.compile(r"0x[0-9A-F]{20}")

# System columns of a change table.
START_LSN, SEQVAL, OPERATION = "__$start_lsn", "__$seqval", "__$operation"


def _checked(pattern: re.Pattern, text: str, what: str) -> str:
    if not pattern.fullmatch(text):
        raise ValueError(f"not a valid {what}: {text!r}")
    return text


def change_query(capture_instance: str, from_lsn: str, to_lsn: str) -> str:
    """All changes with old images; names and positions are checked, not quoted."""
    name = _checked(_INSTANCE, capture_instance, "capture instance")
    low, high = (_checked(_LSN, text, "LSN") for text in (from_lsn, to_lsn))
    return (
        f"(SELECT * FROM cdc.fn_cdc_get_all_changes_{name}"
        f"({low}, {high}, N'all update old')) changes"
    )


def split_predicates(splits: Sequence[str]) -> list[str]:
    """Adjoining conditions on the position, one per part."""
    cuts = sorted(_checked(_LSN, text, "LSN") for text in splits)
    column = f"[{START_LSN}]"
    if not cuts:
        return ["1 = 1"]
    middle = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(cuts, cuts[1:])]
    return [f"{column} < {cuts[0]}", *middle, f"{column} >= {cuts[-1]}"]


def map_changes(rows: DataFrame, capture_instance: str, ts: Column) -> DataFrame:
    """Server change rows in the columns the change operators work on.

    ``ts`` is one time for the whole read; see ``commit_time`` for commit times.
    """
    data = [name for name in rows.columns if not name.startswith("__$")]
    return rows.select(
        F.lit(capture_instance).alias("capture_instance"),
        lsn_format(F.col(f"`{START_LSN}`")).alias("_lsn"),
        lsn_format(F.col(f"`{SEQVAL}`")).alias("_seqval"),
        F.col(f"`{OPERATION}`").cast("int").alias("_op_code"),
        ts.alias("_ts"),
        *(F.col(f"`{name}`") for name in data),
    )


def server_changes(
    spark: SparkSession,
    url: str,
    capture_instance: str,
    from_lsn: str,
    to_lsn: str,
    ts: Column,
    splits: Sequence[str] = (),
    **properties: str,
) -> DataFrame:
    rows = spark.read.jdbc(
        url,
        change_query(capture_instance, from_lsn, to_lsn),
        predicates=split_predicates(splits),
        properties=properties,
    )
    return map_changes(rows, capture_instance, ts)


def server_positions(
    spark: SparkSession, url: str, capture_instances: Sequence[str], **properties: str
) -> DataFrame:
    """Highest position of the database and lowest one of each instance. One row per instance."""
    names = [_checked(_INSTANCE, name, "capture instance") for name in capture_instances]
    parts = " UNION ALL ".join(
        f"SELECT '{name}' AS capture_instance, sys.fn_cdc_get_min_lsn('{name}') AS low, "
        "sys.fn_cdc_get_max_lsn() AS high"
        for name in names
    )
    rows = spark.read.jdbc(url, f"({parts}) positions", properties=properties)
    return rows.select(
        "capture_instance",
        lsn_format(F.col("low")).alias("low_lsn"),
        lsn_format(F.col("high")).alias("high_lsn"),
    )
