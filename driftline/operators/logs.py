"""Structured log queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.labels import level_rank, level_rank_of
from driftline.functions.times import local_time_text

# Properties with a column of their own, and the buffer size.
KNOWN_PROPERTIES = {
    "CorrelationId": "correlation_id",
    "BatchId": "batch_id",
    "Table": "table",
    "DatasetId": "dataset_id",
}
RECENT_LOGS = 500


def log_fields(df: DataFrame, json_col: str) -> DataFrame:
    """Lift the known properties to columns, keep the rest as a map.

    The map is NULL when nothing else was logged. ``unparsed`` has the text
    that is no JSON object, NULL otherwise.
    """
    parsed = df.withColumn("__all", F.from_json(F.col(json_col), "map<string,string>"))
    rest = F.map_filter("__all", lambda name, _: ~name.isin(list(KNOWN_PROPERTIES)))
    lifted = [F.col("__all").getItem(name).alias(to) for name, to in KNOWN_PROPERTIES.items()]
    kept = [name for name in df.columns if name != json_col]
    return parsed.select(
        *kept,
        *lifted,
        F.when(F.size(rest) > 0, rest).alias("properties"),
        F.when(F.col("__all").isNull(), F.col(json_col)).alias("unparsed"),
    )


def level_filter(logs: DataFrame, min_level: str) -> DataFrame:
    if min_level.strip().upper() == "ALL":
        return logs
    return logs.where(level_rank(F.col("level")) >= level_rank_of(min_level))


def text_filter(logs: DataFrame, text: str | None) -> DataFrame:
    wanted = (text or "").strip()
    if not wanted:
        return logs
    return logs.where(F.contains(F.lower("message"), F.lower(F.lit(wanted))))


def log_query(
    logs: DataFrame, min_level: str = "Information", text: str | None = None, n: int = RECENT_LOGS
) -> DataFrame:
    """The newest ``n`` entries at or above a level that hold ``text``, oldest first."""
    found = text_filter(level_filter(logs, min_level), text)
    tie = [name for name in ("event_id",) if name in logs.columns]
    newest = found.orderBy(F.col("timestamp").desc(), *(F.col(t).desc() for t in tie)).limit(n)
    return newest.orderBy("timestamp", *tie)


def log_lines(logs: DataFrame) -> DataFrame:
    """Export form: ``yyyy-MM-dd HH:mm:ss.fff [Level] message``. What is missing is empty."""
    empty = F.lit("")
    return logs.select(
        F.concat(
            F.coalesce(local_time_text(F.col("timestamp"), " ", 3), empty),
            F.lit(" ["),
            F.coalesce("level", empty),
            F.lit("] "),
            F.coalesce("message", empty),
        ).alias("line")
    )
