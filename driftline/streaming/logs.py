"""Live log subscription."""

from __future__ import annotations

from pyspark.sql import DataFrame

from driftline.operators.logs import level_filter, text_filter


def log_stream(logs: DataFrame, min_level: str = "Information", text: str | None = None) -> DataFrame:
    """Entries of a streaming log at or above a level, as they arrive.

    Stateless: attach any sink with ``writeStream``.
    """
    return text_filter(level_filter(logs, min_level), text)
