"""One copy of each event of a stream of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.sources.changes import EVENT_KEY

# How long after an event a copy of it may come: the least retention of changes.
REMEMBER = "7 days"


def dedup_stream(changes: DataFrame, remember: str = REMEMBER) -> DataFrame:
    """The copy of each event that arrives first; later ones go for as long as ``remember``.

    Known events are keyed state: it is spread over the shuffle partitions,
    kept in the checkpoint across starts, and dropped with age. Age counts from
    arrival, so however old an event is, it never comes too late.
    """
    keys = [name for name in EVENT_KEY if name in changes.columns]
    return (
        changes.withColumn("__arrived", F.current_timestamp()).withWatermark("__arrived", remember)
        .dropDuplicatesWithinWatermark(keys).drop("__arrived")
    )
