"""Reads over change tables.

A change table has ``capture_instance``, ``_lsn``, ``_seqval``, ``_op_code``,
``_ts`` and the data columns of its source table. Laid out with one folder per
capture instance and sorted by ``_lsn``, the filters below prune folders and
row groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.labels import UPDATE_OLD, op_label
from driftline.functions.lsn import ZERO_LSN, canonical_lsn, lsn_increment, lsn_text

SYSTEM_PREFIX = "__$"
CHANGE_COLUMNS = ("capture_instance", "_lsn", "_seqval", "_op_code", "_ts")
EVENT_KEY = ("capture_instance", "_lsn", "_seqval", "_op_code")
# So many capture instances at most are named to the scan.
PRUNED_INSTANCES = 64
DELIVERY_ORDER = ("_lsn", "_seqval", "_op_code")


def change_scan(ct: DataFrame, from_lsn: str, to_lsn: str) -> DataFrame:
    """Changes of the closed range, old images included. Bounds in any accepted spelling."""
    return ct.where(F.col("_lsn").between(canonical_lsn(from_lsn), canonical_lsn(to_lsn)))


def lsn_range(ct: DataFrame, bounds: DataFrame) -> DataFrame:
    """Changes in ``(last_lsn, to_lsn]`` of each capture instance in ``bounds``.

    ``bounds`` has ``capture_instance``, ``last_lsn``, ``to_lsn``; a change
    inside several ranges counts once. A missing ``last_lsn`` is the start, and
    text that is no LSN is an error. One literal range around all of them
    reaches the scan; which join follows is Spark's choice and changes no row.
    """
    last = F.coalesce("last_lsn", F.lit(ZERO_LSN))
    ranges = bounds.select(
        F.col("capture_instance").alias("__instance"),
        lsn_text(last, strict=True).alias("__last"),
        lsn_text(F.col("to_lsn"), strict=True).alias("__to"),
    ).distinct()
    around = ranges.agg(F.min("__last").alias("low"), F.max("__to").alias("high")).first()
    if around.low is None:
        return ct.where(F.lit(False))
    inside = (
        (F.col("capture_instance") == F.col("__instance"))
        & (F.col("_lsn") > F.col("__last"))
        & (F.col("_lsn") <= F.col("__to"))
    )
    near = ct.where((F.col("_lsn") > around.low) & (F.col("_lsn") <= around.high))
    # A short list of instances also prunes folders; the join decides in any case.
    some = ranges.select("__instance").distinct().limit(PRUNED_INSTANCES + 1).collect()
    if len(some) <= PRUNED_INSTANCES:
        near = near.where(F.col("capture_instance").isin([row[0] for row in some]))
    return near.join(ranges, inside, "left_semi")


def lsn_high(feed: DataFrame) -> DataFrame:
    """Highest LSN over all capture instances, ``ZERO_LSN`` when there is none."""
    return feed.agg(F.coalesce(F.max("_lsn"), F.lit(ZERO_LSN)).alias("high_lsn"))


def lsn_low(feed: DataFrame, floor: DataFrame | None = None) -> DataFrame:
    """Lowest LSN still available per capture instance.

    ``floor`` (``capture_instance, floor_lsn``) holds what a purge recorded and
    decides where it has an entry: an instance without remaining rows still
    reports its gap, and one with rare changes reports none. Without an entry
    the first row counts, which can only report too many gaps.
    """
    low = feed.groupBy("capture_instance").agg(F.min("_lsn").alias("low_lsn"))
    if floor is None:
        return low
    floors = floor.select("capture_instance", lsn_text(F.col("floor_lsn"), strict=True).alias("floor_lsn"))
    return low.join(
        floors, "capture_instance", "full"
    ).select("capture_instance", F.coalesce("floor_lsn", "low_lsn").alias("low_lsn"))


def change_project(ct: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Data columns only, or ``columns`` where given; system columns go."""
    dropped = {"capture_instance", "_op_code"}
    names = [
        name
        for name in ct.columns
        if not name.startswith(SYSTEM_PREFIX) and name not in dropped
    ]
    if columns is not None:
        wanted = {name.lower() for name in columns} | {"_op", "_lsn", "_seqval", "_ts"}
        names = [name for name in names if name.lower() in wanted]
    return ct.select(*(f"`{name}`" for name in names))


def label_changes(ct: DataFrame, simple: bool = False) -> DataFrame:
    """Add ``_op``; the simple form drops old images first."""
    if simple:
        ct = ct.where(F.col("_op_code") != UPDATE_OLD)
    return ct.withColumn("_op", op_label(F.col("_op_code"), simple))


def change_order(ct: DataFrame) -> DataFrame:
    """Delivery order: an update's old image comes right before its new one."""
    return ct.orderBy(*DELIVERY_ORDER)


def commit_time(ct: DataFrame, lsn_times: DataFrame, default_ts: Column) -> DataFrame:
    """Set ``_ts`` from an LSN-to-time table (one row per LSN).

    LSNs without an entry get ``default_ts``, one constant per run, so a
    repeated run writes the same text.
    """
    times = lsn_times.select("_lsn", F.col("commit_ts").alias("__commit_ts"))
    return (
        ct.join(times, "_lsn", "left")
        .withColumn("_ts", F.coalesce("__commit_ts", default_ts))
        .select(*ct.columns, *([] if "_ts" in ct.columns else ["_ts"]))
    )


def event_dedup(ct: DataFrame) -> DataFrame:
    """One row per event when ranges were delivered more than once.

    Keeps the copy read first: the one with the lowest ``_ts``, a missing one
    counting as latest; copies with equal times are told apart by their other
    columns, so the result is one and the same. Copies collapse before the
    shuffle.
    """
    keys = [name for name in EVENT_KEY if name in ct.columns]
    rest = [name for name in ct.columns if name not in keys]
    row = F.struct(F.col("_ts").isNull().alias("__late"), "_ts", *(n for n in rest if n != "_ts"))
    picked = ct.groupBy(*keys).agg(F.min(row).alias("__row"))
    return picked.select(
        *(F.col(name) if name in keys else F.col(f"__row.`{name}`") for name in ct.columns)
    )


def op_counts(ct: DataFrame) -> DataFrame:
    """Changes by capture instance and operation label."""
    return (
        ct.groupBy("capture_instance", "_op_code")
        .agg(F.count(F.lit(1)).alias("changes"))
        .select("capture_instance", op_label(F.col("_op_code")).alias("_op"), "changes")
    )


def effective_retention_minutes(current_minutes: int, min_days: int) -> int:
    """Retention is raised to the minimum, never lowered."""
    return max(current_minutes, min_days * 24 * 60)


def retention_purge(
    ct: DataFrame,
    current_minutes: int,
    min_days: int,
    now: Column,
    floor: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Changes younger than the retention, and the new floor per instance.

    A change without a time is kept.

    The floor is the LSN after the last purged one: a reader that has seen
    all purged changes still finds its range complete. An earlier ``floor``
    is carried on and never lowered.
    """
    minutes = effective_retention_minutes(current_minutes, min_days)
    cutoff = now - F.make_dt_interval(mins=F.lit(minutes))
    kept = ct.where((F.col("_ts") >= cutoff) | F.col("_ts").isNull())
    purged_to = F.max(F.when(F.col("_ts") < cutoff, F.col("_lsn")))
    reached = ct.groupBy("capture_instance").agg(purged_to.alias("__purged")).select(
        "capture_instance",
        F.coalesce(lsn_increment(F.col("__purged")), F.lit(ZERO_LSN)).alias("floor_lsn"),
    )
    if floor is not None:
        before = floor.select("capture_instance", F.col("floor_lsn").alias("__before"))
        # ``greatest`` skips NULLs.
        reached = reached.join(before, "capture_instance", "full").select(
            "capture_instance", F.greatest("floor_lsn", "__before").alias("floor_lsn")
        )
    return kept, reached
