"""What to do with each table, and what becomes of its state: one row per table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.lsn import ZERO_LSN, lsn_increment

# States and codes.
PENDING, COMPLETE, REBOOTSTRAP = "PENDING", "COMPLETE", "REBOOTSTRAP"
GAP_CODE = "CDC_GAP_DETECTED"


def _from_lsn() -> Column:
    return lsn_increment(F.coalesce(F.col("last_processed_lsn"), F.lit(ZERO_LSN)))


def _with_bounds(state: DataFrame, high_lsn: str, lows: DataFrame) -> DataFrame:
    """State with its range and the lowest LSN available.

    Tables without change capture get a key of their own, so that they do not
    meet in one task.
    """
    own = F.concat(F.lit("table "), F.concat_ws(".", "table_schema", "table_name"))
    available = lows.select(
        F.col("capture_instance").alias("__key"), "low_lsn", F.lit(True).alias("__known")
    )
    return (
        state.withColumn("__key", F.coalesce("capture_instance", own))
        .join(available, "__key", "left")
        .drop("__key")
        .withColumn("from_lsn", _from_lsn())
        .withColumn("to_lsn", F.lit(high_lsn))
    )


def _nothing_new() -> Column:
    return F.coalesce(F.col("from_lsn") > F.col("to_lsn"), F.lit(True))


def _history_missing() -> Column:
    return F.col("low_lsn") > F.col("from_lsn")


def no_change_skip(state: DataFrame, high_lsn: str) -> DataFrame:
    """Tables whose next LSN lies above the highest one."""
    ranged = state.withColumn("from_lsn", _from_lsn()).withColumn("to_lsn", F.lit(high_lsn))
    return ranged.where(_nothing_new())


def gap_detect(state: DataFrame, high_lsn: str, lows: DataFrame) -> DataFrame:
    """Tables with changes to read whose history no longer reaches back far enough."""
    return _with_bounds(state, high_lsn, lows).where(~_nothing_new() & _history_missing()).drop("__known")


def plan_tables(
    state: DataFrame, high_lsn: str, lows: DataFrame, kind: str = "DELTA"
) -> DataFrame:
    """One row per table: ``action`` with its range and reason.

    ``high_lsn`` is read once per run, before any table is scanned. The range
    test comes before the gap test: without new changes nothing is missing.
    """
    bounded = _with_bounds(state, high_lsn, lows)
    status, mode = F.col("bootstrap_status"), F.col("extraction_mode")
    rules: list[tuple[Column, str, str]] = [(mode == "BLOCK", "BLOCK", "no unique key")]
    if kind == "SNAPSHOT":
        rules.append((F.lit(True), "SNAPSHOT", "snapshot run"))
    else:
        rules += [
            (status == REBOOTSTRAP, "SNAPSHOT", "history gap"),
            (mode == "SNAP", "SNAPSHOT", "snapshot on every run"),
            (status == PENDING, "SNAPSHOT", "first load"),
            (F.col("capture_instance").isNull(), "ERROR", "no capture instance"),
            (F.col("__known").isNull(), "ERROR", "unknown capture instance"),
            (_nothing_new(), "SKIP", "no new changes"),
            (F.col("low_lsn").isNull(), "ERROR", "unknown change history"),
            (_history_missing(), "GAP", "history gap"),
            (F.lit(True), "DELTA", "changes"),
        ]
    action = reason = None
    for test, name, why in rules:
        action = F.when(test, name) if action is None else action.when(test, name)
        reason = F.when(test, why) if reason is None else reason.when(test, why)
    return bounded.withColumn("action", action).withColumn("reason", reason).drop("__known")


def state_transition(
    state: DataFrame, outcomes: DataFrame, now: Column
) -> tuple[DataFrame, DataFrame]:
    """New state rows from what happened to each table, and rejected outcomes.

    ``outcomes`` has one row per table: ``table_schema``, ``table_name``,
    ``outcome`` (SNAPSHOT, DELTA, GAP or ERROR), ``outcome_lsn``,
    ``outcome_hash``, ``outcome_message``.
    """
    keys = ["table_schema", "table_name"]
    # Names ignore case; the state's spelling stays.
    named = outcomes
    for key in keys:
        named = named.withColumn(f"__{key}", F.lower(key)).drop(key)
    joined = state.join(named, [F.lower(state[key]) == named[f"__{key}"] for key in keys])
    outcome, status = F.col("outcome"), F.col("bootstrap_status")
    complete = status == COMPLETE
    legal = (
        F.when(outcome == "SNAPSHOT", status.isin(PENDING, REBOOTSTRAP, COMPLETE))
        .when(outcome.isin("DELTA", "GAP"), complete)
        .otherwise(outcome == "ERROR")
    )
    loaded = outcome.isin("SNAPSHOT", "DELTA")
    lsn = F.when(loaded, F.col("outcome_lsn")).otherwise(F.col("last_processed_lsn"))
    changed = {
        "bootstrap_status": F.when(outcome == "SNAPSHOT", COMPLETE)
        .when(outcome == "GAP", REBOOTSTRAP)
        .otherwise(status),
        # The zero LSN stands for "none" and is stored as NULL.
        "last_processed_lsn": F.nullif(lsn, F.lit(ZERO_LSN)),
        "schema_hash": F.when(outcome == "SNAPSHOT", F.col("outcome_hash")).otherwise(
            F.col("schema_hash")
        ),
        "last_sync_time": F.when(loaded, now).otherwise(F.col("last_sync_time")),
        "error_message": F.when(~loaded, F.col("outcome_message")),
        "updated_at": now,
        "version": F.col("version") + 1,
    }
    legal_rows = joined.where(legal)
    accepted = legal_rows.select(
        *(changed.get(name, F.col(name)).alias(name) for name in state.columns)
    )
    rejected = joined.where(~F.coalesce(legal, F.lit(False))).select(
        *keys, "bootstrap_status", "outcome"
    )
    return accepted, rejected


