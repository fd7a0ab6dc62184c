"""Incremental extraction as a stream over change files."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from driftline.functions.lsn import ZERO_LSN, canonical_lsn, next_lsn
from driftline.operators import ledger
from driftline.operators.chunks import MAX_CHUNK_BYTES, write_chunks
from driftline.plans.flows import (
    capture_instance,
    data_folder,
    new_dataset,
    split_name,
    start_run,
)
from driftline.plans.routing import COMPLETE, GAP_CODE
from driftline.sources.changes import DELIVERY_ORDER, label_changes
from driftline.streaming.dedup import REMEMBER, dedup_stream

# Fixed value: how a stream's run was triggered.
STREAM = "STREAM"


class DeltaStream:
    """A running stream that closes its run in the ledger when it ends."""

    def __init__(self, query: StreamingQuery, close: Callable[[str], None]):
        self._query, self._close = query, close

    def awaitTermination(self, timeout: int | None = None) -> bool | None:  # noqa: N802
        """Wait for the end as the query itself does, then close the run."""
        try:
            ended = self._query.awaitTermination(timeout)
        except Exception:
            self._close("FAILED")
            raise
        if timeout is None or ended:
            self._close("SUCCEEDED")
        return ended

    def stop(self) -> None:
        self._query.stop()
        self._close("FAILED" if self._query.exception() else "SUCCEEDED")

    def __getattr__(self, name: str):
        return getattr(self._query, name)


def stream_delta(
    spark: SparkSession,
    ct_path: str,
    schema: T.StructType,
    root: str,
    table: str,
    columns: Sequence[str],
    checkpoint: str,
    now: datetime,
    max_bytes: int = MAX_CHUNK_BYTES,
    floor_lsn: str | None = None,
    max_files: int | None = None,
    trigger: dict | None = None,
    source: str | None = None,
    remember: str = REMEMBER,
) -> DeltaStream:
    """Publish new change files of one table as datasets, every event once.

    By default takes what is there and ends; a later start continues after it.
    A micro-batch is one dataset whose id follows from the stream and the
    batch number: after a crash the repeated batch finds it committed. Events
    that come again within ``remember`` of their arrival are known to the
    stream's own state. Passed over are also changes that the table had
    processed before the stream's first start, and those up to where delta runs
    have got to by the time of each micro-batch. Each commit moves the table's
    state. With ``source`` the stream is a run of that source: a later run of
    it ends the stream, and starting the stream supersedes an open run.

    With ``floor_lsn`` (lowest position still available) the start fails when
    history between what was processed and the floor is missing; the floors
    that purges record are looked at in each micro-batch. Wait for the end or
    stop it through what is returned: that closes the run.
    """
    table_schema, table_name = split_name(table)
    if floor_lsn:
        _check_gap(spark, root, table, canonical_lsn(floor_lsn))
    run = start_run(spark, source or f"stream {table}", root, "DELTA", STREAM, now)
    plan = {"table_schema": table_schema, "table_name": table_name}
    start = _start(spark, root, table, checkpoint)
    totals = {"tables_total": 1, "tables_succeeded": 1, "rows": 0, "bytes": 0}

    def handle(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        identity = ledger.dataset_id(table, checkpoint, str(number))
        done = ledger.committed_row(session, root, identity)
        if done:
            _move(session, root, table, done["to_lsn"], now)
            return
        new = batch.where(F.col("_lsn") > max(start, _covered(session, root, table)))
        # Reads the position column only.
        ends = new.agg(F.min("_lsn").alias("low"), F.max("_lsn").alias("high")).first()
        if ends.low is None:
            return
        floor = _floor(session, root, table)
        if floor and ends.low >= floor:
            _check_gap(session, root, table, floor)
        dataset = new_dataset(run, plan, ends.low, ends.high, identity)
        files = write_chunks(
            label_changes(new),
            data_folder(root, dataset),
            columns,
            max_bytes,
            service=True,
            order_by=DELIVERY_ORDER,
        )
        row = ledger.publish(session, root, run, dataset, files)
        totals["rows"] += row["row_count"]
        totals["bytes"] += row["bytes_sent"]
        _move(session, root, table, ends.high, now)

    closed = []

    def close(status: str) -> None:
        if not closed:
            closed.append(status)
            good = int(status == "SUCCEEDED")
            row = {**run, **totals, "tables_succeeded": good, "status": status, "finished_at": now, "version": 2}
            ledger.append_rows(spark, root, "batch_history", [row])

    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    query = (
        dedup_stream(reader.parquet(ct_path), remember)
        .writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
    return DeltaStream(query, close)


def _state(spark: SparkSession, root: str, table: str) -> dict | None:
    rows = ledger.current_states(spark, root).where(_of_table(table)).collect()
    return rows[0].asDict() if rows else None


def _start(spark: SparkSession, root: str, table: str, checkpoint: str) -> str:
    """Position after which the stream takes changes: fixed at its first start."""
    known = ledger.read_ledger(spark, root, "stream_start").where(F.col("stream") == checkpoint)
    first = known.agg(F.min("from_lsn")).first()[0]
    if first is None:
        state = _state(spark, root, table) or {}
        first = state.get("last_processed_lsn") or ZERO_LSN
        row = {"stream": checkpoint, "table_name": table, "from_lsn": first}
        ledger.append_rows(spark, root, "stream_start", [row])
    return first


def _move(spark: SparkSession, root: str, table: str, lsn: str, now: datetime) -> None:
    """Advance the table's state; a table met for the first time counts as complete."""
    schema, name = split_name(table)
    state = _state(spark, root, table) or {
        "table_schema": schema,
        "table_name": name,
        "extraction_mode": "CDC",
        "bootstrap_status": COMPLETE,
        "capture_instance": capture_instance(table),
        "version": 0,
        "deleted": False,
    }
    if (state.get("last_processed_lsn") or ZERO_LSN) >= lsn:
        return
    state |= {
        "last_processed_lsn": lsn, "last_sync_time": now, "updated_at": now, "version": state["version"] + 1
    }
    ledger.append_rows(spark, root, "table_state", [state])


def _of_table(table: str):
    return F.lower(F.concat_ws(".", "table_schema", "table_name")) == ".".join(split_name(table)).lower()


def _covered(spark: SparkSession, root: str, table: str) -> str:
    """Where delta runs other than streams have published all changes up to."""
    runs = ledger.current_runs(spark, root).where(F.col("trigger") != STREAM).select("batch_id")
    done = ledger.current_datasets(spark, root).where((F.col("status") == "COMMITTED") & _of_table(table))
    return done.join(runs, "batch_id", "left_semi").agg(F.max("to_lsn")).first()[0] or ZERO_LSN


def _floor(spark: SparkSession, root: str, table: str) -> str | None:
    """The floor that purges recorded for the table's capture instance."""
    instance = (_state(spark, root, table) or {}).get("capture_instance") or capture_instance(table)
    known = ledger.recorded_floors(spark, root).where(F.col("capture_instance") == instance)
    return known.agg(F.max("floor_lsn")).first()[0]


def _check_gap(spark: SparkSession, root: str, table: str, floor_lsn: str) -> None:
    """Changes between what the table has processed and the floor are gone."""
    done = ledger.current_datasets(spark, root).where((F.col("status") == "COMMITTED") & _of_table(table))
    known = [done.agg(F.max("to_lsn")).first()[0], (_state(spark, root, table) or {}).get("last_processed_lsn")]
    processed = max(filter(None, known), default=None)
    if processed and next_lsn(processed) < floor_lsn:
        raise ledger.DatasetError(GAP_CODE, f"history of {table} before {floor_lsn} is gone")
