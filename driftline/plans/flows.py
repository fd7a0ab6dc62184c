"""Snapshot and delta runs over all tables of a source.

The plan for all tables is one query, and one Spark job writes the chunks of
all their datasets. Progress moves after publication only. Should the common
job fail, tables run one by one, so that only those at fault fail.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime
from functools import reduce
from threading import Event
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.lsn import ZERO_LSN, canonical_lsn, next_lsn
from driftline.functions.times import local_time
from driftline.operators import ledger
from driftline.operators.chunks import MAX_CHUNK_BYTES, ChunkJob, write_many
from driftline.plans.routing import COMPLETE, GAP_CODE, PENDING, plan_tables, state_transition
from driftline.sources.catalog import (
    SMALL_TABLE_ROWS,
    extraction_mode,
    schema_manifest,
    table_profile,
)
from driftline.sources.changes import (
    DELIVERY_ORDER,
    change_scan,
    label_changes,
    lsn_high,
    retention_purge,
)
from driftline.sources.tables import snapshot_window_scan


@dataclass
class Source:
    """Tables of one source with their keys and change tables, by ``schema.table``.

    Names ignore case. ``floor`` is what ``retention_purge`` recorded; keep one
    wherever changes are purged by other means than :func:`purge`.
    ``instances`` names the capture instance of a table whose change table
    holds several. ``windows`` bounds snapshots: watermark column, start and
    end (either may be None) by table.
    """

    name: str
    tables: Mapping[str, DataFrame]
    changes: Mapping[str, DataFrame] = field(default_factory=dict)
    keys: Mapping[str, Sequence[str]] = field(default_factory=dict)
    floor: DataFrame | None = None
    instances: Mapping[str, str] = field(default_factory=dict)
    windows: Mapping[str, tuple] = field(default_factory=dict)

    def instance(self, table: str) -> str | None:
        """Capture instance of a table: as stated, or the only one in its change table."""
        ct = find(self.changes, table)
        stated = find(self.instances, table)
        if ct is None or stated:
            return stated
        found = [row[0] for row in ct.select("capture_instance").distinct().limit(2).collect()]
        if len(found) > 1:
            raise ValueError(f"{table} has several capture instances; state one in instances")
        return found[0] if found else capture_instance(table)

    def captured(self, table: str, instance: str | None) -> DataFrame:
        """Changes of one capture instance, of all where none is given."""
        ct = find(self.changes, table)
        return ct if instance is None else ct.where(F.col("capture_instance") == instance)

    def high(self, since: str = ZERO_LSN) -> str:
        """Highest position of the source, over all its change tables, read eagerly.

        Looks at changes after ``since`` only, so a run costs what is new and
        not what the retention holds.
        """
        parts = [ct.select("_lsn").where(F.col("_lsn") > since) for ct in self.changes.values()]
        if not parts:
            return since
        return max(since, lsn_high(reduce(DataFrame.unionByName, parts)).first()[0])

    def lows(
        self,
        spark: SparkSession,
        wanted: Mapping[str, str],
        instances: Mapping[str, str] | None = None,
        recorded: DataFrame | None = None,
    ) -> DataFrame:
        """Lowest position available, as far as ``wanted`` needs it.

        ``wanted`` has the next position to read by capture instance. Where a
        purge keeps a floor (``recorded``, or the source's own), that is the
        answer. Else any one change at or before the wanted position shows that
        nothing is missing; failing that it is the first change after it. An
        empty change table without a floor tells nothing: from the start on
        nothing is missing, from any later position the answer is NULL.
        """
        if instances is None:
            instances = {table: capture_instance(table) for table in self.changes}
        floors: dict[str, str] = {}
        for known in (recorded, self.floor):
            if known is not None:
                # One row per tracked table.
                mine = known.where(F.col("capture_instance").isin(list(instances.values())))
                for row in mine.collect():
                    floor = canonical_lsn(row.floor_lsn)
                    floors[row.capture_instance] = max(floor, floors.get(row.capture_instance, floor))
        parts, told = [], []
        for table, instance in instances.items():
            if find(self.changes, table) is None:
                continue
            ct = self.captured(table, instance)
            if instance in floors:
                told.append({"capture_instance": instance, "low_lsn": floors[instance]})
                continue
            start = wanted.get(instance, ZERO_LSN)
            before = ct.select("_lsn").where(F.col("_lsn") <= start).limit(1)
            after = ct.where(F.col("_lsn") > start).agg(F.min("_lsn").alias("_lsn"))
            found = before.unionByName(after)
            empty = ZERO_LSN if start <= next_lsn(ZERO_LSN) else None
            parts.append(
                found.agg(F.coalesce(F.min("_lsn"), F.lit(empty)).alias("low_lsn")).select(
                    F.lit(instance).alias("capture_instance"), "low_lsn"
                )
            )
        # Floors are known without a look at the changes.
        local = ledger.rows_frame(spark, told, "capture_instance string, low_lsn string")
        return reduce(DataFrame.unionByName, parts, local)


def utc_now() -> datetime:
    return datetime.now(UTC).replace(tzinfo=None)


def split_name(table: str) -> tuple[str, str]:
    schema, _, name = table.rpartition(".")
    return schema or "dbo", name


def find(values: Mapping[str, Any], table: str) -> Any:
    """Entry of a table whose name may be spelled in another case, or None."""
    wanted = table.lower()
    return next((value for name, value in values.items() if name.lower() == wanted), None)


def full_name(row: dict) -> str:
    return f"{row['table_schema']}.{row['table_name']}"


def capture_instance(table: str) -> str:
    return "_".join(split_name(table))


def register_tables(
    spark: SparkSession,
    source: Source,
    root: str,
    now: datetime,
    small_table_rows: int = SMALL_TABLE_ROWS,
    verify_keys: bool = True,
) -> dict[str, str]:
    """Start to track the tables of a source, each in the mode its profile suggests.

    Returns the tables that can not be tracked, with the reason.
    """
    profile = extraction_mode(
        table_profile(source.tables, source.keys, source.changes, verify_keys), small_table_rows
    )
    known = {full_name(r.asDict()).lower() for r in ledger.current_states(spark, root).collect()}
    rows, refused = [], {}
    for row in profile.collect():
        if row.table_name.lower() in known:
            continue
        if row["mode"] == "BLOCK":
            refused[row.table_name] = row.reason
            continue
        schema, name = split_name(row.table_name)
        # A keyed table without a change table can only be copied whole.
        tracked = find(source.changes, row.table_name) is not None
        mode = "SNAP" if row["mode"] == "CDC" and not tracked else row["mode"]
        rows.append(
            {
                "table_schema": schema,
                "table_name": name,
                "extraction_mode": mode,
                "bootstrap_status": PENDING,
                "capture_instance": source.instance(row.table_name) if tracked else None,
                "updated_at": now,
                "version": 1,
                "deleted": False,
            }
        )
    if rows:
        ledger.append_rows(spark, root, "table_state", rows)
    return refused


def untrack(spark: SparkSession, root: str, table: str, now: datetime) -> bool:
    """Stop to track a table; whether it was tracked. Its datasets stay readable."""
    states = ledger.current_states(spark, root).where(
        F.lower(F.concat_ws(".", "table_schema", "table_name")) == table.lower()
    )
    rows = [row.asDict() for row in states.collect()]
    for row in rows:
        row |= {"deleted": True, "updated_at": now, "version": row["version"] + 1}
    if rows:
        ledger.append_rows(spark, root, "table_state", rows)
    return bool(rows)


def purge(
    spark: SparkSession,
    source: Source,
    root: str,
    current_minutes: int,
    min_days: int,
    now: datetime,
) -> Source:
    """Drop changes beyond the retention, for all change tables of a source.

    What is left is written below ``root``, one folder per capture instance,
    and the floor of each goes to the ledger that :func:`run` reads. Returns
    the source over the new change tables; the old ones are left alone. The
    floor is recorded first: a crash between the two can only report a gap.
    """
    kept_tables = {}
    for table, ct in source.changes.items():
        before = ledger.recorded_floors(spark, root)
        if source.floor is not None:
            before = before.union(source.floor.select("capture_instance", "floor_lsn")).groupBy(
                "capture_instance"
            ).agg(F.max("floor_lsn").alias("floor_lsn"))
        mine = before.join(ct.select("capture_instance").distinct(), "capture_instance", "left_semi")
        kept, floor = retention_purge(ct, current_minutes, min_days, local_time(now), mine)
        ledger.append(floor.withColumn("recorded_at", local_time(now)), root, "floor")
        folder = f"{root}/changes/{capture_instance(table)}/{uuid.uuid4().hex}"
        ordered = kept.repartitionByRange("capture_instance", "_lsn").sortWithinPartitions("_lsn")
        ordered.write.partitionBy("capture_instance").parquet(folder)
        schema = T.StructType([*(f for f in ct.schema if f.name != "capture_instance"), ct.schema["capture_instance"]])
        kept_tables[table] = spark.read.schema(schema).parquet(folder).select(*ct.columns)
    return replace(source, changes=kept_tables, floor=None)


def new_dataset(run: dict, plan: dict, from_lsn: str | None, to_lsn: str | None, key: str) -> dict:
    return {
        "dataset_id": key,
        "batch_id": run["batch_id"],
        "table_schema": plan["table_schema"],
        "table_name": plan["table_name"],
        "from_lsn": from_lsn,
        "to_lsn": to_lsn,
        "schema_hash": plan.get("manifest_hash"),
        "status": "UPLOADING",
        "row_count": 0,
        "chunk_count": 0,
        "bytes_sent": 0,
        "attempt": uuid.uuid4().hex,
        "version": 1,
    }


def data_folder(root: str, dataset: dict) -> str:
    return f"{root}/data/{dataset['dataset_id']}/{dataset['attempt']}"


def table_of(source: Source, plan: dict) -> DataFrame:
    df = find(source.tables, full_name(plan))
    if df is None:
        raise ledger.DatasetError("TABLE_MISSING", f"the source has no table {full_name(plan)}")
    return df


def _snapshot_job(source: Source, plan: dict, run: dict, root: str) -> tuple[dict, ChunkJob]:
    """The dataset of a whole table and what to write for it."""
    df = table_of(source, plan)
    window = find(source.windows, full_name(plan))
    if window:
        df = snapshot_window_scan(df, *window)
    key = ledger.dataset_id(full_name(plan), f"snapshot {run['batch_id']}", plan["to_lsn"])
    dataset = new_dataset(run, plan, None, None, key)
    return dataset, ChunkJob(df, data_folder(root, dataset), df.columns)


def _delta_job(
    source: Source, plan: dict, run: dict, root: str, simple_ops: bool = False
) -> tuple[dict, ChunkJob]:
    """The dataset of a table's changes in ``[from_lsn, to_lsn]`` and what to write for it."""
    low, high = plan["from_lsn"], plan["to_lsn"]
    columns = table_of(source, plan).columns
    changes = change_scan(source.captured(full_name(plan), plan["capture_instance"]), low, high)
    if "_ts" not in changes.columns:
        changes = changes.withColumn("_ts", local_time(run["started_at"]))
    dataset = new_dataset(run, plan, low, high, ledger.dataset_id(full_name(plan), low, high))
    job = ChunkJob(label_changes(changes, simple_ops), data_folder(root, dataset), columns, True, DELIVERY_ORDER)
    return dataset, job


def snapshot_dataset(
    spark: SparkSession,
    source: Source,
    plan: dict,
    run: dict,
    root: str,
    max_bytes: int = MAX_CHUNK_BYTES,
) -> dict:
    """Copy one table whole and publish it.

    The rows stay where the scan puts them: no shuffle. The run's highest LSN
    was read before, so a change made meanwhile comes again with the next
    delta; none is lost.
    """
    dataset, job = _snapshot_job(source, plan, run, root)
    return ledger.publish(spark, root, run, dataset, write_many([job], max_bytes))


def delta_dataset(
    spark: SparkSession,
    source: Source,
    plan: dict,
    run: dict,
    root: str,
    max_bytes: int = MAX_CHUNK_BYTES,
    simple_ops: bool = False,
) -> dict:
    """Write the changes of one table in ``[from_lsn, to_lsn]`` and publish them."""
    key = ledger.dataset_id(full_name(plan), plan["from_lsn"], plan["to_lsn"])
    earlier = ledger.committed_row(spark, root, key)
    if earlier:
        return earlier
    dataset, job = _delta_job(source, plan, run, root, simple_ops)
    return ledger.publish(spark, root, run, dataset, write_many([job], max_bytes))


def _event(run: dict, plan: dict, code: str, message: str, now: datetime, terminal: bool) -> dict:
    return {
        "occurred_at": now,
        "batch_id": run["batch_id"],
        "scope": "TABLE",
        "table": full_name(plan),
        "severity": "ERROR",
        "code": code,
        "message": message,
        "is_retryable": False,
        "is_terminal": terminal,
    }


def _closed(run: dict, plan: dict, status: str, code: str | None, message: str) -> dict:
    """A dataset that ends without data: skipped or aborted."""
    low, high = plan.get("from_lsn"), plan.get("to_lsn")
    key = ledger.dataset_id(full_name(plan), f"{status} {run['batch_id']}", high or "")
    return {
        **new_dataset(run, plan, low, high, key),
        "status": status,
        "error_code": code,
        "error_message": message,
    }


class _TableJob:
    """Loads one table by itself and records dataset, events and state in that order."""

    def __init__(self, spark, source, root, run, clock, max_bytes, stop: Event):
        self.spark, self.source, self.root, self.run = spark, source, root, run
        self.clock, self.max_bytes, self.stop = clock, max_bytes, stop
        self.conflict = False

    def __call__(self, plan: dict) -> dict | None:
        if self.stop.is_set():
            return None
        try:
            return self._execute(plan)
        except ledger.LeaseConflict as error:
            self.conflict = True
            self.stop.set()
            self._record(_closed(self.run, plan, "ABORTED", "LEASE_CONFLICT", str(error)))
            return None
        except Exception as error:  # one table failing leaves the others running
            code = getattr(error, "code", None) or (
                "DELTA_FAILED" if plan["action"] == "DELTA" else "SNAPSHOT_FAILED"
            )
            return self._guarded(plan, code, f"{code} for table {full_name(plan)}: {_brief(error)}")

    def _guarded(self, plan: dict, code: str, message: str) -> dict | None:
        """Record a failure, unless a later run has taken over."""
        try:
            return self._fail(plan, code, message)
        except ledger.LeaseConflict:
            self.conflict = True
            self.stop.set()
            return None

    def _execute(self, plan: dict) -> dict:
        action = plan["action"]
        make = snapshot_dataset if action == "SNAPSHOT" else delta_dataset
        row = make(self.spark, self.source, plan, self.run, self.root, self.max_bytes)
        self._move(plan, action, plan["to_lsn"], None)
        return row

    def _record(self, row: dict) -> None:
        ledger.append_rows(self.spark, self.root, "dataset_history", [row])

    def _events(self, row: dict) -> None:
        ledger.append_rows(self.spark, self.root, "error_event", [row])

    def _fail(self, plan: dict, code: str, message: str) -> dict:
        row = _closed(self.run, plan, "ABORTED", code, message)
        self._record(row)
        self._events(_event(self.run, plan, code, message, self.clock(), False))
        self._move(plan, "ERROR", None, message)
        return row

    def _move(self, plan: dict, outcome: str, lsn: str | None, message: str | None) -> None:
        if ledger.is_superseded(self.spark, self.root, self.run):
            raise ledger.LeaseConflict(f"run {self.run['batch_id']} was superseded")
        _move_states(self.spark, self.root, [(plan, outcome, lsn, message)], self.clock())


class _AllTables:
    """Runs all tables together: one write, one publication, one move of all states."""

    def __init__(self, spark, source, root, run, clock, max_bytes):
        self.spark, self.source, self.root, self.run = spark, source, root, run
        self.clock, self.max_bytes = clock, max_bytes
        self.conflict = False
        self.rows: list[dict] = []
        self.events: list[dict] = []
        self.moves: list[tuple[dict, str, str | None, str | None]] = []
        # Tables with a dataset to write, and those that were published.
        self.work: list[tuple[dict, dict, ChunkJob]] = []
        self.done: list[dict] = []

    def __call__(self, plans: Sequence[dict], one_by_one: Callable[[list[dict]], list[dict | None]]) -> list[dict]:
        known = ledger.committed_rows(self.spark, self.root, [
            ledger.dataset_id(full_name(p), p["from_lsn"], p["to_lsn"]) for p in plans if p["action"] == "DELTA"
        ])
        for plan in plans:
            self._prepare(plan, known)
        alone: list[dict | None] = []
        try:
            if self.work:
                try:
                    files = write_many([job for _, _, job in self.work], self.max_bytes)
                except Exception:
                    alone = one_by_one([plan for plan, _, _ in self.work])
                else:
                    self._publish(files)
            if self.moves and ledger.is_superseded(self.spark, self.root, self.run):
                raise ledger.LeaseConflict(f"run {self.run['batch_id']} was superseded")
        except ledger.LeaseConflict as error:
            self.conflict = True
            closed = [_closed(self.run, plan, "ABORTED", "LEASE_CONFLICT", str(error)) for plan, _, _ in self.work]
            self._append("dataset_history", [*self.rows, *closed])
            return [row for row in self.rows if row["status"] == "SKIPPED"]
        self._append("dataset_history", self.rows)
        self._append("error_event", self.events)
        self._move()
        return [*self.rows, *self.done, *(row for row in alone if row)]

    def _prepare(self, plan: dict, known: Mapping[str, dict]) -> None:
        action, name = plan["action"], full_name(plan)
        if action == "SKIP":
            self.rows.append(_closed(self.run, plan, "SKIPPED", None, "No new changes available"))
        elif action == "GAP":
            message = (
                f"Change history of {name} starts at {plan['low_lsn']}, "
                f"expected {plan['from_lsn']}; the table will be loaded whole again"
            )
            self.rows.append(_closed(self.run, plan, "ABORTED", GAP_CODE, message))
            self.events.append(_event(self.run, plan, GAP_CODE, message, self.clock(), True))
            self.moves.append((plan, "GAP", None, message))
        elif action in ("BLOCK", "ERROR"):
            self._fail(plan, "TABLE_BLOCKED" if action == "BLOCK" else "DELTA_FAILED", f"{name}: {plan['reason']}")
        else:
            earlier = known.get(ledger.dataset_id(name, plan["from_lsn"], plan["to_lsn"])) if action == "DELTA" else None
            if earlier:
                self.done.append(earlier)
                self.moves.append((plan, action, plan["to_lsn"], None))
                return
            make = _snapshot_job if action == "SNAPSHOT" else _delta_job
            try:
                dataset, job = make(self.source, plan, self.run, self.root)
            except Exception as error:  # one table failing leaves the others running
                self._broken(plan, error)
                return
            if plan["bootstrap_status"] == "REBOOTSTRAP":
                message = f"{name} is loaded whole again after a history gap"
                self.events.append(_event(self.run, plan, GAP_CODE, message, self.clock(), True))
            self.work.append((plan, dataset, job))

    def _publish(self, files: DataFrame) -> None:
        rows = ledger.publish_many(self.spark, self.root, self.run, [dataset for _, dataset, _ in self.work], files)
        for (plan, _, _), row in zip(self.work, rows, strict=True):
            if row["status"] == "COMMITTED":
                self.done.append(row)
                self.moves.append((plan, plan["action"], plan["to_lsn"], None))
            else:
                self._broken(plan, ledger.DatasetError(row["error_code"], row["error_message"]))

    def _broken(self, plan: dict, error: Exception) -> None:
        code = getattr(error, "code", None) or ("DELTA_FAILED" if plan["action"] == "DELTA" else "SNAPSHOT_FAILED")
        self._fail(plan, code, f"{code} for table {full_name(plan)}: {_brief(error)}")

    def _fail(self, plan: dict, code: str, message: str) -> None:
        self.rows.append(_closed(self.run, plan, "ABORTED", code, message))
        self.events.append(_event(self.run, plan, code, message, self.clock(), False))
        self.moves.append((plan, "ERROR", None, message))

    def _append(self, name: str, rows: list[dict]) -> None:
        if rows:
            ledger.append_rows(self.spark, self.root, name, rows)

    def _move(self) -> None:
        if self.moves:
            _move_states(self.spark, self.root, self.moves, self.clock())


def _move_states(
    spark: SparkSession, root: str, moves: Sequence[tuple[dict, str, str | None, str | None]], now: datetime
) -> None:
    """Record what happened to tables: (plan, outcome, position, message) of each."""
    happened = [
        {
            "table_schema": plan["table_schema"],
            "table_name": plan["table_name"],
            "outcome": outcome,
            "outcome_lsn": lsn,
            "outcome_hash": plan.get("manifest_hash"),
            "outcome_message": message,
        }
        for plan, outcome, lsn, message in moves
    ]
    outcomes = ledger.rows_frame(spark, happened, ", ".join(f"{name} string" for name in happened[0]))
    current = ledger.rows_frame(spark, [plan for plan, *_ in moves], ledger.LEDGERS["table_state"])
    accepted, _ = state_transition(current, outcomes, local_time(now))
    ledger.append(accepted, root, "table_state")


def _brief(error: Exception) -> str:
    """Class and first line of an error, without stack traces."""
    lines = [line.strip() for line in str(error).splitlines() if line.strip()]
    return f"{type(error).__name__}: {lines[0][:500]}" if lines else type(error).__name__


def start_run(
    spark: SparkSession, source_name: str, root: str, kind: str, trigger: str, now: datetime
) -> dict:
    """Open a run. It comes after all earlier ones, by (epoch, id), and supersedes them."""
    last = (
        ledger.read_ledger(spark, root, "batch_history")
        .where(F.col("source") == source_name)
        .agg(F.max("epoch"))
        .first()[0]
    )
    epoch = (last or 0) + 1
    row = {
        "batch_id": uuid.uuid4().hex,
        "source": source_name,
        "batch_type": kind,
        "trigger": trigger,
        "status": "RUNNING",
        "started_at": now,
        "epoch": epoch,
        "version": 1,
    }
    ledger.append_rows(spark, root, "batch_history", [row])
    return row


def run(
    spark: SparkSession,
    source: Source,
    root: str,
    kind: str = "DELTA",
    trigger: str = "SCHEDULED",
    clock: Callable[[], datetime] = utc_now,
    max_bytes: int = MAX_CHUNK_BYTES,
    parallel_tables: int = 4,
) -> dict:
    """Run a SNAPSHOT or DELTA over all tracked tables; returns the run's ledger row.

    ``parallel_tables`` counts where the common job fails and tables run one by one.
    """
    current = start_run(spark, source.name, root, kind, trigger, clock())
    try:
        finished = _run_tables(spark, source, root, kind, current, clock, max_bytes, parallel_tables)
    except Exception:
        failed = {**current, "status": "FAILED", "finished_at": clock(), "version": 2}
        ledger.append_rows(spark, root, "batch_history", [failed])
        raise
    ledger.append_rows(spark, root, "batch_history", [finished])
    return finished


def _run_tables(
    spark: SparkSession,
    source: Source,
    root: str,
    kind: str,
    current: dict,
    clock: Callable[[], datetime],
    max_bytes: int,
    parallel_tables: int,
) -> dict:
    """Plan all tables, run each, and sum up the run."""
    # One row per tracked table: the control plane, not the data.
    tracked = [row.asDict() for row in ledger.current_states(spark, root).collect()]
    # A crash between publication and the move of the state must not publish twice.
    ends = {row.table: row.to_lsn for row in ledger.committed_ends(spark, root).collect()}
    for row in tracked:
        end = ends.get(full_name(row).lower())
        if end and row["bootstrap_status"] == COMPLETE:
            row["last_processed_lsn"] = max(end, row["last_processed_lsn"] or ZERO_LSN)
    captured = [row for row in tracked if row["capture_instance"]]
    last = {row["capture_instance"]: row["last_processed_lsn"] or ZERO_LSN for row in captured}
    instances = {full_name(row): row["capture_instance"] for row in captured}
    high = source.high(max(last.values(), default=ZERO_LSN))
    lows = source.lows(
        spark,
        {name: next_lsn(lsn) for name, lsn in last.items()},
        instances,
        ledger.recorded_floors(spark, root),
    )
    states = ledger.rows_frame(spark, tracked, ledger.LEDGERS["table_state"])
    plans = [row.asDict() for row in plan_tables(states, high, lows, kind).collect()]
    wanted = [p for p in plans if find(source.tables, full_name(p)) is not None]
    manifests = [
        schema_manifest(t, find(source.tables, t), find(source.keys, t) or (), verify=False)
        for t in (full_name(p) for p in wanted)
    ]
    if manifests:
        union = reduce(DataFrame.unionByName, manifests)
        hashes = {r.table_name: r.schema_hash for r in union.select("table_name", "schema_hash").collect()}
        ledger.upsert_schemas(union, root, local_time(clock()))
        for plan in wanted:
            plan["manifest_hash"] = hashes[full_name(plan)]
    job = _TableJob(spark, source, root, current, clock, max_bytes, Event())

    def one_by_one(wanted: list[dict]) -> list[dict | None]:
        with ThreadPoolExecutor(max_workers=max(1, parallel_tables)) as pool:
            return list(pool.map(job, wanted))

    together = _AllTables(spark, source, root, current, clock, max_bytes)
    done = together(plans, one_by_one)
    good = [r for r in done if r["status"] in ("COMMITTED", "SKIPPED")]
    if job.conflict or together.conflict:
        status = "ABORTED"
    else:
        status = "SUCCEEDED" if len(good) == len(plans) else "FAILED"
    return {
        **current,
        "status": status,
        "finished_at": clock(),
        "version": 2,
        "tables_total": len(plans),
        "tables_succeeded": len(good),
        "rows": sum(r["row_count"] for r in good),
        "bytes": sum(r["bytes_sent"] for r in good),
    }


__all__ = [
    "COMPLETE",
    "Source",
    "delta_dataset",
    "purge",
    "register_tables",
    "run",
    "snapshot_dataset",
    "start_run",
    "untrack",
]
