"""Reports over runs, datasets, chunks, events and table states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.labels import duration_text
from driftline.functions.times import millis_between
from driftline.operators.chunks import running_total
from driftline.operators.keyed import salted_lookup
from driftline.session import stage

# List lengths of the reports and the inactivity limit.
RECENT_RUNS = 10
RUN_LIST = 50
INACTIVITY_MINUTES = 10
# Fixed value: datasets of a run up to which one task makes its pages.
WHOLE_RUN = 10_000

# Codes of the events that stop a whole run.
LEASE_CONFLICT = "LEASE_CONFLICT"
DOWNSTREAM_UNAVAILABLE = "DOWNSTREAM_UNAVAILABLE"


def dataset_totals(chunks: DataFrame) -> DataFrame:
    """Rows, chunks and bytes of each dataset, from the chunk table."""
    return chunks.groupBy("dataset_id").agg(
        F.sum("row_count").cast("bigint").alias("row_count"),
        F.count(F.lit(1)).alias("chunk_count"),
        F.sum("compressed_size").cast("bigint").alias("bytes_sent"),
    )


def run_summary(runs: DataFrame, datasets: DataFrame) -> DataFrame:
    """Per run: datasets, committed ones, rows, bytes and duration.

    Datasets are summed per run before the join, so both sides are unique.
    """
    per_run = datasets.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("datasets"),
        F.count_if(F.col("status") == "COMMITTED").alias("committed"),
        F.sum("row_count").cast("bigint").alias("rows"),
        F.sum("bytes_sent").cast("bigint").alias("bytes"),
    )
    numbers = ("datasets", "committed", "rows", "bytes")
    return runs.join(per_run, "batch_id", "left").select(
        "batch_id",
        F.upper("batch_type").alias("batch_type"),
        F.upper("trigger").alias("trigger"),
        F.upper("status").alias("status"),
        "started_at",
        "finished_at",
        *(F.coalesce(name, F.lit(0)).cast("bigint").alias(name) for name in numbers),
        duration_text(F.col("started_at"), F.col("finished_at")).alias("duration"),
    )


def newest_run_duration(runs: DataFrame) -> DataFrame:
    """Duration of the run started last."""
    newest = F.max_by(
        F.struct("batch_id", "started_at", "finished_at"), F.struct("started_at", "batch_id")
    )
    return runs.agg(newest.alias("run")).select(
        "run.batch_id",
        duration_text(F.col("run.started_at"), F.col("run.finished_at")).alias("duration"),
    )


def recent_runs(runs: DataFrame, limit: int = RECENT_RUNS) -> DataFrame:
    """The ``limit`` runs started last, newest first."""
    return runs.orderBy(F.col("started_at").desc(), F.col("batch_id").desc()).limit(limit)


def run_details(runs: DataFrame, datasets: DataFrame) -> DataFrame:
    """Runs with their datasets, one row per dataset; runs without any appear once.

    Kept flat: a run may have any number of datasets. Matched rows come from
    an inner join, which AQE can split on either side.
    """
    details = [name for name in datasets.columns if name != "batch_id"]
    renamed = datasets.select(
        "batch_id", *(F.col(n).alias(f"dataset_{n}" if n in runs.columns else n) for n in details)
    )
    matched = runs.join(renamed, "batch_id")
    empty = runs.join(datasets.select("batch_id").distinct(), "batch_id", "left_anti")
    return matched.unionByName(empty, allowMissingColumns=True)


def run_details_nested(
    runs: DataFrame, datasets: DataFrame, columns: Sequence[str], page_rows: int = 1000, whole_run: int = WHOLE_RUN
) -> DataFrame:
    """Datasets of each run as lists, in pages of ``page_rows`` in dataset order.

    One shape for all runs: ``page`` counts from 0 to ``pages`` - 1, every page
    but the last is full, and a run without datasets has one empty page. No
    list grows without bound: runs of up to ``whole_run`` datasets are cut into
    pages where their rows meet, larger ones are numbered over ranges.
    """
    wanted = datasets.select("batch_id", *dict.fromkeys(["dataset_id", *columns]))
    counts = wanted.groupBy("batch_id").agg(F.count(F.lit(1)).alias("__n"))
    # At most one row per ``whole_run`` datasets.
    large = stage(counts.where((F.col("__n") > whole_run) & F.col("batch_id").isNotNull()).select("batch_id"), "large-runs")
    if large.isEmpty():
        return _whole_pages(runs, wanted, columns, page_rows)
    rest = _whole_pages(
        runs.join(large, "batch_id", "left_anti"), wanted.join(large, "batch_id", "left_anti"), columns, page_rows
    )
    ranged = _ranged_pages(wanted.join(large, "batch_id", "left_semi"), columns, page_rows)
    return rest.unionByName(runs.join(ranged, "batch_id"))


def _entries(columns: Sequence[str]) -> Column:
    """Datasets in order, each with the wanted columns as ``__d``."""
    return F.sort_array(F.collect_list(F.struct("dataset_id", F.struct(*columns).alias("__d"))))


def _whole_pages(runs: DataFrame, wanted: DataFrame, columns: Sequence[str], page_rows: int) -> DataFrame:
    """Pages of runs of which each is one list: one shuffle by run."""
    lists = wanted.groupBy("batch_id").agg(_entries(columns).alias("__all"))
    kind = lists.schema["__all"].dataType
    found = runs.join(lists, "batch_id", "left").withColumn("__all", F.coalesce("__all", F.array().cast(kind)))
    pages = F.greatest(F.lit(1), F.ceil(F.size("__all") / page_rows)).cast("bigint")
    cut = F.transform(
        F.sequence(F.lit(0), (pages - 1).cast("int")),
        lambda page: F.transform(F.slice("__all", page * page_rows + 1, page_rows), lambda entry: entry["__d"]),
    )
    return found.select(*runs.columns, pages.alias("pages"), F.posexplode(cut).alias("page", "datasets")).select(
        *runs.columns, F.col("page").cast("bigint").alias("page"), "pages", "datasets"
    )


def _ranged_pages(wanted: DataFrame, columns: Sequence[str], page_rows: int) -> DataFrame:
    """Pages of runs of any size, numbered over ranges: no run in one task."""
    placed = running_total(
        wanted.withColumn("__one", F.lit(1).cast("bigint")), ["batch_id", "dataset_id"], "__one"
    )
    starts = placed.groupBy("batch_id").agg(
        F.min("size_before").alias("__start"), F.ceil(F.count(F.lit(1)) / page_rows).cast("bigint").alias("pages")
    )
    page = F.floor((F.col("size_before") - F.col("__start")) / page_rows)
    return (
        salted_lookup(placed, starts, ["batch_id"])
        .withColumn("page", page)
        .groupBy("batch_id", "page")
        .agg(
            F.first("pages").alias("pages"),
            F.transform(_entries(columns), lambda entry: entry["__d"]).alias("datasets"),
        )
    )


def run_status(runs: DataFrame, datasets: DataFrame, events: DataFrame) -> DataFrame:
    """Final status of each run from its datasets and events; without any it succeeded.

    A lease conflict aborts the run; an unreachable receiver or any aborted
    dataset fails it.
    """
    failed = datasets.groupBy("batch_id").agg(
        F.bool_or(F.col("status") == "ABORTED").alias("__failed")
    )
    stopped = events.groupBy("batch_id").agg(
        F.bool_or(F.col("code") == LEASE_CONFLICT).alias("__conflict"),
        F.bool_or(F.col("code") == DOWNSTREAM_UNAVAILABLE).alias("__unavailable"),
    )
    no = F.lit(False)
    known = runs.select("batch_id").distinct().join(failed, "batch_id", "left")
    return known.join(stopped, "batch_id", "left").select(
        "batch_id",
        F.when(F.coalesce("__conflict", no), "ABORTED")
        .when(F.coalesce("__unavailable", no) | F.coalesce("__failed", no), "FAILED")
        .otherwise("SUCCEEDED")
        .alias("status"),
    )


def changes_behind(state: DataFrame, feed: DataFrame) -> DataFrame:
    """Changes after the last processed LSN, per capture instance.

    The lowest of these positions is a literal filter on the scan, the rest a
    join of the scan with one row per instance; only counts are shuffled when
    Spark broadcasts that table, as it does with one of usual size.
    """
    last = state.where(F.col("capture_instance").isNotNull()).groupBy("capture_instance").agg(
        F.min(F.coalesce("last_processed_lsn", F.lit(""))).alias("__last")
    )
    # One row: the lowest position of all.
    lowest = last.agg(F.min("__last")).first()[0]
    new = feed.select("capture_instance", "_lsn").where(F.col("_lsn") > (lowest or ""))
    return (
        new.join(last, "capture_instance")
        .where(F.col("_lsn") > F.col("__last"))
        .groupBy("capture_instance")
        .agg(F.count(F.lit(1)).alias("changes_behind"))
    )


def lag_report(state: DataFrame, now: Column, feed: DataFrame | None = None) -> DataFrame:
    """State of each table with its lag in whole minutes and, with ``feed``, in changes."""
    millis = millis_between(F.col("last_sync_time"), now)
    lag = F.when(F.col("last_sync_time").isNull(), F.lit(0)).otherwise(F.floor(millis / 60_000))
    columns = [
        F.concat_ws(".", "table_schema", "table_name").alias("table"),
        F.upper("extraction_mode").alias("mode"),
        F.col("capture_instance").isNotNull().alias("cdc_enabled"),
        F.col("last_processed_lsn").alias("last_lsn"),
        F.upper("bootstrap_status").alias("status"),
        F.col("last_sync_time"),
        lag.cast("bigint").alias("lag_minutes"),
        F.col("error_message"),
    ]
    if feed is not None:
        # Tables without change capture get a key of their own, so that they
        # do not meet in one task.
        own = F.concat(F.lit("table "), F.concat_ws(".", "table_schema", "table_name"))
        behind = changes_behind(state, feed).withColumnRenamed("capture_instance", "__key")
        state = state.withColumn("__key", F.coalesce("capture_instance", own)).join(
            behind, "__key", "left"
        )
        columns.append(F.coalesce("changes_behind", F.lit(0)).cast("bigint").alias("changes_behind"))
    return state.select(*columns)


def superseded_runs(runs: DataFrame) -> DataFrame:
    """Running runs for whose source a newer run exists, and the newest one."""
    newest = (
        runs.groupBy("source")
        .agg(
            F.max(F.struct("started_at", "batch_id")).alias("__newest"),
            F.count(F.lit(1)).alias("__n"),
        )
        .where(F.col("__n") > 1)
        .drop("__n")
    )
    running = runs.where(F.col("status") == "RUNNING").select("source", "batch_id", "started_at")
    return (
        salted_lookup(running, newest, ["source"])
        .where(F.struct("started_at", "batch_id") < F.col("__newest"))
        .select(
            "batch_id",
            "source",
            "started_at",
            F.col("__newest.batch_id").alias("superseded_by"),
        )
    )


def inactive_runs(
    events: DataFrame,
    key: str,
    ts: str,
    now: Column,
    ttl_minutes: int = INACTIVITY_MINUTES,
) -> DataFrame:
    """Keys without any activity for the time limit, and when they were last active."""
    last = events.groupBy(key).agg(F.max(ts).alias("last_activity"))
    return last.where(F.col("last_activity") < now - F.make_dt_interval(mins=F.lit(ttl_minutes)))
