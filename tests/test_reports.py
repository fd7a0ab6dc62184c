from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from driftline.functions import duration_text, level_rank, local_time
from driftline.operators import reports
from driftline.operators import (
    inactive_runs,
    lag_report,
    ledger_check,
    log_fields,
    log_lines,
    log_query,
    newest_run_duration,
    recent_runs,
    run_details,
    run_details_nested,
    run_status,
    run_summary,
    step_check,
    superseded_runs,
)
from driftline.operators.ledger import LEDGERS

START = datetime(2024, 1, 1, 8)
RUNS = "batch_id string, source string, batch_type string, trigger string, status string, started_at timestamp_ntz, finished_at timestamp_ntz"
SETS = "dataset_id string, batch_id string, table_name string, status string, row_count bigint, bytes_sent bigint, error_code string"


def runs(spark):
    return spark.createDataFrame(
        [
            ("r1", "s", "Snapshot", "Manual", "Succeeded", START, START + timedelta(seconds=12, milliseconds=250)),
            ("r2", "s", "Delta", "Scheduled", "RUNNING", START + timedelta(hours=1), None),
            ("r3", "s", "Delta", "Scheduled", "RUNNING", START + timedelta(hours=2), None),
            ("r4", "t", "Delta", "Scheduled", "RUNNING", START, None),
        ],
        RUNS,
    )


def sets(spark):
    return spark.createDataFrame(
        [
            ("d1", "r1", "a", "COMMITTED", 42, 2048, None),
            ("d2", "r1", "b", "ABORTED", 0, 0, "X"),
            ("d3", "r2", "a", "COMMITTED", 1, 10, None),
        ],
        SETS,
    )


@pytest.mark.parametrize(
    "millis,text",
    [
        (0, "0.0s"), (12250, "12.3s"), (12249, "12.2s"), (59949, "59.9s"), (59950, "60.0s"), (59999, "60.0s"),
        (60000, "1.0m"), (63000, "1.1m"), (62999, "1.0m"), (3_600_000, "60.0m"), (None, "In progress"),
    ],
)
def test_durations(spark, millis, text):
    end = None if millis is None else START + timedelta(milliseconds=millis)
    df = spark.createDataFrame([(START, end)], "a timestamp_ntz, b timestamp_ntz")
    assert df.select(duration_text(F.col("a"), F.col("b")).alias("t")).first().t == text


def test_summary_counts(spark):
    rows = {r.batch_id: r for r in run_summary(runs(spark), sets(spark)).collect()}
    one = rows["r1"]
    assert (one.datasets, one.committed, one.rows, one.bytes) == (2, 1, 42, 2048)
    assert (one.batch_type, one.trigger, one.status, one.duration) == ("SNAPSHOT", "MANUAL", "SUCCEEDED", "12.3s")
    assert (rows["r3"].datasets, rows["r3"].duration) == (0, "In progress")


def test_newest_and_recent(spark):
    assert newest_run_duration(runs(spark)).first()[:] == ("r3", "In progress")
    assert [r.batch_id for r in recent_runs(runs(spark), 3).collect()] == ["r3", "r2", "r4"]


def test_details(spark):
    flat = run_details(runs(spark), sets(spark))
    got = sorted((r.batch_id, r.dataset_id or "", r.dataset_status or "") for r in flat.collect())
    assert got == [("r1", "d1", "COMMITTED"), ("r1", "d2", "ABORTED"), ("r2", "d3", "COMMITTED"), ("r3", "", ""), ("r4", "", "")]


def test_large_runs_have_pages(spark):
    many = spark.range(3000).select(
        F.concat(F.lit("d"), "id").alias("dataset_id"),
        F.when(F.col("id") < 1000, "r1").otherwise(F.concat(F.lit("r"), F.col("id") % 3 + 2)).alias("batch_id"),
    )
    nested = run_details_nested(runs(spark), many, ["dataset_id"], page_rows=100).collect()
    found = sorted(d.dataset_id for r in nested for d in r.datasets)
    assert found == sorted(f"d{i}" for i in range(3000))
    assert max(len(r.datasets) for r in nested) < 200
    alone = run_details_nested(runs(spark), sets(spark), ["dataset_id"]).collect()
    assert {(r.batch_id, r.page, tuple(d.dataset_id for d in r.datasets)) for r in alone} == {
        ("r1", 0, ("d1", "d2")), ("r2", 0, ("d3",)), ("r3", 0, ()), ("r4", 0, ())}


def test_final_status(spark):
    events = spark.createDataFrame(
        [("r1", "LEASE_CONFLICT"), ("r5", "DOWNSTREAM_UNAVAILABLE"), ("r2", "OTHER")], "batch_id string, code string"
    )
    known = runs(spark).select("batch_id").union(spark.createDataFrame([("r5",)], "batch_id string"))
    got = {r.batch_id: r.status for r in run_status(known, sets(spark), events).collect()}
    assert got == {"r1": "ABORTED", "r2": "SUCCEEDED", "r3": "SUCCEEDED", "r4": "SUCCEEDED", "r5": "FAILED"}
    alone = run_status(known, sets(spark), events.where("false"))
    assert alone.where("batch_id = 'r1'").first().status == "FAILED"


def test_superseded(spark):
    assert [(r.batch_id, r.superseded_by) for r in superseded_runs(runs(spark)).collect()] == [("r2", "r3")]


def test_inactive(spark):
    now = local_time(START)
    events = spark.createDataFrame(
        [("old", START - timedelta(minutes=11)), ("edge", START - timedelta(minutes=10)),
         ("new", START - timedelta(minutes=20)), ("new", START)], "k string, ts timestamp_ntz")
    assert [r.k for r in inactive_runs(events, "k", "ts", now).collect()] == ["old"]


def test_lag(spark):
    rows = [
        ("dbo", "Orders", "Cdc", "0x00000000000000000005", "Complete", None, "o", START - timedelta(minutes=10, seconds=59), None),
        ("dbo", "Products", "Snap", None, "Pending", None, None, None, "no"),
        ("dbo", "New", "Cdc", None, "Pending", None, "n", None, None),
    ]
    state = spark.createDataFrame([(*r, START, 1, False) for r in rows], LEDGERS["table_state"])
    feed = spark.createDataFrame(
        [("o", f"0x{i:020X}") for i in range(10)] + [("n", f"0x{i:020X}") for i in range(3)],
        "capture_instance string, _lsn string",
    )
    now = local_time(START)
    got = {r.table: (r.mode, r.cdc_enabled, r.lag_minutes, r.changes_behind) for r in lag_report(state, now, feed).collect()}
    assert got == {"dbo.Orders": ("CDC", True, 10, 4), "dbo.Products": ("SNAP", False, 0, 0), "dbo.New": ("CDC", True, 0, 3)}


def test_ledger_rules(spark):
    found = {tuple(r) for r in ledger_check(
        runs(spark).withColumn("status", F.upper("status")),
        spark.createDataFrame(
            [("a", "r1", "t", "UPLOADING", 0, 0, None), ("b", "r2", "t", "UPLOADING", 0, 0, None),
             ("c", "zz", "t", "COMMITTED", 0, 0, None), ("d", "r1", "t", "ABORTED", 0, 0, None),
             ("e", "r1", "t", "SKIPPED", 3, 0, None), ("f", "r1", "t", "WHAT", 0, 0, None)], SETS)).collect()}
    assert found == {
        ("dataset", "a", "open in a finished run"), ("dataset", "c", "no such run"),
        ("dataset", "d", "aborted without code"), ("dataset", "e", "skipped with rows"),
        ("dataset", "f", "unknown status"), ("dataset", "f", "open in a finished run")}


def test_steps(spark):
    history = spark.createDataFrame(
        [("a", 1, "CREATED"), ("a", 2, "UPLOADING"), ("a", 3, "COMMITTED"), ("b", 1, "COMMITTED"), ("b", 2, "UPLOADING")],
        "dataset_id string, version int, status string")
    assert [(r.dataset_id, r.status, r.next_status) for r in step_check(history).collect()] == [("b", "COMMITTED", "UPLOADING")]


def test_level_ranks(spark):
    names = ["dbg", "Information", "warn", "ERR", "Fatal", "other", "verbose", " Error "]
    df = spark.createDataFrame([(n,) for n in names], "v string")
    assert [r.r for r in df.select(level_rank(F.col("v")).alias("r")).collect()] == [0, 1, 2, 3, 4, 1, -1, 3]


def logs(spark):
    return spark.createDataFrame(
        [(START + timedelta(seconds=i), level, f"message {i} Disk") for i, level in
         enumerate(["Error", "Debug", "Warning", "Fatal", "Information", "Error"])],
        "timestamp timestamp_ntz, level string, message string")


def test_log_query(spark):
    got = [r.message for r in log_query(logs(spark), "Warning", n=3).collect()]
    assert got == ["message 2 Disk", "message 3 Disk", "message 5 Disk"]
    assert log_query(logs(spark), "ALL").count() == 6
    assert log_query(logs(spark), "ALL", "  dISK ").count() == 6
    assert log_query(logs(spark), "ALL", "message 1").count() == 1
    assert log_lines(logs(spark)).first().line == "2024-01-01 08:00:00.000 [Error] message 0 Disk"


def test_log_fields(spark):
    df = spark.createDataFrame(
        [(1, '{"BatchId":"b","Table":"dbo.t","Rows":5,"Nested":{"a":1}}'), (2, '{"DatasetId":"d","CorrelationId":"c"}')],
        "id int, j string")
    one, two = log_fields(df, "j").orderBy("id").collect()
    assert (one.batch_id, one.table, one.dataset_id) == ("b", "dbo.t", None)
    assert one.properties == {"Rows": "5", "Nested": '{"a":1}'}
    assert (two.correlation_id, two.dataset_id, two.properties) == ("c", "d", None)


def test_only_large_runs_are_paged_over_ranges(spark, monkeypatch):
    """Pages are the same whichever way; runs of usual size are neither ranged nor salted."""
    runs = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "batch_id string, n int")
    rows = [("a", f"s{i:02d}", i) for i in range(7)] + [("b", "s0", 0), ("d", "s1", 1), ("d", "s0", 0), ("x", "s", 9)]
    sets = spark.createDataFrame(rows, "batch_id string, dataset_id string, row_count int").repartition(3)

    def pages(whole_run):
        found = reports.run_details_nested(runs, sets, ["row_count"], 2, whole_run)
        return found.columns, sorted((r.batch_id, r.n, r.page, r.pages, [d[0] for d in r.datasets]) for r in found.collect())

    wanted = ["batch_id", "n", "page", "pages", "datasets"], [
        ("a", 1, 0, 4, [0, 1]), ("a", 1, 1, 4, [2, 3]), ("a", 1, 2, 4, [4, 5]), ("a", 1, 3, 4, [6]),
        ("b", 2, 0, 1, [0]), ("c", 3, 0, 1, []), ("d", 4, 0, 1, [0, 1]),
    ]
    assert pages(0) == pages(1) == pages(3) == wanted
    monkeypatch.setattr(reports, "running_total", None)
    assert pages(7) == wanted
    assert reports.run_details_nested(runs, sets, ["row_count"], 2).count() == 7
