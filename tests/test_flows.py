"""Runs over several tables on one set of ledgers."""

from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from driftline.operators import ledger, ledger_check, run_status
from driftline.operators.chunks import write_chunks
from driftline.plans import Source, flows, run
from driftline.plans.flows import data_folder, new_dataset, register_tables, start_run
from driftline.session import new_folder
from driftline.streaming import log_stream, stream_delta

CT = "capture_instance string, _lsn string, _seqval string, _op_code int, _ts timestamp_ntz, Id int, Name string"
START = datetime(2024, 1, 1)


def at(number):
    return f"0x{number:020X}"


def change(number, op, key, name):
    return ("dbo_orders", at(number), at(number), op, START + timedelta(minutes=number), key, name)


def clock():
    return datetime(2024, 2, 1)


def source(spark, changes, rows=((1, "a"), (2, 'q"x'), (3, None)), **extra):
    orders = spark.createDataFrame(list(rows), "Id int, Name string")
    tables = {"dbo.orders": orders, **extra}
    return Source(
        "srv/db",
        tables,
        {"dbo.orders": spark.createDataFrame(changes, CT)},
        {"dbo.orders": ["Id"]},
    )


def state(spark, root, table="orders"):
    return ledger.current_states(spark, root).where(F.col("table_name") == table).first()


def go(spark, src, root, kind="DELTA", **options):
    return run(spark, src, root, kind, "MANUAL", clock, **options)


def delivered(spark, root, src):
    rows = ledger.read_committed(
        spark, root, "dbo.orders", src.tables["dbo.orders"].schema, service=True,
        dataset_ids=[r.dataset_id for r in ledger.current_datasets(spark, root)
                     .where("status = 'COMMITTED' and from_lsn is not null").collect()],
    )
    return [(r._op, r._lsn, r.Id) for r in rows.orderBy("_lsn", "_seqval", "_op").collect()]


FIRST = [change(10, 2, 1, "a"), change(11, 2, 2, "b")]
LATER = FIRST + [change(12, 2, 3, "c"), change(13, 3, 1, "a"), change(13, 4, 1, "A"), change(14, 1, 2, "b")]


def test_snapshot_then_deltas(spark, root):
    small = spark.createDataFrame([(1,)], "x int")
    src = source(spark, FIRST, **{"dbo.small": small})
    register_tables(spark, src, root, START)
    assert state(spark, root).bootstrap_status == "PENDING"
    first = go(spark, src, root, "SNAPSHOT")
    assert (first["status"], first["tables_succeeded"], first["rows"]) == ("SUCCEEDED", 2, 4)
    assert state(spark, root).last_processed_lsn == at(11)
    assert len(state(spark, root).schema_hash) == 64

    second = go(spark, source(spark, LATER, **{"dbo.small": small}), root)
    assert (second["status"], second["tables_succeeded"]) == ("SUCCEEDED", 2)
    assert delivered(spark, root, src) == [("I", at(12), 3), ("UN", at(13), 1), ("UO", at(13), 1), ("D", at(14), 2)]
    assert state(spark, root).last_processed_lsn == at(14)
    # a small table is copied again with every run
    assert ledger.committed_chunks(spark, root, "dbo.small").count() == 2

    third = go(spark, source(spark, LATER, **{"dbo.small": small}), root)
    assert third["status"] == "SUCCEEDED"
    skipped = ledger.current_datasets(spark, root).where("status = 'SKIPPED'").collect()
    assert [r.table_name for r in skipped] == ["orders"]
    assert len(delivered(spark, root, src)) == 4
    # manifests are stored when they are new only
    assert ledger.read_ledger(spark, root, "schema_manifest").count() == 2
    assert ledger_check(ledger.current_runs(spark, root), ledger.current_datasets(spark, root)).count() == 0


def test_gap_leads_to_a_new_snapshot(spark, root):
    register_tables(spark, source(spark, FIRST), root, START)
    go(spark, source(spark, FIRST), root, "SNAPSHOT")
    purged = [c for c in LATER if c[1] >= at(14)]
    broken = go(spark, source(spark, purged), root)
    assert broken["status"] == "FAILED"
    row = state(spark, root)
    assert (row.bootstrap_status, row.last_processed_lsn) == ("REBOOTSTRAP", at(11))
    gap = ledger.current_datasets(spark, root).where("status = 'ABORTED'").first()
    assert (gap.error_code, gap.row_count, gap.chunk_count) == ("CDC_GAP_DETECTED", 0, 0)
    event = ledger.read_ledger(spark, root, "error_event").first()
    assert (event.code, event.is_terminal) == ("CDC_GAP_DETECTED", True)

    healed = go(spark, source(spark, purged), root)
    assert (healed["status"], healed["rows"]) == ("SUCCEEDED", 3)
    row = state(spark, root)
    assert (row.bootstrap_status, row.last_processed_lsn, row.error_message) == ("COMPLETE", at(14), None)


def test_purged_empty_table_is_a_gap_by_its_floor(spark, root):
    register_tables(spark, source(spark, FIRST), root, START)
    go(spark, source(spark, FIRST), root, "SNAPSHOT")
    src = source(spark, [])
    other = spark.createDataFrame([change(40, 2, 1, "z")], CT)
    src.changes = {**src.changes, "dbo.other": other.withColumn("capture_instance", F.lit("dbo_other"))}
    src.floor = spark.createDataFrame([("dbo_orders", at(30))], "capture_instance string, floor_lsn string")
    assert go(spark, src, root)["status"] == "FAILED"
    assert state(spark, root).bootstrap_status == "REBOOTSTRAP"


def test_rare_changes_are_no_gap_where_a_floor_is_kept(spark, root):
    """The first change comes long after the snapshot; nothing was purged."""
    def with_floor(changes):
        src = source(spark, changes)
        src.floor = spark.createDataFrame([("dbo_orders", at(0))], "capture_instance string, floor_lsn string")
        other = spark.createDataFrame([change(20, 2, 1, "z")], CT)
        src.changes = {**src.changes, "dbo.other": other.withColumn("capture_instance", F.lit("dbo_other"))}
        return src

    register_tables(spark, with_floor([]), root, START)
    go(spark, with_floor([]), root, "SNAPSHOT")
    assert state(spark, root).last_processed_lsn == at(20)
    result = go(spark, with_floor([change(50, 2, 9, "first")]), root)
    assert (result["status"], result["rows"]) == ("SUCCEEDED", 1)


def test_bounds_read_what_is_new_only(spark, root):
    src = source(spark, LATER)
    assert src.high() == at(14) and src.high(at(12)) == at(14) and src.high(at(90)) == at(90)
    low = {n: src.lows(spark, {"dbo_orders": at(n)}).first().low_lsn for n in (5, 10, 12, 99)}
    assert low[5] == at(10) and all(low[n] <= at(n) for n in (10, 12, 99))
    assert source(spark, []).lows(spark, {}).first().low_lsn == at(0)


def test_one_failing_table_leaves_the_others(spark, root):
    bad = spark.createDataFrame([(1, 0)], "x int, y int").select((F.col("x") / F.col("y")).alias("z"))
    src = source(spark, FIRST, **{"dbo.bad": bad})
    states = [
        {"table_schema": "dbo", "table_name": t, "extraction_mode": m, "bootstrap_status": "PENDING",
         "capture_instance": c, "version": 1, "deleted": False, "updated_at": START}
        for t, m, c in (("orders", "CDC", "dbo_orders"), ("bad", "SNAP", None))
    ]
    ledger.append_rows(spark, root, "table_state", states)
    result = go(spark, src, root)
    assert (result["status"], result["tables_succeeded"]) == ("FAILED", 1)
    assert state(spark, root).bootstrap_status == "COMPLETE"
    row = state(spark, root, "bad")
    assert row.bootstrap_status == "PENDING" and "SNAPSHOT_FAILED" in row.error_message
    datasets = ledger.current_datasets(spark, root)
    assert {(r.table_name, r.status) for r in datasets.collect()} == {("orders", "COMMITTED"), ("bad", "ABORTED")}
    events = ledger.read_ledger(spark, root, "error_event")
    assert run_status(ledger.current_runs(spark, root), datasets, events).first().status == "FAILED"
    assert "\n" not in row.error_message and "at org.apache" not in row.error_message


def test_row_above_the_limit_fails_its_dataset(spark, root):
    src = source(spark, FIRST, rows=[(1, "x" * 500)])
    register_tables(spark, src, root, START)
    assert go(spark, src, root, "SNAPSHOT", max_bytes=100)["status"] == "FAILED"
    assert ledger.current_datasets(spark, root).first().error_code == "ROW_TOO_LARGE"
    assert ledger.committed_chunks(spark, root).count() == 0


def plan(low, high):
    return {"table_schema": "dbo", "table_name": "orders", "from_lsn": at(low), "to_lsn": at(high),
            "capture_instance": "dbo_orders"}


def test_same_range_counts_once_and_old_run_may_not_commit(spark, root):
    src = source(spark, LATER)
    old = start_run(spark, src.name, root, "DELTA", "MANUAL", START)
    new = start_run(spark, src.name, root, "DELTA", "MANUAL", START)
    first = flows.delta_dataset(spark, src, plan(10, 12), new, root)
    again = flows.delta_dataset(spark, src, plan(10, 12), new, root)
    assert first["dataset_id"] == again["dataset_id"] and again["row_count"] == 3
    with pytest.raises(ledger.LeaseConflict):
        flows.delta_dataset(spark, src, plan(13, 14), old, root)
    assert len(delivered(spark, root, src)) == 3
    assert ledger.read_ledger(spark, root, "dataset_history").where("status = 'COMMITTED'").count() == 1


def test_crash_between_chunks_and_commit_is_invisible(spark, root):
    """Chunk rows of an attempt that never committed do not show up later."""
    src = source(spark, LATER)
    current = start_run(spark, src.name, root, "DELTA", "MANUAL", START)
    lost = new_dataset(current, plan(10, 12), at(10), at(12), ledger.dataset_id("dbo.orders", at(10), at(12)))
    files = write_chunks(src.tables["dbo.orders"], data_folder(root, lost), ["Id", "Name"])
    ledger.append(
        files.withColumn("dataset_id", F.lit(lost["dataset_id"])).withColumn("attempt", F.lit(lost["attempt"])),
        root,
        "chunk_manifest",
    )
    assert ledger.committed_chunks(spark, root).count() == 0
    flows.delta_dataset(spark, src, plan(10, 12), current, root)
    assert [key for _, _, key in delivered(spark, root, src)] == [1, 2, 3]


def test_read_back_types(spark, root):
    rows = spark.sql(
        "SELECT 1 AS i, 9999999999 AS l, true AS b, 1.25D AS d, 12.50BD AS n, X'00FF' AS bin, "
        "DATE '2024-02-29' AS day, TIMESTAMP_NTZ '2024-01-01 00:00:07.179575' AS t, "
        "'a \"b\"\nc,d' AS s, CAST(NULL AS STRING) AS gone"
    )
    src = Source("srv/db", {"dbo.kinds": rows})
    current = start_run(spark, src.name, root, "SNAPSHOT", "MANUAL", START)
    one = {"table_schema": "dbo", "table_name": "kinds", "to_lsn": at(0)}
    flows.snapshot_dataset(spark, src, one, current, root)
    back = ledger.read_committed(spark, root, "dbo.kinds", rows.schema).drop("_chunk_file")
    assert back.collect() == rows.collect()


def test_read_back_rows_up_to_the_chunk_limit(spark, root):
    numbers = [3, 3_000_000, 4, 10_485_000, 1_100_000, 5]
    rows = spark.createDataFrame(list(enumerate(numbers)), "Id int, n int").coalesce(1).select(
        "Id", F.expr("repeat(CASE WHEN Id = 1 THEN 'é\"\n,' ELSE 'x' END, IF(Id = 1, n DIV 6, n))").alias("s")
    )
    src = Source("srv/db", {"dbo.long": rows})
    current = start_run(spark, src.name, root, "SNAPSHOT", "MANUAL", START)
    flows.snapshot_dataset(spark, src, {"table_schema": "dbo", "table_name": "long", "to_lsn": at(0)}, current, root)
    back = ledger.read_committed(spark, root, "dbo.long", rows.schema).drop("_chunk_file")
    told = lambda df: sorted(map(tuple, df.select("Id", F.length("s"), F.sha2("s", 256)).collect()))
    assert told(back) == told(rows) and back.count() == len(numbers)


def test_names_ignore_case_and_deleted_tables_go(spark, root):
    base = {"table_schema": "dbo", "extraction_mode": "SNAP", "bootstrap_status": "PENDING", "updated_at": START}
    ledger.append_rows(spark, root, "table_state", [
        {**base, "table_name": "Orders", "version": 1, "deleted": False},
        {**base, "table_name": "ORDERS", "version": 2, "deleted": False},
        {**base, "table_name": "gone", "version": 1, "deleted": False},
        {**base, "table_name": "gone", "version": 2, "deleted": True},
    ])
    assert [r.table_name for r in ledger.current_states(spark, root).collect()] == ["ORDERS"]


def test_empty_ledgers_can_be_read(spark, root):
    assert all(ledger.read_ledger(spark, root, name).count() == 0 for name in ledger.LEDGERS)


def stream(spark, files, schema, root, checkpoint, **options):
    stream_delta(
        spark, files, schema, root, "dbo.orders", ["Id", "Name"], checkpoint, START, **options
    ).awaitTermination()


def test_stream_resumes_and_repeats_nothing(spark, root):
    files, checkpoint = new_folder(spark, "ct"), new_folder(spark, "cp")
    ct = spark.createDataFrame(FIRST, CT)
    ct.write.mode("append").parquet(files)
    src = source(spark, FIRST)
    stream(spark, files, ct.schema, root, checkpoint)
    assert [key for _, _, key in delivered(spark, root, src)] == [1, 2]
    spark.createDataFrame(LATER[2:], CT).write.mode("append").parquet(files)
    for _ in range(2):
        stream(spark, files, ct.schema, root, checkpoint)
    assert [(op, key) for op, _, key in delivered(spark, root, src)] == [
        ("I", 1), ("I", 2), ("I", 3), ("UN", 1), ("UO", 1), ("D", 2)]
    with pytest.raises(ledger.DatasetError):
        stream(spark, files, ct.schema, root, checkpoint, floor_lsn=at(16))
    stream(spark, files, ct.schema, root, checkpoint, floor_lsn=at(15))


def test_stream_and_delta_runs_publish_each_event_once(spark, root):
    """Files that come again across two starts, with a delta run of the same source in between."""
    files, checkpoint = new_folder(spark, "ct"), new_folder(spark, "cp")
    schema = spark.createDataFrame([], CT).schema

    def arrive(changes):
        spark.createDataFrame(changes, CT).coalesce(1).write.mode("append").parquet(files)

    def start():
        stream(spark, files, schema, root, checkpoint, source="srv/db", max_files=1)

    arrive(FIRST)
    arrive(FIRST[:1] + FIRST)
    start()
    assert go(spark, source(spark, LATER[:3]), root)["rows"] == 1
    arrive(LATER)
    last = change(15, 2, 9, "z")
    arrive([*LATER, last])
    arrive([last, *FIRST])
    start()
    start()
    every = delivered(spark, root, source(spark, []))
    assert sorted(key for _, key, _ in every) == sorted(c[1] for c in [*LATER, last])
    assert go(spark, source(spark, [*LATER, last]), root)["rows"] == 0
    runs = {(r.source, r.trigger) for r in ledger.current_runs(spark, root).collect()}
    assert runs == {("srv/db", "STREAM"), ("srv/db", "MANUAL")}


def test_a_later_run_of_the_source_fences_the_stream(spark, root, monkeypatch):
    from driftline.streaming import delta

    files = new_folder(spark, "ct")
    spark.createDataFrame(FIRST, CT).write.parquet(files)
    write = delta.write_chunks

    def taken_over(*args, **options):
        start_run(spark, "srv/db", root, "DELTA", "MANUAL", START)
        return write(*args, **options)

    monkeypatch.setattr(delta, "write_chunks", taken_over)
    with pytest.raises(Exception, match="superseded"):
        stream(spark, files, spark.createDataFrame([], CT).schema, root, new_folder(spark, "cp"), source="srv/db")
    assert delivered(spark, root, source(spark, [])) == []


def test_stream_sees_gaps_from_the_state_and_in_each_batch(spark, root):
    files, checkpoint = new_folder(spark, "ct"), new_folder(spark, "cp")
    register_tables(spark, source(spark, FIRST), root, START)
    go(spark, source(spark, FIRST), root, "SNAPSHOT")
    spark.createDataFrame([change(20, 2, 5, "x")], CT).write.parquet(files)
    schema = spark.createDataFrame([], CT).schema
    with pytest.raises(ledger.DatasetError):  # a snapshot only, its position is in the state
        stream(spark, files, schema, root, checkpoint, floor_lsn=at(15))
    ledger.append_rows(spark, root, "floor", [{"capture_instance": "dbo_orders", "floor_lsn": at(15)}])
    with pytest.raises(Exception, match="history"):
        stream(spark, files, schema, root, checkpoint)
    assert delivered(spark, root, source(spark, [])) == []


def test_stream_batch_committed_before_a_crash_is_not_repeated(spark, root):
    """The checkpoint is lost after the dataset was committed, as in a crash in between."""
    import shutil

    files, checkpoint = new_folder(spark, "ct"), new_folder(spark, "cp")
    ct = spark.createDataFrame(FIRST, CT)
    ct.write.parquet(files)
    stream(spark, files, ct.schema, root, checkpoint)
    shutil.copytree(checkpoint + "/offsets", checkpoint + "-kept")
    import os

    for name in os.listdir(checkpoint + "/commits"):
        os.remove(checkpoint + "/commits/" + name)
    stream(spark, files, ct.schema, root, checkpoint)
    assert [key for _, _, key in delivered(spark, root, source(spark, FIRST))] == [1, 2]
    assert ledger.read_ledger(spark, root, "dataset_history").where("status = 'COMMITTED'").count() == 1


def test_log_stream_filters(spark, root):
    logs = spark.createDataFrame(
        [("Error", "disk full"), ("Debug", "disk ok"), ("FATAL", "Disk gone"), ("Warning", "late")],
        "level string, message string",
    )
    logs.write.parquet(root)
    arriving = spark.readStream.schema(logs.schema).parquet(root)
    query = (
        log_stream(arriving, "err", " DISK ")
        .writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert sorted(r.message for r in spark.table("found").collect()) == ["Disk gone", "disk full"]


def test_commit_once(spark):
    names = "table_name string, from_lsn string, to_lsn string"
    asked = spark.createDataFrame([("a", at(1), at(2))] * 300 + [("A", at(1), at(3)), ("b", at(1), at(2))], names)
    done = spark.createDataFrame([("B", at(1), at(2)), ("b", at(1), at(2))], names)
    got = ledger.commit_once(asked, done).collect()
    assert {(r.table_name, r.to_lsn, r.dataset_id) for r in got} == {
        ("a", at(n), ledger.dataset_id("A", at(1), at(n))) for n in (2, 3)}
    assert len(got) == 2


def test_a_run_that_can_not_plan_ends_failed(spark, root):
    src = source(spark, FIRST)
    register_tables(spark, src, root, START)
    src.changes = {"dbo.orders": src.changes["dbo.orders"].drop("_lsn")}
    with pytest.raises(Exception, match="_lsn"):
        go(spark, src, root)
    row = ledger.current_runs(spark, root).first()
    assert (row.status, row.finished_at) == ("FAILED", clock())


def renamed(spark, changes, name="orders_v2"):
    src = source(spark, changes)
    src.changes = {"DBO.ORDERS": src.changes["dbo.orders"].withColumn("capture_instance", F.lit(name))}
    return src


def test_instance_name_comes_from_the_change_table(spark, root):
    register_tables(spark, renamed(spark, FIRST), root, START)
    assert state(spark, root).capture_instance == "orders_v2"
    go(spark, renamed(spark, FIRST), root, "SNAPSHOT")
    assert go(spark, renamed(spark, LATER), root)["rows"] == 4
    assert len(delivered(spark, root, source(spark, []))) == 4


def test_several_instances_have_to_be_told_apart(spark, root):
    src = renamed(spark, FIRST)
    both = src.changes["DBO.ORDERS"].union(source(spark, FIRST).changes["dbo.orders"])
    src.changes = {"dbo.orders": both}
    with pytest.raises(ValueError, match="several capture instances"):
        register_tables(spark, src, root, START)
    src.instances = {"Dbo.Orders": "orders_v2"}
    register_tables(spark, src, root, START)
    assert state(spark, root).capture_instance == "orders_v2"


def test_crash_before_the_state_moves_publishes_nothing_twice(spark, root):
    register_tables(spark, source(spark, FIRST), root, START)
    go(spark, source(spark, FIRST), root, "SNAPSHOT")
    before = state(spark, root).asDict()
    go(spark, source(spark, LATER), root)
    ledger.append_rows(spark, root, "table_state", [{**before, "version": 50}])
    more = LATER + [change(15, 2, 4, "d")]
    assert go(spark, source(spark, more), root)["rows"] == 1
    got = delivered(spark, root, source(spark, []))
    assert len(got) == len(set(got)) == 5 and state(spark, root).last_processed_lsn == at(15)


def test_runs_opened_at_once_have_one_winner(spark, root):
    first, second = (start_run(spark, "srv/db", root, "DELTA", "MANUAL", START) for _ in range(2))
    second_row = {**second, "epoch": first["epoch"]}
    ledger.append_rows(spark, root, "batch_history", [second_row])
    assert first["batch_id"] != second["batch_id"]
    lost = [ledger.is_superseded(spark, root, r) for r in (first, second)]
    assert lost == [True, False]
    with pytest.raises(ledger.LeaseConflict):
        flows.snapshot_dataset(
            spark, source(spark, FIRST), {"table_schema": "dbo", "table_name": "orders", "to_lsn": at(11)}, first, root
        )
    assert ledger.committed_chunks(spark, root).count() == 0


def test_emptied_table_without_floor_is_an_error(spark, root):
    register_tables(spark, source(spark, FIRST), root, START)
    go(spark, source(spark, FIRST), root, "SNAPSHOT")
    src = source(spark, [])
    other = spark.createDataFrame([change(40, 2, 1, "z")], CT)
    src.changes = {**src.changes, "dbo.other": other.withColumn("capture_instance", F.lit("dbo_other"))}
    assert go(spark, src, root)["status"] == "FAILED"
    assert "unknown change history" in state(spark, root).error_message
    assert state(spark, root).last_processed_lsn == at(11)


def test_purge_keeps_a_floor_that_runs_read(spark, root):
    src = source(spark, LATER)
    register_tables(spark, src, root, START)
    left = flows.purge(spark, src, root, 1, 0, START + timedelta(minutes=14))
    assert [r._lsn for r in left.changes["dbo.orders"].orderBy("_lsn").collect()] == [at(13), at(13), at(14)]
    assert ledger.recorded_floors(spark, root).first().floor_lsn == at(13)
    ledger.append_rows(
        spark, root, "table_state",
        [{**state(spark, root).asDict(), "bootstrap_status": "COMPLETE", "last_processed_lsn": at(10), "version": 9}],
    )
    assert go(spark, left, root)["status"] == "FAILED"
    assert state(spark, root).bootstrap_status == "REBOOTSTRAP"


def test_untracked_and_refused_tables(spark, root):
    many = spark.range(5).withColumn("x", F.lit(1)).drop("id")
    src = source(spark, FIRST, **{"dbo.keyless": many})
    assert list(register_tables(spark, src, root, START, small_table_rows=2)) == ["dbo.keyless"]
    assert state(spark, root, "keyless") is None
    assert flows.untrack(spark, root, "DBO.Orders", START) and state(spark, root) is None
    assert not flows.untrack(spark, root, "dbo.orders", START)


def test_missing_table_says_so(spark, root):
    register_tables(spark, source(spark, FIRST), root, START)
    src = source(spark, FIRST)
    src.tables = {}
    assert go(spark, src, root, "SNAPSHOT")["status"] == "FAILED"
    assert "the source has no table dbo.orders" in state(spark, root).error_message


def test_mixed_datasets_and_new_columns_read_together(spark, root):
    register_tables(spark, source(spark, FIRST), root, START)
    go(spark, source(spark, FIRST), root, "SNAPSHOT")
    go(spark, source(spark, LATER), root)
    wider = source(spark, LATER).tables["dbo.orders"].withColumn("Extra", F.lit("x,\n\"y\""))
    src = source(spark, LATER)
    src.tables = {"dbo.orders": wider}
    go(spark, src, root, "SNAPSHOT")
    rows = ledger.read_committed(spark, root, "dbo.orders", wider.schema, service=True).collect()
    assert sorted((r._op or "", r.Id, r.Extra or "") for r in rows) == sorted(
        [("", i, "") for i in (1, 2, 3)] + [("", i, 'x,\n"y"') for i in (1, 2, 3)]
        + [("I", 3, ""), ("UN", 1, ""), ("UO", 1, ""), ("D", 2, "")]
    )
    plain = ledger.read_committed(spark, root, "dbo.orders", wider.schema)
    assert plain.count() == 10 and "_op" not in plain.columns


def test_stream_closes_its_run_and_moves_the_state(spark, root):
    register_tables(spark, source(spark, FIRST), root, START)
    go(spark, source(spark, FIRST), root, "SNAPSHOT")
    files, checkpoint = new_folder(spark, "ct"), new_folder(spark, "cp")
    spark.createDataFrame(LATER, CT).coalesce(1).write.parquet(files)
    stream_delta(
        spark, files, spark.createDataFrame([], CT).schema, root, "dbo.orders", ["Id", "Name"], checkpoint, START
    ).awaitTermination()
    runs = {r.source: r.status for r in ledger.current_runs(spark, root).collect()}
    assert runs["stream dbo.orders"] == "SUCCEEDED"
    assert state(spark, root).last_processed_lsn == at(14)
    assert len(delivered(spark, root, source(spark, []))) == 4  # those after the snapshot
    assert go(spark, source(spark, LATER), root)["rows"] == 0


def test_compacted_ledger_reads_the_same_from_few_files(spark, root):
    for number in range(12):
        ledger.append_rows(spark, root, "floor", [{"capture_instance": "a", "floor_lsn": at(number)}])
    want = sorted(map(str, ledger.read_ledger(spark, root, "floor").collect()))
    assert ledger.compact(spark, root, "floor") == 12 and ledger.compact(spark, root, "floor") == 0
    ledger.append_rows(spark, root, "floor", [{"capture_instance": "b", "floor_lsn": at(1)}])
    got = ledger.read_ledger(spark, root, "floor")
    assert len(got.inputFiles()) <= 2 and got.count() == 13
    assert ledger.compact(spark, root, "floor") == 1
    again = ledger.read_ledger(spark, root, "floor")
    assert len(again.inputFiles()) == 1
    assert sorted(map(str, again.where("capture_instance = 'a'").collect())) == want
    assert len(ledger._folders(spark, f"{root}/floor", "append-")) == 1
    assert ledger.read_ledger(spark, root, "stream_start").count() == 0


def jobs_of(spark, action):
    """Spark jobs that an action starts."""
    group = f"counted-{id(action)}"
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        result = action()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)), result
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def many(spark, count):
    """A source of ``count`` tables, each with changes of its own."""
    rows = spark.createDataFrame([(1, "a"), (2, 'q"x'), (3, None)], "Id int, Name string")
    tables, changes = {}, {}
    for n in range(count):
        tables[f"dbo.t{n:02d}"] = rows.withColumn("Id", F.col("Id") + n)
        ct = spark.createDataFrame([(f"dbo_t{n:02d}", *c[1:]) for c in LATER], CT)
        changes[f"dbo.t{n:02d}"] = ct.withColumn("Id", F.col("Id") + n)
    floor = spark.createDataFrame([(name.replace(".", "_"), at(1)) for name in tables], "capture_instance string, floor_lsn string")
    return Source("srv/many", tables, changes, {name: ["Id"] for name in tables}, floor)


@pytest.mark.parametrize("kind, by_table", [("SNAPSHOT", 0), ("DELTA", 1)])
def test_jobs_hardly_follow_the_tables(spark, root, kind, by_table):
    """A fixed number for snapshots; delta runs still have one small job for each table."""
    counted = {}
    for count in (2, 12):
        src, own = many(spark, count), f"{root}/{count}"
        register_tables(spark, src, own, START, verify_keys=False)
        if kind == "DELTA":
            go(spark, replace(src, changes={n: ct.where(F.col("_lsn") <= at(10)) for n, ct in src.changes.items()}), own, "SNAPSHOT")
        counted[count], finished = jobs_of(spark, lambda: go(spark, src, own, kind))  # noqa: B023
        assert finished["status"] == "SUCCEEDED" and finished["rows"] == count * (3 if kind == "SNAPSHOT" else 5)
        for n in (0, count - 1):
            name = f"dbo.t{n:02d}"
            ids = [r.dataset_id for r in ledger.current_datasets(spark, own).where(
                f"table_name = 't{n:02d}' AND (from_lsn IS NULL) = {kind == 'SNAPSHOT'}").collect()]
            read = ledger.read_committed(spark, own, name, src.tables[name].schema, service=kind == "DELTA", dataset_ids=ids)
            assert sorted(r.Id - n for r in read.collect()) == ([1, 2, 3] if kind == "SNAPSHOT" else [1, 1, 2, 2, 3])
        states = ledger.current_states(spark, own).collect()
        assert {s.last_processed_lsn for s in states} == {at(14)} and len(states) == count
    # Partitions and with them AQE's stages may differ a little.
    assert counted[12] <= counted[2] + 10 * by_table + 4


def test_one_table_at_fault_leaves_the_others(spark, root):
    """The common job fails with a table that can not be read; the others are loaded."""
    src = many(spark, 3)
    broken = src.tables["dbo.t01"].withColumn("Name", F.raise_error(F.lit("no such page")).cast("string"))
    register_tables(spark, src, root, START, verify_keys=False)
    finished = go(spark, replace(src, tables={**src.tables, "dbo.t01": broken}), root, "SNAPSHOT")
    assert finished["status"] == "FAILED" and finished["tables_succeeded"] == 2 and finished["rows"] == 6
    rows = {r.table_name: (r.status, r.error_code) for r in ledger.current_datasets(spark, root).collect()}
    assert rows == {"t00": ("COMMITTED", None), "t01": ("ABORTED", "SNAPSHOT_FAILED"), "t02": ("COMMITTED", None)}


def test_compaction_that_breaks_off_doubles_nothing(spark, root, monkeypatch):
    def put(*numbers):
        for number in numbers:
            ledger.append_rows(spark, root, "floor", [{"capture_instance": "a", "floor_lsn": at(number)}])

    def seen():
        return sorted(r.floor_lsn for r in ledger.read_ledger(spark, root, "floor").collect())

    def broken(spark, path):
        # What a reader sees while the old folders are still there.
        assert seen() == [at(n) for n in range(8)]
        raise RuntimeError("lost")

    put(0, 1, 2)
    assert ledger.compact(spark, root, "floor") == 3
    put(3, 4, 5, 6, 7)
    with monkeypatch.context() as patched:
        patched.setattr(ledger, "delete_folder", broken)
        with pytest.raises(RuntimeError):
            ledger.compact(spark, root, "floor")
    assert seen() == [at(n) for n in range(8)]
    put(8)
    assert ledger.compact(spark, root, "floor") == 1
    assert seen() == [at(n) for n in range(9)]
    # The folders that were left behind are gone, those of the last one wait.
    assert len(ledger._folders(spark, f"{root}/floor", "append-")) == 1


def test_staged_tables_go_with_their_block(spark):
    import os

    from driftline.operators.chunks import running_total
    from driftline.session import shared_dir, staging

    folder = f"{shared_dir(spark)}/stage".removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    with staging(spark):
        df = spark.range(50).selectExpr("id", "id AS size")
        assert running_total(df, ["id"], "size").agg({"size_before": "max"}).first()[0] == 48 * 49 // 2
        assert set(os.listdir(folder)) > before
    assert set(os.listdir(folder)) == before


def test_flow_queries_write_their_change_tables_once(spark, sf, monkeypatch):
    """Each of the four runs reads what was written; none derives the changes again."""
    from workload import feeds, queries

    made, sources = [], []
    derive = feeds.lineitem_ct
    monkeypatch.setattr(feeds, "lineitem_ct", lambda *of: made.append(of) or derive(*of))
    monkeypatch.setattr(queries.flows, "register_tables", lambda *of: None)
    monkeypatch.setattr(queries, "_run", lambda spark, source, root, kind: sources.append(source))
    monkeypatch.setattr(queries, "_dataset_rows", lambda spark, root: None)
    queries.rebootstrap(spark, sf)
    assert len(made) == 1 and len(sources) == 4
    read = {file for source in sources for file in source.changes["dbo.lineitem"].inputFiles()}
    assert read and not any(file.endswith("/lineitem.parquet") for file in read)
    assert sources[1].changes["dbo.orders"].count() == feeds.orders_ct(spark, sf).where(f"_lsn >= '{queries.HIGH_LSN}'").count()
