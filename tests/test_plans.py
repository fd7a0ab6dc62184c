from datetime import datetime


from driftline.functions import ZERO_LSN, local_time
from driftline.operators.ledger import LEDGERS
from driftline.plans import gap_detect, no_change_skip, plan_tables, state_transition

LAST, NEXT = "0x00000027000001E80003", "0x00000027000001E80004"
HIGH = "0x00000027000001F00010"
LOW, GAP_LOW = "0x00000020000000000001", "0x00000028000000000000"
NOW = datetime(2024, 1, 2)


def states(spark, rows):
    values = [
        ("dbo", name, mode, lsn, status, None, ci, None, None, datetime(2024, 1, 1), 1, False)
        for name, mode, lsn, status, ci in rows
    ]
    return spark.createDataFrame(values, LEDGERS["table_state"])


def lows(spark, rows):
    return spark.createDataFrame(rows, "capture_instance string, low_lsn string")


TABLES = [
    ("delta", "CDC", LAST, "COMPLETE", "c1"),
    ("edge", "CDC", LAST, "COMPLETE", "c2"),
    ("gap", "CDC", LAST, "COMPLETE", "c3"),
    ("seen", "CDC", HIGH, "COMPLETE", "c3"),
    ("again", "CDC", LAST, "REBOOTSTRAP", "c3"),
    ("first", "CDC", None, "PENDING", "c1"),
    ("small", "SNAP", None, "COMPLETE", None),
    ("blocked", "BLOCK", None, "PENDING", None),
    ("bare", "CDC", LAST, "COMPLETE", None),
    ("unknown", "CDC", LAST, "COMPLETE", "nowhere"),
]
LOWS = [("c1", LOW), ("c2", NEXT), ("c3", GAP_LOW)]


def test_routing(spark):
    plan = plan_tables(states(spark, TABLES), HIGH, lows(spark, LOWS))
    got = {r.table_name: (r.action, r.reason) for r in plan.collect()}
    assert got == {
        "delta": ("DELTA", "changes"),
        "edge": ("DELTA", "changes"),
        "gap": ("GAP", "history gap"),
        "seen": ("SKIP", "no new changes"),
        "again": ("SNAPSHOT", "history gap"),
        "first": ("SNAPSHOT", "first load"),
        "small": ("SNAPSHOT", "snapshot on every run"),
        "blocked": ("BLOCK", "no unique key"),
        "bare": ("ERROR", "no capture instance"),
        "unknown": ("ERROR", "unknown capture instance"),
    }
    row = plan.where("table_name = 'delta'").first()
    assert (row.from_lsn, row.to_lsn) == (NEXT, HIGH)


def test_snapshot_run_takes_all_but_blocked(spark):
    plan = plan_tables(states(spark, TABLES), HIGH, lows(spark, LOWS), "SNAPSHOT")
    got = {r.table_name: r.action for r in plan.collect()}
    assert got.pop("blocked") == "BLOCK"
    assert set(got.values()) == {"SNAPSHOT"}


def test_skip_comes_before_gap(spark):
    state, bounds = states(spark, TABLES[:4]), lows(spark, LOWS)
    assert [r.table_name for r in gap_detect(state, HIGH, bounds).collect()] == ["gap"]
    assert [r.table_name for r in no_change_skip(state, HIGH).collect()] == ["seen"]
    # nothing was ever captured: everything is skipped, nothing is missing
    assert no_change_skip(state, ZERO_LSN).count() == 4
    assert gap_detect(state, ZERO_LSN, bounds).count() == 0


def test_last_position_is_skipped(spark):
    state = states(spark, [("end", "CDC", "0x" + "F" * 20, "COMPLETE", "c1")])
    assert plan_tables(state, "0x" + "F" * 20, lows(spark, LOWS)).first().action == "SKIP"


def transition(spark, status, outcome, lsn=HIGH):
    state = states(spark, [("t", "CDC", LAST, status, "c1")])
    outcomes = spark.createDataFrame(
        [("dbo", "t", outcome, lsn, "hash", "why")],
        "table_schema string, table_name string, outcome string, outcome_lsn string, "
        "outcome_hash string, outcome_message string",
    )
    accepted, rejected = state_transition(
        state, outcomes, local_time(NOW)
    )
    return accepted.first(), rejected.count()


def test_legal_transitions(spark):
    for status in ("PENDING", "REBOOTSTRAP", "COMPLETE"):
        row, refused = transition(spark, status, "SNAPSHOT")
        assert (row.bootstrap_status, row.last_processed_lsn, row.schema_hash) == ("COMPLETE", HIGH, "hash")
        assert row.error_message is None and row.last_sync_time == datetime(2024, 1, 2)
        assert row.version == 2 and refused == 0
    row, _ = transition(spark, "COMPLETE", "DELTA")
    assert (row.bootstrap_status, row.last_processed_lsn, row.schema_hash) == ("COMPLETE", HIGH, None)
    row, _ = transition(spark, "COMPLETE", "GAP", None)
    assert (row.bootstrap_status, row.last_processed_lsn, row.error_message) == ("REBOOTSTRAP", LAST, "why")
    row, _ = transition(spark, "PENDING", "ERROR", None)
    assert (row.bootstrap_status, row.last_processed_lsn, row.error_message) == ("PENDING", LAST, "why")


def test_illegal_transitions(spark):
    for status in ("PENDING", "REBOOTSTRAP"):
        for outcome in ("DELTA", "GAP"):
            assert transition(spark, status, outcome) == (None, 1)
    assert transition(spark, "COMPLETE", "NONSENSE") == (None, 1)


def test_zero_position_is_stored_as_null(spark):
    row, _ = transition(spark, "PENDING", "SNAPSHOT", ZERO_LSN)
    assert row.last_processed_lsn is None
