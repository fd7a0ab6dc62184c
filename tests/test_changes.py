import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from driftline.functions import ZERO_LSN, local_time
from driftline.sources import (
    change_order,
    change_project,
    change_scan,
    commit_time,
    event_dedup,
    label_changes,
    lsn_high,
    lsn_low,
    lsn_range,
    op_counts,
    retention_purge,
    snapshot_window_scan,
)

SCHEMA = "capture_instance string, _lsn string, _seqval string, _op_code int, _ts timestamp_ntz, Id int"


def at(number):
    return f"0x{number:020X}"


def feed(spark, rows):
    values = [
        (ci, at(lsn), at(seq), op, datetime(2024, 1, day), key) for ci, lsn, seq, op, day, key in rows
    ]
    return spark.createDataFrame(values, SCHEMA)


MIX = [
    ("a", 10, 1, 2, 1, 1),
    ("a", 11, 1, 2, 1, 2),
    ("a", 12, 1, 2, 2, 3),
    ("a", 13, 1, 4, 3, 1),
    ("a", 13, 1, 3, 3, 1),
    ("a", 14, 1, 3, 4, 2),
    ("a", 14, 1, 4, 4, 2),
    ("a", 15, 1, 1, 5, 3),
    ("b", 9, 1, 2, 1, 1),
]


def test_acceptance_mix_of_operations(spark):
    ct = feed(spark, MIX).where("capture_instance = 'a'")
    simple = [r._op for r in label_changes(change_order(ct), simple=True).collect()]
    assert simple == ["I", "I", "I", "U", "U", "D"]
    coded = [r._op for r in label_changes(change_order(ct)).collect()]
    assert coded == ["I", "I", "I", "UO", "UN", "UO", "UN", "D"]
    counts = {(r.capture_instance, r._op): r.changes for r in op_counts(feed(spark, MIX)).collect()}
    assert counts == {("a", "I"): 3, ("a", "UO"): 2, ("a", "UN"): 2, ("a", "D"): 1, ("b", "I"): 1}


def test_unknown_operation_keeps_its_number(spark):
    assert label_changes(feed(spark, [("a", 1, 1, 7, 1, 1)])).first()._op == "7"


def test_closed_range(spark):
    got = [r._lsn for r in change_order(change_scan(feed(spark, MIX), at(11), at(13))).collect()]
    assert got == [at(11), at(12), at(13), at(13)]


def test_any_split_of_the_range_loses_nothing(spark):
    """(0, m] and (m, high] together are (0, high]; repeated and overlapping bounds count once."""
    ct = feed(spark, MIX).where("capture_instance = 'a'")
    schema = "capture_instance string, last_lsn string, to_lsn string"
    for middle in (9, 12, 13, 15):
        rows = []
        for low, high in ((0, middle), (middle, 15)):
            rows += lsn_range(ct, spark.createDataFrame([("a", at(low), at(high))], schema)).collect()
        assert sorted(rows) == sorted(ct.collect())
        many = [("a", at(0), at(middle)), ("a", at(0)[2:].lower(), at(15).lower()), ("a", None, at(middle))]
        others = [(f"x{i}", at(0), at(15)) for i in range(100)]
        for extra in ([], others):
            assert sorted(lsn_range(ct, spark.createDataFrame(many + extra, schema)).collect()) == sorted(ct.collect())
    with pytest.raises(Exception, match="not an LSN"):
        lsn_range(ct, spark.createDataFrame([("a", at(0), "0x12")], schema)).collect()


def test_spellings_of_a_bound(spark):
    ct = feed(spark, MIX)
    want = change_scan(ct, at(11), at(13)).count()
    assert want and change_scan(ct, at(11)[2:].lower(), "0X" + at(13)[2:].lower()).count() == want
    with pytest.raises(ValueError, match="not an LSN"):
        change_scan(ct, "11", at(13))


def test_missing_times_are_kept_and_come_last(spark):
    ct = feed(spark, MIX)
    timeless = ct.withColumn("_ts", F.lit(None).cast(ct.schema["_ts"].dataType))
    assert sorted(event_dedup(ct.unionByName(timeless)).collect()) == sorted(event_dedup(ct).collect())
    assert event_dedup(timeless.unionByName(timeless)).where("Id IS NULL").count() == timeless.where("Id IS NULL").count()
    kept, _ = retention_purge(timeless, 10, 0, F.lit("2030-01-01").cast("timestamp_ntz"))
    assert kept.count() == timeless.count()


def test_range_filters_reach_the_scan(spark, root):
    feed(spark, MIX).write.partitionBy("capture_instance").parquet(root)
    bounds = spark.createDataFrame(
        [("a", at(10), at(12)), ("b", at(1), at(2))],
        "capture_instance string, last_lsn string, to_lsn string",
    )
    stored = spark.read.parquet(root)
    ranged = lsn_range(stored, bounds)
    plan = ranged._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(_lsn," in plan and re.search(r"PartitionFilters: \[[^\]]*capture_instance", plan)
    assert ranged.count() == 2


def test_bounds_of_positions(spark):
    ct = feed(spark, MIX)
    assert lsn_high(ct).first().high_lsn == at(15)
    assert lsn_high(ct.where("false")).first().high_lsn == ZERO_LSN
    floor = spark.createDataFrame(
        [("a", at(12)), ("c", at(30)), ("b", at(2))], "capture_instance string, floor_lsn string"
    )
    lows = {r.capture_instance: r.low_lsn for r in lsn_low(ct, floor).collect()}
    assert lows == {"a": at(12), "b": at(2), "c": at(30)}
    lows = {r.capture_instance: r.low_lsn for r in lsn_low(ct).collect()}
    assert lows == {"a": at(10), "b": at(9)}


def test_system_columns_go(spark):
    ct = feed(spark, MIX).withColumn("__$update_mask", F.lit(1)).withColumn("Name", F.lit("x"))
    assert change_project(ct).columns == ["_lsn", "_seqval", "_ts", "Id", "Name"]
    assert change_project(ct, ["ID"]).columns == ["_lsn", "_seqval", "_ts", "Id"]


def test_commit_time_falls_back_to_one_constant(spark):
    ct = feed(spark, MIX[:2]).drop("_ts")
    times = spark.createDataFrame(
        [(at(10), datetime(2024, 5, 5))], "_lsn string, commit_ts timestamp_ntz"
    )
    default = local_time(datetime(2024, 6, 6))
    got = {r._lsn: r._ts for r in commit_time(ct, times, default).collect()}
    assert got == {at(10): datetime(2024, 5, 5), at(11): datetime(2024, 6, 6)}


def test_copies_collapse_to_the_first_read(spark):
    """A third of all rows are copies of one event."""
    hot = [("a", 99, 1, 2, 3, 5)] * 500 + [("a", 99, 1, 2, 2, 5)]
    rows = hot + [("a", 100 + i, 1, 2, 1, i) for i in range(1000)]
    once = event_dedup(feed(spark, rows).repartition(7))
    assert once.count() == 1001
    assert once.where(F.col("_lsn") == at(99)).first()._ts == datetime(2024, 1, 2)


def test_purge_records_a_floor(spark):
    now = local_time(datetime(2024, 1, 10))
    kept, floor = retention_purge(feed(spark, MIX), 60, 7, now)
    assert sorted(r._lsn for r in kept.collect()) == [at(13)] * 2 + [at(14)] * 2 + [at(15)]
    floors = {r.capture_instance: r.floor_lsn for r in floor.collect()}
    assert floors == {"a": at(13), "b": at(10)}
    earlier = spark.createDataFrame(
        [("a", at(5)), ("b", at(12)), ("c", at(3))], "capture_instance string, floor_lsn string"
    )
    _, carried = retention_purge(feed(spark, MIX), 60, 7, now, earlier)
    floors = {r.capture_instance: r.floor_lsn for r in carried.collect()}
    assert floors == {"a": at(13), "b": at(12), "c": at(3)}
    longer, _ = retention_purge(feed(spark, MIX), 60 * 24 * 365, 7, now)
    assert longer.count() == len(MIX)


def test_window_on_unknown_column(spark):
    import pytest

    with pytest.raises(ValueError):
        snapshot_window_scan(feed(spark, MIX), "nothing; drop table", 1, 2)
    assert snapshot_window_scan(feed(spark, MIX), "id", 2).count() == 5
    assert snapshot_window_scan(feed(spark, MIX), "ID", 1, 2).count() == 4
