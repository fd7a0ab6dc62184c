from datetime import datetime

import pytest

from driftline.functions import local_time
from driftline.sources import change_order, label_changes, map_changes
from driftline.sources.server import change_query, split_predicates

LOW, HIGH = "0x00000027000001E80004", "0x00000027000001F00010"


def test_query_text():
    assert change_query("dbo_Orders", LOW, HIGH) == (
        f"(SELECT * FROM cdc.fn_cdc_get_all_changes_dbo_Orders({LOW}, {HIGH}, N'all update old')) changes"
    )


@pytest.mark.parametrize("name", ["", "a b", "x;drop", "a'b", "dbo.Orders", "é"])
def test_unsafe_names_are_refused(name):
    with pytest.raises(ValueError):
        change_query(name, LOW, HIGH)


def test_unsafe_positions_are_refused():
    with pytest.raises(ValueError):
        change_query("a", "0x00 OR 1=1", HIGH)
    with pytest.raises(ValueError):
        split_predicates(["1"])


def test_splits_adjoin():
    assert split_predicates([]) == ["1 = 1"]
    parts = split_predicates([HIGH, LOW])
    assert parts == [
        f"[__$start_lsn] < {LOW}",
        f"[__$start_lsn] >= {LOW} AND [__$start_lsn] < {HIGH}",
        f"[__$start_lsn] >= {HIGH}",
    ]


def test_server_rows_become_changes(spark):
    raw = bytes.fromhex(LOW[2:])
    rows = spark.createDataFrame(
        [(raw, raw, 4, b"\x01", 7, "new"), (raw, raw, 3, b"\x01", 7, "old")],
        "`__$start_lsn` binary, `__$seqval` binary, `__$operation` int, `__$update_mask` binary, Id int, Name string",
    )
    ts = datetime(2024, 1, 1)
    got = label_changes(change_order(map_changes(rows, "dbo_Orders", local_time(ts))))
    assert got.columns == ["capture_instance", "_lsn", "_seqval", "_op_code", "_ts", "Id", "Name", "_op"]
    assert [tuple(r) for r in got.collect()] == [
        ("dbo_Orders", LOW, LOW, 3, ts, 7, "old", "UO"),
        ("dbo_Orders", LOW, LOW, 4, ts, 7, "new", "UN"),
    ]
