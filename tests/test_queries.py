"""Every registered query against its SQL counterpart."""

import pytest

import __spark_entry__ as contract
from workload.oracles import ORACLES
from workload.queries import QUERIES


def comparable(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    values = [
        tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in rows
    ]
    return sorted(values, key=repr)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf, db, name):
    df = contract.queries()[name](spark, sf)
    cursor = db.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert comparable(df.columns, df.collect()) == comparable(names, cursor.fetchall())


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize(
    "name",
    ["commit_time", "run_summary", "lag_report", "state_transition", "log_lines", "value_text",
     "retention_purge", "inactive_runs", "csv_rows_delta", "snapshot_window_scan", "delta_dataset"],
)
def test_session_zone_changes_nothing(spark, sf, db, name):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        test_query_matches_sql(spark, sf, db, name)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
