"""Registered queries that SQL can express."""

import pytest

import __spark_entry__ as contract
from driftline.llm.oracles import ORACLES
from driftline.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    cursor = db.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(tuple, df.select(*names).collect()), key=repr) == sorted(cursor.fetchall(), key=repr)


def test_all_operators_are_registered():
    assert {*QUERIES, "pipeline"} <= set(contract.queries())
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
