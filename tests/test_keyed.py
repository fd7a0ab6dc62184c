import pytest
from pyspark.sql import functions as F

from driftline.operators import keyed_merge, latest_per_key, salted_lookup

SCHEMA = "k int, v string, version int, deleted boolean"


def changes(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_latest_with_a_hot_key(spark):
    rows = [(7, f"v{i}", i, False) for i in range(1000)] + [(k, "x", 1, False) for k in range(2000, 4000)]
    got = latest_per_key(changes(spark, rows), ["k"], "version")
    assert got.columns == ["k", "v", "version", "deleted"]
    assert got.count() == 2001
    assert got.where("k = 7").first().v == "v999"


def test_merge(spark):
    current = spark.createDataFrame([(1, "one"), (2, "two"), (3, None)], "k int, v string")
    rows = [
        (2, "old", 1, False),
        (2, "new", 2, False),
        (3, None, 1, True),
        (4, "four", 1, False),
        (5, "gone", 1, False),
        (5, "gone", 2, True),
        (6, "gone", 1, True),
        (6, "back", 2, False),
        (1, None, 1, False),
    ]
    merged = keyed_merge(current, changes(spark, rows), ["k"], "version")
    assert sorted(map(tuple, merged.collect())) == [(1, None), (2, "new"), (4, "four"), (6, "back")]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_lookup_equals_join(spark, how):
    facts = spark.range(3000).select(
        F.when(F.col("id") < 1000, F.lit(1)).otherwise(F.col("id") % 50).alias("k"), "id"
    )
    lookup = spark.range(0, 40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    got = salted_lookup(facts, lookup, ["k"], how)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(
        map(tuple, facts.join(lookup, "k", how).collect()), key=repr
    )


def test_missing_and_equal_versions(spark):
    rows = [(1, "a", None, False), (1, "b", 1, False), (2, "z", None, False), (3, "p", 4, False), (3, "q", 4, False)]
    got = {r.k: r.v for r in latest_per_key(changes(spark, rows), ["k"], "version").collect()}
    assert got == {1: "b", 2: "z", 3: "q"}
    current = spark.createDataFrame([(1, "one"), (2, "two")], "k int, v string")
    merged = keyed_merge(current, changes(spark, rows), ["k"], "version")
    assert sorted(map(tuple, merged.collect())) == [(1, "b"), (2, "two"), (3, "q")]


def test_few_changes_leave_the_table_in_place(spark, root):
    spark.range(100_000).withColumn("v", F.col("id").cast("string")).write.parquet(root)
    few = spark.createDataFrame([(5, "x", 1, False)], "id bigint, v string, version int, deleted boolean")
    few.write.parquet(f"{root}-few")
    merged = keyed_merge(spark.read.parquet(root), spark.read.parquet(f"{root}-few"), ["id"], "version")
    assert merged.count() == 100_000
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti, BuildRight" in plan and "SortMergeJoin" not in plan
