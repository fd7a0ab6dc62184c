from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.sources import (
    extraction_mode,
    key_check,
    schema_changed,
    schema_manifest,
    table_profile,
)


def orders(spark, id_type="int"):
    return spark.createDataFrame([(1, "a", None), (2, "b", None)], f"Id {id_type}, Name string, At timestamp_ntz")


def test_key_check_counts_nulls_and_repeats(spark):
    rows = [(1, 1), (1, 2), (2, 1), (2, 1), (None, 1), (None, 1), (3, None)]
    df = spark.createDataFrame(rows, "a int, b int")
    assert tuple(key_check(df, ["a", "b"]).first()) == (False, 3, 1)
    assert tuple(key_check(df.where("a = 1"), ["a", "b"]).first()) == (True, 0, 0)
    assert tuple(key_check(df.where("false"), ["a"]).first()) == (True, 0, 0)


def test_modes(spark):
    keyed, plain = orders(spark), spark.range(5).withColumnRenamed("id", "x")
    big = spark.range(1001).withColumn("x", F.lit(1))
    edge = spark.range(1000).withColumn("x", F.lit(1))
    profile = table_profile(
        {"dbo.keyed": keyed, "dbo.plain": plain, "dbo.big": big, "dbo.edge": edge, "dbo.cdc": big,
         "dbo.wrong": big},
        {"dbo.keyed": ["Id"], "dbo.wrong": ["x"]},
        ["DBO.cdc"],
    )
    modes = {r.table_name: r.mode for r in extraction_mode(profile).collect()}
    assert modes == {
        "dbo.keyed": "CDC",
        "dbo.plain": "SNAP",
        "dbo.big": "BLOCK",
        "dbo.edge": "SNAP",
        "dbo.cdc": "CDC",
        "dbo.wrong": "BLOCK",
    }


def test_manifest(spark):
    row = schema_manifest("dbo.Orders", orders(spark), ["Id"], [["Name"], ["At"]]).first()
    assert row.primary_key == ["Id"]
    assert row.unique_keys == [["Name"]]  # the other one is NULL throughout
    assert row.watermark_column == "At"
    assert [(c.name, c.sqlType, c.ordinalPosition) for c in row.columns] == [
        ("Id", "int", 1),
        ("Name", "nvarchar", 2),
        ("At", "datetime2", 3),
    ]
    assert row.manifest_json.startswith('{"table":"dbo.Orders","columns":[{"name":"Id"')


def test_decimal_details_and_no_watermark(spark):
    df = spark.createDataFrame([], T.StructType([T.StructField("Amount", T.DecimalType(18, 2), False)]))
    row = schema_manifest("t", df).first()
    column = row.columns[0]
    assert (column.sqlType, column.precision, column.scale, column.isNullable) == ("decimal", 18, 2, False)
    assert row.watermark_column is None and row.primary_key == []
    assert "watermarkColumn" not in row.manifest_json


def test_hash_is_stable_and_sees_types(spark):
    first = schema_manifest("dbo.Orders", orders(spark), ["Id"]).first().schema_hash
    again = schema_manifest("dbo.Orders", orders(spark), ["Id"]).first().schema_hash
    wide = schema_manifest("dbo.Orders", orders(spark, "bigint"), ["Id"]).first().schema_hash
    assert first == again != wide
    assert len(first) == 64 and first == first.lower()


def test_changed(spark):
    now = spark.createDataFrame([("a", "X1"), ("b", "x2"), ("c", "x3")], "table_name string, schema_hash string")
    known = spark.createDataFrame([("A", "x1"), ("b", "other")], "table_name string, schema_hash string")
    got = {r.table_name: r.changed for r in schema_changed(now, known).collect()}
    assert got == {"a": False, "b": True, "c": True}


def test_declared_keys_can_be_trusted(spark):
    big = spark.range(1001).withColumn("x", F.lit(1))
    row = table_profile({"t": big, "u": big}, {"t": ["x"]}, verify=False).orderBy("table_name").collect()
    assert [(r.has_unique_key, r.estimated_rows) for r in row] == [(True, 1001), (False, 1001)]


def test_length_of_a_text_column_is_part_of_the_hash(spark):
    def hashed(metadata):
        schema = T.StructType([T.StructField("name", T.StringType(), True, metadata)])
        row = schema_manifest("t", spark.createDataFrame([("x",)], schema)).first()
        return row.schema_hash, row.columns[0].maxLength

    plain, short, long = hashed({}), hashed({"maxLength": 100}), hashed({"maxLength": 200})
    assert (plain[1], short[1], long[1]) == (None, 100, 200)
    assert len({plain[0], short[0], long[0]}) == 3
    assert hashed({"__CHAR_VARCHAR_TYPE_STRING": "varchar(100)"})[0] == short[0]
