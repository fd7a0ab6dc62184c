import csv
import io
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions import csv_field, csv_rows, header_line, row_size, value_text

DOUBLES = [
    (5.0, "5"),
    (0.0, "0"),
    (-2.5, "-2.5"),
    (100.0, "100"),
    (1234567.895, "1234567.895"),
    (123456789.5, "123456789.5"),
    (10000000.0, "10000000"),
    (123456789012345.0, "123456789012345"),
    (1e15, "1E+15"),
    (1.5e16, "1.5E+16"),
    (-1.2345678901234567e20, "-1.2345678901234567E+20"),
    (1e100, "1E+100"),
    (0.001, "0.001"),
    (0.0001, "0.0001"),
    (0.00012345, "0.00012345"),
    (-0.00012345, "-0.00012345"),
    (0.00001, "1E-05"),
    (1.25e-7, "1.25E-07"),
    (-0.0, "-0"),
]


def text_of(spark, value, kind):
    schema = T.StructType([T.StructField("v", kind)])
    df = spark.createDataFrame([(value,)], schema)
    return df.select(value_text(schema["v"]).alias("t")).first().t


@pytest.mark.parametrize("value,text", DOUBLES)
def test_double_text(spark, value, text):
    assert text_of(spark, value, T.DoubleType()) == text


@pytest.mark.parametrize(
    "value,kind,text",
    [
        (1.5, T.FloatType(), "1.5"),
        (1e7, T.FloatType(), "1E+07"),
        (1234567.0, T.FloatType(), "1234567"),
        (float("nan"), T.DoubleType(), "NaN"),
        (Decimal("10.50"), T.DecimalType(10, 2), "10.50"),
        (True, T.BooleanType(), "true"),
        (bytes(range(80)), T.BinaryType(), __import__("base64").b64encode(bytes(range(80))).decode()),
        (datetime(2024, 1, 1, 0, 0, 7, 179575), T.TimestampNTZType(), "2024-01-01T00:00:07.1795750"),
        (datetime(2024, 1, 1), T.TimestampNTZType(), "2024-01-01T00:00:00.0000000"),
        (datetime(2024, 1, 1, 0, 0, 0, 100000), T.TimestampNTZType(), "2024-01-01T00:00:00.1000000"),
        (date(2024, 2, 29), T.DateType(), "2024-02-29T00:00:00.0000000"),
        (7, T.ShortType(), "7"),
        ("as is ", T.StringType(), "as is "),
        (None, T.StringType(), None),
    ],
)
def test_value_text(spark, value, kind, text):
    assert text_of(spark, value, kind) == text


def test_zone_of_session_does_not_move_local_times(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        gap = datetime(2024, 3, 10, 2, 30)
        assert text_of(spark, gap, T.TimestampNTZType()) == "2024-03-10T02:30:00.0000000"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_timestamp_with_zone_has_offset(spark):
    df = spark.sql("SELECT TIMESTAMP '2024-01-01 10:00:00Z' AS v")
    text = df.select(value_text(df.schema["v"]).alias("t")).first().t
    assert text == "2024-01-01T10:00:00.0000000+00:00"


@pytest.mark.parametrize(
    "text,field",
    [
        ("plain", "plain"),
        ("", ""),
        (" led", " led"),
        ("a,b", '"a,b"'),
        ('say "hi"', '"say ""hi"""'),
        ("two\nlines", '"two\nlines"'),
        ("cr\r", '"cr\r"'),
    ],
)
def test_csv_field(spark, text, field):
    df = spark.createDataFrame([(text,)], "v string")
    assert df.select(csv_field(F.col("v")).alias("f")).first().f == field


def test_csv_rows_follow_the_wanted_columns(spark):
    df = spark.createDataFrame([(1, 'x,"y"', None, 2.0)], "Id int, Name string, Gone string, N double")
    line = csv_rows(df, ["name", "ID", "absent", "Gone", "n"]).first().line
    assert line == '"x,""y""",1,,,2'
    assert next(csv.reader(io.StringIO(line))) == ['x,"y"', "1", "", "", "2"]


def test_sizes_agree_and_count_null_as_separator(spark):
    df = spark.createDataFrame([(1, "abc", None)], "Id int, Name string, Gone string")
    # 1 + 3 + 0 characters, three separators, two for the line end
    assert df.select(row_size(df, df.columns).alias("s")).first().s == 9
    assert csv_rows(df, df.columns, size_name="s").first().s == 9


def test_delta_size_and_line(spark):
    df = spark.createDataFrame(
        [("I", "0x" + "0" * 20, "0x" + "1" * 20, datetime(2024, 1, 1), 7)],
        "_op string, _lsn string, _seqval string, _ts timestamp_ntz, Id int",
    )
    assert df.select(row_size(df, ["Id"], service=True).alias("s")).first().s == 1 + 22 + 22 + 30 + 2 + 2
    row = csv_rows(df, ["Id"], service=True, size_name="s").first()
    assert row.s == 79
    assert row.line == f"I,0x{'0' * 20},0x{'1' * 20},2024-01-01T00:00:00.0000000+00:00,7"
    assert header_line(["Id", "a,b"], service=True) == '_op,_lsn,_seqval,_ts,Id,"a,b"'


def test_wide_rows_stay_in_compiled_code(spark):
    fields = ", ".join(f"c{i} double" for i in range(40))
    df = spark.createDataFrame([tuple(i / 8 for i in range(40))], fields)
    assert len(csv_rows(df, df.columns, size_name="s").first().line.split(",")) == 40
