import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from driftline.functions import ZERO_LSN, is_lsn, lsn_format, lsn_increment, lsn_parse, lsn_text

GOOD = "0x00000027000001E80003"
BAD = [
    "0x0000002700",
    "0x00000027000001E800030099",
    "ABCD",
    "0xGGGGGGGGGGGGGGGGGGGG",
    "0x00000027ZZ0001E80003",
    "",
    "   ",
    GOOD + "\n",
]


def one(spark, value, expression):
    df = spark.createDataFrame([(value,)], "v string")
    return df.select(expression(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize("text", [GOOD, GOOD[2:], GOOD.lower(), "0X" + GOOD[2:]])
def test_parse_accepts_spellings(spark, text):
    assert one(spark, text, lsn_parse) == bytes.fromhex("00000027000001E80003")
    assert one(spark, text, lsn_text) == GOOD


@pytest.mark.parametrize("text", BAD)
def test_parse_rejects(spark, text):
    assert one(spark, text, lsn_parse) is None
    assert one(spark, text, is_lsn) is False
    with pytest.raises(PySparkException):
        one(spark, text, lambda c: lsn_parse(c, strict=True))


def test_format_round_trip(spark):
    assert one(spark, GOOD, lambda c: lsn_format(lsn_parse(c))) == GOOD
    assert one(spark, ZERO_LSN, lsn_parse) == bytes(10)


def test_order_is_byte_order(spark):
    texts = ["0x00000027000001E80005", "0x00000027000001E80001", "0x80000000000000000000",
             "0x7FFFFFFFFFFFFFFFFFFF", "0x00000027000001E80003"]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    by_text = [r.v for r in df.orderBy("v").collect()]
    by_bytes = [r.v for r in df.orderBy(lsn_parse(F.col("v"))).collect()]
    assert by_text == by_bytes == sorted(texts)


EDGES = [0, 1, 0xFFFF, (1 << 40) - 1, 1 << 40, (1 << 79) - 1, (1 << 80) - 2, (1 << 64) - 1]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, (1 << 80) - 2), min_size=1, max_size=30))
def test_increment_adds_one(spark, numbers):
    numbers = numbers + EDGES
    df = spark.createDataFrame([(f"0x{n:020X}",) for n in numbers], "v string")
    got = {r.v: r.n for r in df.select("v", lsn_increment(F.col("v")).alias("n")).collect()}
    assert got == {f"0x{n:020X}": f"0x{n + 1:020X}" for n in numbers}


def test_last_lsn_has_no_successor(spark):
    assert one(spark, "0x" + "F" * 20, lsn_increment) is None
