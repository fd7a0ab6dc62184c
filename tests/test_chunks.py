import gzip
import random
import tracemalloc
from functools import reduce

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftline.functions import row_size
from driftline.operators import closing
from driftline.operators import (
    chunk_assign_greedy,
    chunk_assign_offset,
    chunk_stats,
    running_total,
    write_chunks,
)
from driftline.session import new_folder

COLUMNS = ["Id", "Name", "Amount"]


def items(spark, count):
    rows = [(i, f"Item-{i:04d}-padding-to-increase-size", i * 10.5) for i in range(1, count + 1)]
    return spark.createDataFrame(rows, "Id int, Name string, Amount double")


def close_and_reset(sizes, limit):
    """The sequential rule: close with the row that reaches the limit."""
    numbers, chunk, running = [], 1, 0
    for size in sizes:
        numbers.append(chunk)
        running += size
        if running >= limit:
            chunk, running = chunk + 1, 0
    return numbers


def read_file(path):
    raw = open(path.removeprefix("file://"), "rb").read()
    assert raw[:2] == b"\x1f\x8b"
    return gzip.decompress(raw).decode().splitlines()


def test_no_rows_no_chunks(spark):
    assert write_chunks(items(spark, 0), new_folder(spark, "t"), COLUMNS, 1024).count() == 0


@pytest.mark.parametrize("order_by", [["Id"], None])
def test_few_rows_one_chunk(spark, order_by):
    df = items(spark, 5).coalesce(1)
    files = write_chunks(df, new_folder(spark, "t"), COLUMNS, 1024, order_by=order_by).collect()
    assert [(f.chunk_no, f.row_count) for f in files] == [(1, 5)]
    lines = read_file(files[0].path)
    assert lines[0] == "Id,Name,Amount"
    assert lines[1] == "1,Item-0001-padding-to-increase-size,10.5"
    assert len(lines) == 6


def test_many_rows_follow_the_sequential_rule(spark):
    df = items(spark, 500)
    files = (
        write_chunks(df, new_folder(spark, "t"), COLUMNS, 1024, order_by=["Id"], partitions=1)
        .orderBy("chunk_no")
        .collect()
    )
    sizes = [r.s for r in df.orderBy("Id").select(row_size(df, COLUMNS).alias("s")).collect()]
    numbers = close_and_reset(sizes, 1024)
    assert [f.chunk_no for f in files] == sorted(set(numbers))
    assert [f.row_count for f in files] == [numbers.count(n) for n in sorted(set(numbers))]
    read = []
    for file in files:
        lines = read_file(file.path)
        assert lines[0] == "Id,Name,Amount"
        assert len(lines) - 1 == file.row_count
        assert file.compressed_size == len(open(file.path.removeprefix("file://"), "rb").read())
        read += [int(line.split(",")[0]) for line in lines[1:]]
    assert read == list(range(1, 501))


def test_chunks_of_several_tasks_are_in_order(spark):
    files = (
        write_chunks(
            items(spark, 500), new_folder(spark, "t"), COLUMNS, 1024, order_by=["Id"], partitions=7
        )
        .orderBy("chunk_no")
        .collect()
    )
    assert [f.chunk_no for f in files] == list(range(1, len(files) + 1))
    read = [int(line.split(",")[0]) for f in files for line in read_file(f.path)[1:]]
    assert read == list(range(1, 501))
    assert all(f.estimated_size < 1024 + 64 for f in files)


def test_row_above_the_limit_is_counted(spark):
    df = spark.createDataFrame([(1, "x" * 50), (2, "y" * 5000), (3, "z")], "Id int, Name string")
    files = write_chunks(df, new_folder(spark, "t"), ["Id", "Name"], 1024, order_by=["Id"])
    assert files.agg(F.sum("oversize_rows")).first()[0] == 1
    assert files.agg(F.sum("row_count")).first()[0] == 3


def test_quoted_text_and_line_breaks_are_written_whole(spark):
    df = spark.createDataFrame([(1, 'a "b"\nc,d'), (2, "é𝄞")], "Id int, Name string")
    files = write_chunks(df, new_folder(spark, "t"), ["Id", "Name"], 1024, order_by=["Id"]).collect()
    text = "\n".join(read_file(files[0].path))
    assert text == 'Id,Name\n1,"a ""b""\nc,d"\n2,é𝄞'


def brute_totals(rows):
    before, result = 0, []
    for key, size in rows:
        result.append((key, size, before))
        before += size
    return result


def test_running_total(spark):
    rows = [(i, (i * 7919) % 13) for i in range(2000)]
    df = spark.createDataFrame(rows, "k int, size bigint").repartition(5)
    got = [tuple(r) for r in running_total(df, ["k"], "size", partitions=9).orderBy("k").collect()]
    assert got == brute_totals(rows)


def test_copies_spread_over_ranges(spark):
    """A third of all rows is one row; it must not end up in one range, and all stay."""
    rows = [(i, 3) for i in range(2000)] + [(777, 3)] * 1000
    df = spark.createDataFrame(rows, "k int, size bigint").repartition(5)
    total = running_total(df, ["k"], "size", partitions=8, copies=True)
    assert [tuple(r) for r in total.orderBy("k", "size_before").collect()] == brute_totals(sorted(rows))
    chunks = chunk_assign_offset(df, ["k"], "size", 30, partitions=8, copies=True)
    assert chunk_stats(chunks, "size").agg(F.max("row_count"), F.count("*")).first()[:] == (10, 300)


def test_offset_rule(spark):
    rows = [(i, 50 + (i * 31) % 200) for i in range(1000)]
    df = spark.createDataFrame(rows, "k int, size bigint")
    got = {r.k: r.chunk_no for r in chunk_assign_offset(df, ["k"], "size", 1024).collect()}
    assert got == {k: before // 1024 + 1 for k, _, before in brute_totals(rows)}


@pytest.mark.parametrize("limit", [1, 300, 1024, 10**9])
def test_greedy_rule_in_given_splits(spark, limit):
    rows = [(i, 50 + (i * 31) % 200) for i in range(1000)]
    df = spark.createDataFrame(rows, "k int, size bigint").repartition(6)
    chunks = chunk_assign_greedy(df, ["k"], "size", limit, split=F.floor(F.col("k") / 300))
    got = [r.chunk_no for r in chunks.orderBy("k").collect()]
    wanted, offset = [], 0
    for start in range(0, 1000, 300):
        local = close_and_reset([s for _, s in rows[start : start + 300]], limit)
        wanted += [offset + n for n in local]
        offset += max(local)
    assert got == wanted


@pytest.mark.parametrize("group", [64, 2])
@pytest.mark.parametrize("limit", [1, 7, 1024, 10**9])
def test_greedy_rule_over_the_whole_order(spark, monkeypatch, limit, group):
    """Ranges hand on what they leave open; other columns and null keys come back."""
    from driftline.operators import chunks

    monkeypatch.setattr(chunks, "GROUP", group)
    rows = [(i, None if i == 0 else f"k{i:05d}", [0, 0, 3, 50 + i * 31 % 200, 5000][i * 7 % 5], "x") for i in range(1500)]
    df = spark.createDataFrame(rows, "n int, k string, size int, other string").repartition(6)
    found = chunk_assign_greedy(df, ["k"], "size", limit, partitions=7).orderBy("n").collect()
    assert [r.chunk_no for r in found] == close_and_reset([r[2] for r in rows], limit)
    assert [tuple(r[:4]) for r in found] == rows and [r.oversize_row for r in found] == [r[2] > limit for r in rows]
    assert chunk_assign_greedy(df.limit(0), ["k"], "size", limit).count() == 0


def test_composed_ranges_follow_the_sequential_rule():
    chance = random.Random(1)
    for _ in range(500):
        count, limit = chance.randint(1, 50), chance.choice([1, 2, 5, 10, 30, 100])
        sizes = np.array([chance.choice([0, 1, 3, chance.randint(0, 40)]) for _ in range(count)])
        splits = np.array(sorted(chance.choice([0, 0, 1, 2]) for _ in range(count)))
        cuts = sorted({0, count, *(chance.randint(0, count) for _ in range(5))})
        want, offset = [], 0
        for split in dict.fromkeys(splits.tolist()):
            local = close_and_reset(sizes[splits == split].tolist(), limit)
            want += [offset + n for n in local]
            offset += max(local)
        parts = [closing.Rows(sizes[a:b], splits[a:b], limit) for a, b in zip(cuts, cuts[1:])]
        state, before, got = closing.Open(), 0, []
        for part in parts:
            got += (before + part.numbers(state)).tolist()
            starts, state = closing.Range.unpacked(part.function().packed()).step(state)
            before += starts
        assert got == want
        whole = reduce(closing.Range.then, (part.function() for part in parts))
        assert whole.step(closing.Open()) == (want[-1], state)


def test_ranges_are_measured_and_numbered_in_bounded_memory(monkeypatch):
    """A range of 600,000 rows takes no more than some blocks of them."""
    from types import SimpleNamespace

    from driftline.operators import chunks

    monkeypatch.setattr(chunks, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    count, limit = 600_000, 65_536
    sizes = 50 + np.arange(count) * 31 % 200
    told = []

    def rows(extra=()):
        for start in range(0, count, 10_000):
            stop = start + 10_000
            columns = {"k": np.arange(start, stop), "__size": sizes[start:stop], "__split": np.zeros(10_000, np.int64)}
            columns |= {name: np.full(10_000, value) for name, value in extra}
            yield pa.RecordBatch.from_pydict(columns)

    tracemalloc.start()
    for batch in chunks._measure(limit)(rows()):
        if batch["__function"][0].is_valid:
            told.append(closing.Range.unpacked(batch["__function"][0].as_py()))
    before = (("__part", 3), ("__starts", 5), ("__open_split", 0), ("__open_size", 60_000))
    wanted, place = close_and_reset([60_000, *sizes.tolist()], limit), 0
    for batch in chunks._assign(["k"], limit)(rows(before)):
        assert (np.asarray(batch["chunk_no"]) - 4 == wanted[place + 1 : place + 1 + batch.num_rows]).all()
        place += batch.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert place == count and peak < 60e6
    starts, state = told[0].step(closing.Open(0, 60_000))
    assert len(told) == 1 and starts == wanted[-1] - 1
    assert state.size == sum(sizes[np.array(wanted[1:]) == wanted[-1]])
