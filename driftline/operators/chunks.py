"""Byte-bounded chunks: assignment, statistics and the gzip CSV writer.

A chunk closes with the row that brings its size up to the limit, so it
overshoots by less than one row. Rows are range-partitioned by their order,
every task works through its own range as a stream of Arrow batches, and only
one number per task (a total or a chunk count) is combined afterwards.
"""

from __future__ import annotations

import posixpath
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.text import csv_rows, header_line
from driftline.operators.closing import BLOCK, Open, Range, Rows
from driftline.session import qualified_uri, stage

# Fixed value: default size limit of a chunk.
MAX_CHUNK_BYTES = 10_485_760
# Ranges whose functions one task composes.
GROUP = 64

CHUNK_FILE_SCHEMA = (
    "job int, part int, part_chunk int, row_count bigint, estimated_size bigint, "
    "compressed_size bigint, oversize_rows bigint, path string"
)


def _ranged(df: DataFrame, order_by: Sequence[str], partitions: int | None) -> DataFrame:
    """Ordered ranges, one per partition.

    Without a number AQE merges small ranges, which keeps their order.
    """
    ranged = (
        df.repartitionByRange(partitions, *order_by)
        if partitions
        else df.repartitionByRange(*order_by)
    )
    return ranged.sortWithinPartitions(*order_by)


def _offsets(totals: DataFrame, group: str, amount: str) -> DataFrame:
    """What all earlier groups add up to. One row per task, not per data row."""
    before = Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        F.col(group), F.coalesce(F.sum(amount).over(before), F.lit(0)).alias("__offset")
    )


def _running_size(size_col: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        total = 0
        for batch in batches:
            sizes = np.asarray(batch.column(batch.schema.get_field_index(size_col)), dtype=np.int64)
            reached = np.cumsum(sizes) + total
            total = int(reached[-1]) if len(reached) else total
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(np.full(len(sizes), part, dtype=np.int32)),
                    pa.array(reached - sizes),
                ],
                names=[*batch.schema.names, "__part", "__before"],
            )

    return run


def _spread_copies(df: DataFrame, order_by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Tell rows apart that ``order_by`` does not, so that ranges can split them.

    The number is staged with its row: once it is written, a repeated task
    can not give it to another one.
    """
    marked = stage(df.withColumn("__copy", F.monotonically_increasing_id()), "copies")
    return marked, [*order_by, "__copy"]


def running_total(
    df: DataFrame,
    order_by: Sequence[str],
    size_col: str,
    partitions: int | None = None,
    copies: bool = False,
) -> DataFrame:
    """Add ``size_before``: the sum of ``size_col`` over all earlier rows.

    One shuffle by range; the ranges are staged so that both the totals and
    the rows see the same ones. ``order_by`` has to identify a row; set
    ``copies`` where it does not, else all rows of one value meet in one range.
    """
    wanted = df.columns
    if copies:
        df, order_by = _spread_copies(df, order_by)
    schema = T.StructType(
        [*df.schema.fields, T.StructField("__part", T.IntegerType()), T.StructField("__before", T.LongType())]
    )
    numbered = stage(
        _ranged(df, order_by, partitions).mapInArrow(_running_size(size_col), schema), "ranges"
    )
    totals = numbered.groupBy("__part").agg(F.sum(size_col).alias("__total"))
    offsets = _offsets(totals, "__part", "__total")
    # One row per range: bounded by the number of shuffle partitions.
    return (
        numbered.join(F.broadcast(offsets), "__part")
        .withColumn("size_before", F.col("__offset") + F.col("__before"))
        .select(*wanted, "size_before")
    )


def _joined_back(df: DataFrame, numbered: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Rows of ``df`` with their ``chunk_no``, found by the columns of the order."""
    if set(df.columns) == set(numbered.columns) - {"chunk_no"}:
        return numbered.select(*df.columns, "chunk_no")
    keys = {name: f"__key{i}" for i, name in enumerate(dict.fromkeys(order_by))}
    found = numbered.select(*(F.col(name).alias(key) for name, key in keys.items()), "chunk_no")
    same = reduce(lambda a, b: a & b, (df[name].eqNullSafe(found[key]) for name, key in keys.items()))
    return df.join(found, same).select(*df.columns, "chunk_no")


def chunk_assign_offset(
    df: DataFrame,
    order_by: Sequence[str],
    size_col: str,
    max_bytes: int = MAX_CHUNK_BYTES,
    partitions: int | None = None,
    copies: bool = False,
) -> DataFrame:
    """Number chunks by ``1 + floor(size before the row / limit)``.

    Order and size alone are ranged and staged; other columns are joined back
    by the order, which has to identify a row. With ``copies`` it need not, and
    all columns are staged.
    """
    narrow = df if copies else df.select(*dict.fromkeys([*order_by, size_col]))
    total = running_total(narrow, order_by, size_col, partitions, copies)
    numbered = total.withColumn("chunk_no", (F.floor(F.col("size_before") / max_bytes) + 1).cast("int")).drop("size_before")
    return _joined_back(df, numbered, order_by)


class _Chunker:
    """Where chunks end: running size, closed and reset at the limit."""

    def __init__(self, max_bytes: int):
        self.max_bytes = max_bytes
        self.running = 0

    def pieces(self, sizes: np.ndarray) -> Iterator[tuple[int, int, bool]]:
        """Yield ``(start, end, closes)`` for consecutive rows of one batch."""
        reached = np.cumsum(sizes)
        start, count = 0, len(sizes)
        while start < count:
            used = int(reached[start - 1]) if start else 0
            wanted = self.max_bytes - self.running + used
            last = int(np.searchsorted(reached, wanted, side="left"))
            if last >= count:
                self.running += int(reached[-1]) - used
                yield start, count, False
                return
            self.running = 0
            yield start, last + 1, True
            start = last + 1


def _state_columns(part: str) -> str:
    return f"{part} bigint, __starts bigint, __open_split bigint, __open_size bigint"


def _walk(rows: Iterator[tuple[int, bytes]], state: Open, starts: int) -> Iterator[tuple]:
    """The state before each function of a run of them."""
    for number, function in rows:
        yield number, starts, state.split, state.size
        more, state = Range.unpacked(function).step(state)
        starts += more


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Functions of a group of ranges as one."""
    group, whole = None, None
    for batch in batches:
        for number, function in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = Range.unpacked(function)
            if number == group:
                whole = whole.then(own)
                continue
            if whole is not None:
                yield _told([(group, whole.packed())], ["__group", "__function"], [pa.int64(), pa.binary()])
            group, whole = number, own
    if whole is not None:
        yield _told([(group, whole.packed())], ["__group", "__function"], [pa.int64(), pa.binary()])


def _told(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _states(functions: DataFrame) -> DataFrame:
    """What stands open before each range: a prefix scan over their functions, in groups.

    Groups compose their functions; one task walks over the groups, of which
    there are ``GROUP`` times fewer than tasks; each group walks over its own.
    """
    grouped = functions.withColumn("__group", F.floor(F.col("__part") / GROUP))
    whole = stage(
        grouped.select("__group", "__function", "__part").repartition("__group").sortWithinPartitions("__group", "__part")
        .mapInArrow(_fold, "__group bigint, __function binary"), "groups",
    )

    def over_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((n, f) for batch in batches for n, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        found = list(_walk(rows, Open(), 0))
        if found:
            yield _told(found, ["__group", "__starts", "__open_split", "__open_size"], [pa.int64()] * 4)

    before = whole.repartition(1).sortWithinPartitions("__group").mapInArrow(over_groups, _state_columns("__group"))

    def over_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, starts = None, Open(), 0
        for batch in batches:
            found = []
            for group, part, function, first, split, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group != current:
                    current, state, starts = group, Open(split, size), first
                found.append((part, starts, state.split, state.size))
                more, state = Range.unpacked(function).step(state)
                starts += more
            yield _told(found, ["__part", "__starts", "__open_split", "__open_size"], [pa.int64()] * 4)

    return (
        grouped.join(before, "__group").select("__group", "__part", "__function", "__starts", "__open_split", "__open_size")
        .repartition("__group").sortWithinPartitions("__group", "__part").mapInArrow(over_ranges, _state_columns("__part"))
    )


def chunk_assign_greedy(
    df: DataFrame,
    order_by: Sequence[str],
    size_col: str,
    max_bytes: int = MAX_CHUNK_BYTES,
    split: Column | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Number chunks by the exact close-and-reset rule over the whole order.

    ``split`` is a whole-number column that grows with the order; a chunk ends
    with its split. The rows are ranged whatever the splits, so one split may
    be the whole table: each range says as a function what it does with the
    chunk that the ranges before it leave open, these are composed, and only
    then rows get their numbers. Order and size alone are staged; other columns
    are joined back by the order, which has to identify a row. A row above the
    limit is flagged ``oversize_row``.
    """
    keys = [*dict.fromkeys(order_by)]
    least = F.lit(-(1 << 63)).cast("bigint")
    narrow = df.select(
        *keys, F.col(size_col).cast("bigint").alias("__size"),
        (F.lit(0).cast("bigint") if split is None else F.coalesce(split.cast("bigint"), least)).alias("__split"),
    )
    fields = [T.StructField(f.name, f.dataType) for f in narrow.schema.fields]
    added = [T.StructField("__part", T.LongType()), T.StructField("__at", T.LongType()), T.StructField("__function", T.BinaryType())]

    ranged = _ranged(narrow, ["__split", *keys], partitions)
    measured = stage(ranged.mapInArrow(_measure(max_bytes), T.StructType([*fields, *added])), "ranges")
    # One row per range: bounded by the number of shuffle partitions.
    states = F.broadcast(_states(measured.where("__function IS NOT NULL").select("__part", "__function")))
    rows = measured.where("__function IS NULL").drop("__function").join(states, "__part")

    numbered = rows.repartition("__part").sortWithinPartitions("__part", "__at").mapInArrow(
        _assign(keys, max_bytes), T.StructType([*fields[: len(keys)], T.StructField("chunk_no", T.IntegerType())])
    )
    return _joined_back(df, numbered, keys).withColumn("oversize_row", F.coalesce(F.col(size_col) > max_bytes, F.lit(False)))


def _measure(max_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Place each row in its range, then tell the function of the range; its last columns are size and split.

    Blocks of rows become functions of their own, so no range is held whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        whole, held, rows, at = None, [], 0, 0
        schema = None

        def composed() -> Range:
            sizes, splits = (np.concatenate(values) for values in zip(*held, strict=True))
            own = Rows(sizes, splits, max_bytes).function()
            return own if whole is None else whole.then(own)

        for wide in batches:
            for start in range(0, wide.num_rows, BLOCK):
                batch = wide.slice(start, BLOCK)
                schema, count = batch.schema, batch.num_rows
                held.append(tuple(np.array(batch.column(i), dtype=np.int64) for i in (len(schema) - 2, len(schema) - 1)))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(np.full(count, part)), pa.array(np.arange(at, at + count)), pa.nulls(count, pa.binary())],
                    names=[*schema.names, "__part", "__at", "__function"],
                )
                at, rows = at + count, rows + count
                if rows >= BLOCK:
                    whole, held, rows = composed(), [], 0
        if held:
            whole = composed()
        if whole is not None:
            yield pa.RecordBatch.from_arrays(
                [*(pa.nulls(1, field.type) for field in schema), pa.array([part]), pa.nulls(1, pa.int64()), pa.array([whole.packed()], pa.binary())],
                names=[*schema.names, "__part", "__at", "__function"],
            )

    return run


def _assign(keys: Sequence[str], max_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Number the rows of a stream sorted by range and place, block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, started = None, Open(), 0
        for piece in _pieces(batches):
            if piece["__part"][0].as_py() != current:
                current, started, split, size = (
                    piece[name][0].as_py() for name in ("__part", "__starts", "__open_split", "__open_size")
                )
                state = Open(split, size)
            rows = Rows(*(np.asarray(piece[name], dtype=np.int64) for name in ("__size", "__split")), max_bytes)
            numbers, state = rows.follow(state)
            yield pa.RecordBatch.from_arrays(
                [*(piece[name] for name in keys), pa.array(started + numbers, pa.int32())], names=[*keys, "chunk_no"]
            )
            started += int(numbers[-1])

    return run


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one ``__part`` each, in order, no more than a block."""
    for batch in batches:
        parts = np.asarray(batch["__part"])
        edges = np.flatnonzero(np.diff(parts)) + 1
        cuts = np.unique(np.r_[edges, np.arange(0, len(parts), BLOCK), len(parts)]).tolist()
        for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(start, stop - start)


def chunk_stats(df: DataFrame, size_col: str = "row_size") -> DataFrame:
    """Rows and estimated size per chunk."""
    return df.groupBy("chunk_no").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum(size_col).cast("bigint").alias("size")
    )


def _text_bytes(column: pa.Array, start: int, end: int) -> memoryview:
    """The bytes of consecutive text values, without copying them."""
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    first = offsets[column.offset + start]
    last = offsets[column.offset + end]
    data = column.buffers()[2]
    return memoryview(b"") if data is None else memoryview(data)[int(first) : int(last)]


@dataclass
class ChunkJob:
    """Rows to write as chunks into a folder; without ``order_by`` they stay where the scan put them."""

    df: DataFrame
    folder: str
    columns: Sequence[str]
    service: bool = False
    order_by: Sequence[str] | None = None


def _write_files(targets: Sequence[tuple[str, str]], max_bytes: int):
    """Stream lines into one gzip file per chunk; one output row per file.

    ``targets`` are folder and header of each job; another job's line ends the
    chunk. File names carry the task attempt: what a lost or repeated attempt
    left behind is in no manifest, so nobody reads it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs

        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        chunker = _Chunker(max_bytes)
        filesystem = sink = packer = current = None
        base, name, chunk, rows, size, oversize, written = "", "", 0, 0, 0, 0, 0
        done: list[tuple] = []

        def put(data) -> None:
            nonlocal written
            packed = packer.compress(data)
            written += len(packed)
            sink.write(packed)

        def close() -> None:
            nonlocal sink, written
            tail = packer.flush()
            written += len(tail)
            sink.write(tail)
            sink.close()
            sink = None
            done.append((current, part, chunk, rows, size, written, oversize, posixpath.join(targets[current][0], name)))

        for batch in batches:
            jobs, lines, column = batch.column(0), batch.column(1), batch.column(2)
            sizes, numbers = np.asarray(column, dtype=np.int64), np.asarray(jobs)
            edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for begin, stop in zip(edges[:-1], edges[1:], strict=True):
                if begin == stop:
                    continue
                if numbers[begin] != current:
                    if sink is not None:
                        close()
                    current, chunk, chunker = int(numbers[begin]), 0, _Chunker(max_bytes)
                    filesystem, base = pafs.FileSystem.from_uri(targets[current][0])
                for start, end, closes in chunker.pieces(sizes[begin:stop]):
                    start, end = begin + start, begin + end
                    if sink is None:
                        chunk, rows, size, oversize, written = chunk + 1, 0, 0, 0, 0
                        name = f"part-{part:06d}-{chunk:06d}-{attempt}.csv.gz"
                        if chunk == 1:
                            filesystem.create_dir(base, recursive=True)
                        sink = filesystem.open_output_stream(posixpath.join(base, name), compression=None)
                        packer = zlib.compressobj(level=6, wbits=31)
                        put((targets[current][1] + "\n").encode("utf-8"))
                    put(_text_bytes(lines, start, end))
                    rows += end - start
                    size += int(sizes[start:end].sum())
                    oversize += int((sizes[start:end] > max_bytes).sum())
                    if closes:
                        close()
            if done:
                yield _file_rows(done)
                done = []
        if sink is not None:
            close()
            yield _file_rows(done)

    return run


def _file_rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [*[pa.int32()] * 3, *[pa.int64()] * 4, pa.string()]
    names = [item.split()[0] for item in CHUNK_FILE_SCHEMA.split(", ")]
    columns = [pa.array(values, type=kind) for values, kind in zip(zip(*rows), types)]
    return pa.RecordBatch.from_arrays(columns, names=names)


def write_many(jobs: Sequence[ChunkJob], max_bytes: int = MAX_CHUNK_BYTES, partitions: int | None = None) -> DataFrame:
    """Write the rows of several jobs as numbered gzip CSV chunks, in one Spark job.

    Jobs with an order have the same one; their lines are range-partitioned
    once, by job and order, so a large job gets many ranges and small ones
    share one. Each task applies the close-and-reset rule to the rows it has of
    each job. Result: ``job`` (its place in ``jobs``), ``chunk_no`` from 1,
    ``row_count``, ``estimated_size``, ``compressed_size``, ``oversize_rows``,
    ``path``; no row for empty jobs.
    """
    spark = jobs[0].df.sparkSession
    targets = [(qualified_uri(spark, job.folder), header_line(job.columns, job.service)) for job in jobs]
    told = ["job", F.concat(F.col("line"), F.lit("\n")).alias("line"), "size"]
    plain, ordered = [], []
    for number, job in enumerate(jobs):
        keep = [*(job.order_by or ())]
        lines = csv_rows(job.df, job.columns, job.service, keep, size_name="size").withColumn("job", F.lit(number))
        if job.order_by:
            ordered.append(lines.select(*(F.col(name).alias(f"__order{i}") for i, name in enumerate(keep)), *told))
        else:
            plain.append(lines.select(*told))
    if ordered:
        order = ["job", *(name for name in ordered[0].columns if name.startswith("__order"))]
        plain.append(_ranged(reduce(DataFrame.unionByName, ordered), order, partitions).select("job", "line", "size"))
    lines = reduce(DataFrame.unionByName, plain)
    # Staged at once: the files are written exactly when this table is.
    files = stage(lines.mapInArrow(_write_files(targets, max_bytes), CHUNK_FILE_SCHEMA), "chunks")
    # One row per job and writing task.
    counts = files.groupBy("job", "part").agg(F.max("part_chunk").alias("__chunks"))
    before = Window.partitionBy("job").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("job", "part", F.coalesce(F.sum("__chunks").over(before), F.lit(0)).alias("__offset"))
    return files.join(offsets, ["job", "part"]).select(
        "job",
        (F.col("__offset") + F.col("part_chunk")).cast("int").alias("chunk_no"),
        "row_count",
        "estimated_size",
        "compressed_size",
        "oversize_rows",
        "path",
    )


def write_chunks(
    df: DataFrame,
    folder: str,
    columns: Sequence[str],
    max_bytes: int = MAX_CHUNK_BYTES,
    service: bool = False,
    order_by: Sequence[str] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Write rows as numbered gzip CSV chunks and return the chunk table.

    ``folder`` is a URI every executor can write to. Without ``order_by`` the
    rows stay where the scan put them and nothing is shuffled; with it they are
    range-partitioned once. Each task applies the close-and-reset rule to its
    own rows. Result: ``chunk_no`` from 1, ``row_count``, ``estimated_size``,
    ``compressed_size``, ``oversize_rows``, ``path``; no row for empty input.
    """
    return write_many([ChunkJob(df, folder, columns, service, order_by)], max_bytes, partitions).drop("job")
