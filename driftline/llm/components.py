"""Connected components, and all pairs inside groups dealt to tasks in blocks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.operators.keyed import salted_lookup
from driftline.session import stage


def local_components(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of the component of each of ``size`` rows linked by (a, b)."""
    root = np.arange(size)
    while len(a):
        least = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], least)
        np.minimum.at(root, root[b], least)
        root = root[root]
        if np.array_equal(root, before):
            break
    while not np.array_equal(root, root[root]):
        root = root[root]
    return root


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, its smallest reachable node, for all nodes of edges (a, b).

    Alternates two steps until nothing changes: link larger neighbours to the
    smallest one, then link a node and its smaller neighbours to the smallest.
    Every round is written to the shared folder, so a lost executor costs a
    read. Null-free integer ids; loops and repeated edges are ignored.
    """

    def directed(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = stage(directed(edges), "edges")
    seen = state(now)
    while seen[0]:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (
            both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a > b").union(now.join(least, "a").select("a", F.col("m").alias("b")).where("a > b")).distinct()
        )
        large = stage(large, "edges")
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(smallest.select("a", F.col("m").alias("b"))).where("a > b").distinct()
        )
        now = stage(small, "edges")
        before, seen = seen, state(now)
        if before == seen:
            break
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(stars.select("component", "component").distinct())


def in_blocks(members: DataFrame, group: str, node: str, weight: str, most: int) -> DataFrame:
    """Rows of ``members`` for every pair of blocks (``i`` <= ``j``) that they belong to.

    A group is dealt by hash into blocks of about ``most`` weight, so all pairs
    of a group meet in exactly one pair of blocks, and none is larger than two
    blocks. ``side`` tells which of the two a row is in.
    """
    sizes = members.groupBy(group).agg(F.ceil(F.sum(weight) / most).cast("int").alias("__blocks"))
    own = F.pmod(F.xxhash64(node), F.col("__blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1))
    return (
        salted_lookup(members, sizes, [group]).withColumn("__own", own).withColumn("__other", other)
        .withColumn("i", F.least("__own", "__other")).withColumn("j", F.greatest("__own", "__other"))
        .withColumn("side", F.when(F.col("__own") == F.col("i"), 0).otherwise(1))
        .drop("__blocks", "__own", "__other")
    )


def runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """The rows of each run of equal keys in a sorted stream."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(batch.schema.get_field_index(k))) for k in keys]
        change = np.zeros(batch.num_rows - 1, dtype=bool)
        for column in columns:
            change |= column[1:] != column[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(column[start] for column in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(start, stop - start))
    if held:
        yield pa.Table.from_batches(held)
