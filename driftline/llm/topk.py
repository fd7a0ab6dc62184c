"""Exact top-k by inner product with multi-resolution segment statistics.

A vector is cut into 1, 4 and 16 equal segments; each has a mean and a standard
deviation. For one segment of w components, the inner product is at most
w * (mean * mean + deviation * deviation), which is the lower bound of the
distance in other words. Candidates stream past a block of queries, and each
level, coarse to fine, drops the pairs whose bound is below the query's k-th
best score so far. What is left is scored exactly in integers.

Queries and candidates are split into blocks of fixed size that meet by
equi-join keys; every task holds one query block and streams its candidates.
The best of each task are merged by a ranking per query.

Vectors that are null or empty, hold null or non-finite components, or have a
null key take no part; vectors of different lengths are not compared. Ties go
to the smaller key. A query with fewer than k candidates gets all of them;
without queries or candidates the result is empty. A key that occurs several
times is never its own answer, and its rows answer other queries each. Other
columns are ignored. Components are exact while 256 times them fits 31 bits;
beyond that they are cut off there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = (1, 4, 16)
SCALE = 256
QUERY_BLOCK = 4096
CANDIDATE_BLOCK = 16_384
STRIP = 512


def integers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component, x as double; null if the vector takes no part.

    Whole numbers beyond 64 bits, which no score can be told for, become the
    largest ones.
    """
    usable = vector.isNotNull() & (F.size(vector) > 0) & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    )
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    return F.when(usable, scaled)


def _levels(vectors: np.ndarray) -> list[np.ndarray]:
    """Per level the features whose inner product bounds that of the vectors."""
    features = []
    for parts in LEVELS:
        edges = np.unique(np.linspace(0, vectors.shape[1], parts + 1).astype(int))
        columns = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            part = vectors[:, a:b]
            columns += [part.mean(axis=1) * np.sqrt(b - a), part.std(axis=1) * np.sqrt(b - a)]
        features.append(np.stack(columns, axis=1))
    return features


class _Best:
    """The k best candidates of each query of a block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors.astype(np.float64), k
        self.whole = vectors
        self.levels = _levels(self.vectors)
        self.sizes = np.sqrt(np.einsum("ij,ij->i", self.vectors, self.vectors))
        self.owner = np.zeros(0, np.int64)
        self.score = np.zeros(0, np.int64)
        self.candidate = np.zeros(0, np.int64)
        self.least = np.full(len(ids), -np.inf)
        self.largest = float(np.abs(self.vectors).max(initial=0))

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        exact = vectors.astype(np.float64)
        sizes, other_sizes = self.sizes, np.sqrt(np.einsum("ij,ij->i", exact, exact))
        queries, candidates = np.arange(len(self.ids)), np.arange(len(ids))
        alive = np.ones((len(self.ids), len(ids)), dtype=bool)
        for own, other in zip(self.levels, _levels(exact), strict=True):
            bound = own[queries] @ other[candidates].T
            # Rounding follows the terms, not their sum.
            bound += 1e-9 * (1 + sizes[queries, None] * other_sizes[candidates])
            alive &= bound >= self.least[queries, None]
            rows, columns = alive.any(axis=1), alive.any(axis=0)
            alive, queries, candidates = alive[rows][:, columns], queries[rows], candidates[columns]
            if not alive.size:
                return
        at, to = np.nonzero(alive)
        at, to = queries[at], candidates[to]
        if self.largest * float(np.abs(exact).max(initial=0)) * exact.shape[1] < 2**53:
            if len(at) > alive.size // 16:
                score = (self.vectors[queries] @ exact[candidates].T)[alive].astype(np.int64)
            else:
                score = np.einsum("ij,ij->i", self.vectors[at], exact[to]).astype(np.int64)
        else:
            # Whole numbers, exact as long as the score fits; NumPy keeps the low 64 bits.
            score = np.einsum("ij,ij->i", self.whole[at], vectors[to])
        keep = (score >= self.least[at]) & (self.ids[at] != ids[to])
        owner = np.concatenate([self.owner, at[keep]])
        score = np.concatenate([self.score, score[keep]])
        candidate = np.concatenate([self.candidate, ids[to[keep]]])
        order = np.lexsort((candidate, -score, owner))
        owner, score, candidate = owner[order], score[order], candidate[order]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        first = place < self.k
        self.owner, self.score, self.candidate = owner[first], score[first], candidate[first]
        full = place == self.k - 1
        self.least[owner[full]] = score[full]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.int64).reshape(-1, width)


def top_k(
    vectors: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "embedding",
    scale: int = SCALE, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK,
) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id`` and ``score`` of each query's k best rows."""
    rows = vectors.select(
        F.col(key).cast("bigint").alias("id"), integers(F.col(vector), scale).alias("v"), is_query.alias("q")
    ).where("id IS NOT NULL AND v IS NOT NULL").withColumn("width", F.size("v"))
    total, queries = rows.agg(F.count("*"), F.count(F.when(F.col("q"), 1))).first()
    query_blocks = max(1, -(-queries // query_block))
    groups = max(1, -(-total // candidate_block))
    own = F.xxhash64("id", "v")
    candidates = rows.select(
        "id", "v", "width", F.lit(1).alias("side"),
        F.pmod(own, F.lit(groups)).cast("int").alias("group"),
        F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("block"),
    )
    asked = rows.where("q").dropDuplicates(["id", "v"]).select(
        "id", "v", "width", F.lit(0).alias("side"),
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"),
        F.pmod(own, F.lit(query_blocks)).cast("int").alias("block"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best = None, None
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def result() -> Iterator[pa.RecordBatch]:
            if best is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(best.ids[best.owner]), pa.array(best.candidate), pa.array(best.score)],
                    names=["query_id", "vec_id", "score"],
                )

        for batch in batches:
            columns = [np.asarray(batch.column(i)) for i in (2, 3, 4, 5)]
            same = np.stack(columns, axis=1)
            changes = np.flatnonzero((same[1:] != same[:-1]).any(axis=1)) + 1 if len(same) else np.zeros(0, int)
            for a, b in zip([0, *changes], [*changes, len(same)], strict=True):
                if a == b:
                    continue
                width, side, group, block = (int(x) for x in same[a])
                ids = np.asarray(batch.column(0).slice(a, b - a), dtype=np.int64)
                matrix = _matrix(batch.column(1).slice(a, b - a), width)
                if (width, group, block) != now:
                    yield from result()
                    now, best, waiting = (width, group, block), None, []
                if not side:
                    waiting.append((ids, matrix))
                    continue
                if best is None:
                    if not waiting:
                        continue  # no query of this length
                    best = _Best(np.concatenate([x for x, _ in waiting]), np.concatenate([x for _, x in waiting]), k)
                for start in range(0, len(ids), STRIP):
                    best.add(ids[start : start + STRIP], matrix[start : start + STRIP])
        yield from result()

    dealt = (
        asked.select("id", "v", "width", "side", "group", "block")
        .unionByName(candidates)
        .repartition(max(1, query_blocks * groups), "width", "group", "block")
        .sortWithinPartitions("width", "group", "block", "side")
    )
    found = dealt.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.select("query_id", F.row_number().over(best).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
