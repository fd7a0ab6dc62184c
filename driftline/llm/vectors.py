"""Near-duplicate vectors by sorted projection passes.

Equal vectors with equal labels are one class. The classes of a label are
ordered by the signs of their projections on random directions, less the
label's mean, as one concatenated hash, and cut into spans of neighbours. In
every span several passes order its classes anew, by hashes of their own, and
compare each with a bounded window of its successors; so a vector is shipped
once for many passes. How many rounds of spans a label gets is measured on a
sample of it, with pairs planted at the least cosine: rounds follow until a
share of ``MISS`` of such pairs is expected to be left. Verified pairs are
united into components. A window can not hold a large component, so the last
step compares all members of each component with each other, in blocks of fixed
size: links inside a component are exact, whatever its size.

Vectors that are null, empty, zero or hold null or non-finite components link
with nothing, nor do those with a null label, nor vectors of different
lengths. Repeated rows are vectors of their own: equal ones link with each
other. The smallest key names a component; a null key counts as larger than
all others. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import once, slices
from driftline.llm.components import connected_components, in_blocks, local_components, runs
from driftline.llm.merkle import number
from driftline.operators.keyed import salted_lookup
from driftline.session import stage

LEAST = 0.93
BITS = 48
WINDOW = 128
SEED = 2017
# Share of pairs at the least cosine that passes may be expected to leave.
MISS = 0.001
# Classes of a label, planted pairs and passes that its number of rounds is
# measured on, and the most rounds.
SAMPLE, PLANTED, TRIALS = 8192, 256, 64
MOST_ROUNDS = 4096
# Hashes made at a time, which are also the passes over a span.
TURNS = 16
# Classes of a span, and those of one block of a component.
SPAN = 8192
BLOCK = 4096


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, width)


def _unit(matrix: np.ndarray) -> np.ndarray:
    """Rows of length one, as double; scaled first, so that no square overflows."""
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return matrix / np.sqrt(np.einsum("ij,ij->i", matrix, matrix))[:, None]


def _directions(seed: int, width: int, turns: int, bits: int) -> np.ndarray:
    """The random directions of passes ``turns * TURNS`` and following."""
    return np.random.default_rng([seed, width, turns]).standard_normal((width, TURNS * bits))


def _signs(matrix: np.ndarray, directions: np.ndarray, bits: int) -> np.ndarray:
    """Hash of every row in each of ``TURNS`` passes."""
    powers = np.left_shift(np.int64(1), np.arange(bits - 1, -1, -1, dtype=np.int64))
    return (matrix @ directions >= 0).reshape(-1, TURNS, bits) @ powers


def _hit_rates(unit: np.ndarray, members: int, least: float, window: int, bits: int, seed: int) -> np.ndarray:
    """How often a pass links each of some planted pairs, judged by a label's sample.

    A planted vector may also meet a member that is near to it and to its
    partner: the three are one component.
    """
    size, width = unit.shape
    random = np.random.default_rng([seed, width])
    origin = random.permutation(size)[:PLANTED]
    side = random.standard_normal((len(origin), width))
    side -= np.einsum("ij,ij->i", side, unit[origin])[:, None] * unit[origin]
    planted = least * unit[origin] + np.sqrt(1 - least**2) * _unit(side)
    goal = (unit[origin] @ unit.T >= least) & (planted @ unit.T >= least)
    goal[np.arange(len(origin)), origin] = True
    probe, target = np.nonzero(goal)
    first = np.searchsorted(probe, np.arange(len(origin)))
    center = unit.mean(axis=0)
    # Ranks in the sample that the window spans; too few to count are carried on from more.
    wanted = window * size / members
    reaches = [wanted] if wanted >= 4 else [4, 16]
    hits = np.zeros((len(reaches), len(origin)))
    for turns in range(TRIALS // TURNS):
        directions = _directions(seed + 1, width, turns, bits)
        own, other = _signs(unit - center, directions, bits), _signs(planted - center, directions, bits)
        for turn in range(TURNS):
            order = np.argsort(own[:, turn], kind="stable")
            rank = np.empty(size)
            rank[order] = np.arange(size)
            place = np.searchsorted(own[order, turn], other[:, turn]) - 0.5
            nearest = np.minimum.reduceat(np.abs(rank[target] - place[probe]), first)
            for k, reach in enumerate(reaches):
                hits[k] += nearest <= reach
    rates = (hits + 0.5) / (TRIALS + 1)
    if len(reaches) == 1:
        return rates[0]
    power = np.log(rates[1].mean() / rates[0].mean()) / np.log(reaches[1] / reaches[0])
    return rates[0] * (wanted / reaches[0]) ** power


def _rounds(spans: np.ndarray, windows: np.ndarray) -> int:
    """Least number of rounds that leave ``MISS`` of the pairs.

    ``spans`` and ``windows`` tell how often one order brings a pair into a
    span and into a window. A window of a span holds at least those of its
    members that the same window over the whole label would.
    """
    missed = 1 - spans * (1 - (1 - windows) ** TURNS)
    low, high = 0, MOST_ROUNDS
    while high - low > 1:
        middle = (low + high) // 2
        if (missed**middle).mean() <= MISS:
            high = middle
        else:
            low = middle
    return high


def _plan(classes: DataFrame, sizes: DataFrame, least: float, window: int, bits: int, seed: int) -> DataFrame:
    """``rounds`` and ``center`` of each label and width of two classes or more."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        unit = _unit(np.array(rows["v"].tolist(), dtype=np.float64))
        members = int(rows["members"].iloc[0])
        rounds = 1
        if members > window:
            every = np.ones(min(len(unit), PLANTED))
            # Of pairs a quarter of a span apart, three in four share one.
            spans = every if members <= SPAN else 0.75 * _hit_rates(unit, members, least, SPAN // 4, bits, seed)
            rounds = _rounds(np.minimum(spans, 1), np.minimum(_hit_rates(unit, members, least, window, bits, seed), 1))
        return pd.DataFrame(
            {"kind": rows["kind"].iloc[:1], "width": rows["width"].iloc[:1], "rounds": [rounds], "center": [unit.mean(axis=0)]}
        )

    several = sizes.where(F.col("members") > 1)
    sample = salted_lookup(classes.select("node", "kind", "width", "v"), several, ["kind", "width"]).where(
        F.pmod(F.xxhash64("node", F.lit(seed)), F.col("members")) < SAMPLE
    )
    return sample.groupBy("kind", "width").applyInPandas(run, "kind bigint, width int, rounds int, center array<double>")


def _hashes(classes: DataFrame, bits: int, seed: int) -> DataFrame:
    """node, kind, width, turn and hash of every class in every round of its label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8192):
            widths, rounds = np.asarray(batch.column(2)), np.asarray(batch.column(3))
            for width in np.unique(widths).tolist():
                rows = np.flatnonzero(widths == width)
                part = batch.take(pa.array(rows))
                away = _unit(_matrix(part.column(4), width)) - _matrix(part.column(5), width)
                for turns in range(-(-int(rounds[rows].max()) // TURNS)):
                    key = f"directions {seed} {width} {turns} {bits}"
                    directions = once(key, lambda: _directions(seed, width, turns, bits))  # noqa: B023
                    hashes = _signs(away, directions, bits)
                    turn = np.arange(turns * TURNS, (turns + 1) * TURNS, dtype=np.int32)
                    row, column = np.nonzero(turn[None, :] < rounds[rows][:, None])
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(part.column(i).take(pa.array(row)) for i in range(3)),
                            pa.array(turn[column]),
                            pa.array(hashes[row, column]),
                        ],
                        names=["node", "kind", "width", "turn", "hash"],
                    )

    return classes.select("node", "kind", "width", "rounds", "v", "center").mapInArrow(
        run, "node bigint, kind bigint, width int, turn int, hash bigint"
    )


class _Spanning:
    """Spanning links of the pairs of ``size`` rows that are added."""

    def __init__(self, size: int):
        self.root = np.arange(size)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            linked = np.flatnonzero(self.root != np.arange(len(self.root)))
            self.root = local_components(
                len(self.root), np.concatenate([linked, a]), np.concatenate([self.root[linked], b])
            )

    def links(self, node: np.ndarray) -> pa.RecordBatch:
        linked = np.flatnonzero(self.root != np.arange(len(self.root)))
        return pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[self.root[linked]])], names=["a", "b"])


def _window_links(spans: DataFrame, least: float, window: int, bits: int, seed: int) -> DataFrame:
    """Spanning links (a, b) of the pairs found in the windows of all passes over every span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for span in runs(batches, ["kind", "width", "turn", "span"]):
            node, turn, width = np.asarray(span["node"]), int(span["turn"][0].as_py()), int(span["width"][0].as_py())
            # Whatever order the rows came in, passes see the same one.
            order = np.argsort(node)
            node = node[order]
            unit = _unit(_matrix(span["v"].combine_chunks().take(pa.array(order)), width))
            # Rounds have directions of their own, apart from those that made the spans.
            hashes = _signs(unit - unit.mean(axis=0), _directions(seed + 2, width, turn, bits), bits)
            found = _Spanning(len(node))
            for each in range(TURNS):
                rows = np.argsort(hashes[:, each], kind="stable")
                sorted_ = unit[rows]
                for start in range(0, len(rows), 256):
                    near = sorted_[start : start + 256] @ sorted_[start : start + 256 + window].T >= least
                    i, j = np.nonzero(near)
                    inside = (i < j) & (j <= i + window)
                    found.add(rows[start + i[inside]], rows[start + j[inside]])
                if len(node) <= window:
                    break  # one window holds all
            yield found.links(node)

    return spans.mapInArrow(run, "a bigint, b bigint")


def _component_links(members: DataFrame, least: float, block: int) -> DataFrame:
    """Weighted number of links of every member, comparing all pairs of each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pair in runs(batches, ["component", "i", "j"]):
            node, copies, side = (np.asarray(pair[x]) for x in ("node", "copies", "side"))
            lists = pair["v"].combine_chunks()
            unit = _unit(_matrix(lists, len(lists[0])))
            links = np.zeros(len(node), dtype=np.int64)
            within = pair["i"][0] == pair["j"][0]
            first = np.flatnonzero(side == 0)
            second = first if within else np.flatnonzero(side == 1)
            for start in range(0, len(first), 512):
                rows = first[start : start + 512]
                near = unit[rows] @ unit[second].T >= least
                if within:
                    near[np.arange(len(rows)), start + np.arange(len(rows))] = False
                links[rows] += near @ copies[second]
                if not within:
                    links[second] += copies[rows] @ near
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(links)], names=["node", "links"])

    wide = in_blocks(members, "component", "node", "one", block)
    return (
        wide.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
        .mapInArrow(run, "node bigint, links bigint")
        .groupBy("node").agg(F.sum("links").alias("links"))
    )


def _in_spans(planned: DataFrame, classes: DataFrame, window: int, bits: int, seed: int) -> DataFrame:
    """The classes of every round in spans of neighbours, with their vectors."""
    hashed = _hashes(planned, bits, seed).withColumn("part", F.concat_ws(" ", "turn", "kind", "width"))
    placed = number(hashed, ["hash", "node"], "part")
    spans = F.ceil(F.col("n") / SPAN)
    span = F.floor(F.col("pos") * spans / F.col("n"))
    # The first classes of a span are also compared with the last ones of the span before.
    before = F.floor((F.col("pos") - window) * spans / F.col("n"))
    both = F.explode(F.when((before < span) & (span > 0), F.array(span, span - 1)).otherwise(F.array(span)))
    return (
        placed.select("node", "kind", "width", "turn", both.alias("span"))
        .join(classes.select("node", "v"), "node")
        .repartition("kind", "width", "turn", "span").sortWithinPartitions("kind", "width", "turn", "span")
    )


def near_vectors(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    least: float = LEAST, window: int = WINDOW, bits: int = BITS, seed: int = SEED,
) -> DataFrame:
    """Key, ``n_links``, ``component_id`` and ``kept`` of every row."""
    v = F.col("v")
    usable = v.isNotNull() & F.col("label").isNotNull() & (F.size(v) > 0) & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    ) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).alias("label"))
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False))).withColumn(
        "k1", F.when(F.col("usable"), F.xxhash64("label", "v"))
    ).withColumn("k2", F.when(F.col("usable"), F.xxhash64(F.lit(seed), "v", "label")))
    # A class is known by two 64-bit hashes of its label and vector.
    classes = rows.where("usable").groupBy("k1", "k2").agg(
        F.min("id").alias("id"), F.count("*").alias("copies"),
        F.first("v").alias("v"), F.xxhash64(F.first("label")).alias("kind"),
    )
    classes = stage(
        classes.withColumn("node", F.monotonically_increasing_id()).withColumn("width", F.size("v")), "classes"
    )
    sizes = stage(classes.groupBy("kind", "width").agg(F.count("*").alias("members")), "sizes")
    plan = stage(_plan(classes, sizes, least, window, bits, seed), "plan")
    planned = salted_lookup(classes.select("node", "kind", "width", "v"), plan, ["kind", "width"])
    found = _window_links(_in_spans(planned, classes, window, bits, seed), least, window, bits, seed)
    components = connected_components(found)
    members = components.join(
        classes.select("node", "copies", "v", "id"), "node"
    ).withColumn("one", F.lit(1))
    members = stage(members, "members")
    links = _component_links(members, least, BLOCK)
    names = members.groupBy("component").agg(F.min("id").alias("component_id"))
    # A component may hold most of the vectors.
    found = salted_lookup(members.select("node", "component").join(links, "node"), names, ["component"])
    by_class = classes.select("k1", "k2", "node", "copies", "id").join(found, "node", "left").select(
        "k1", "k2",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
    )
    # Written, so that the join can split vectors that most rows have.
    return rows.select("id", "k1", "k2").join(stage(by_class, "linked"), ["k1", "k2"], "left").select(
        F.col("id").alias(key),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(False)).alias("kept"),
    )
