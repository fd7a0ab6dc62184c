"""N-gram Jaccard join by chosen paths.

A text's set is its five-word shingles (words: lower case, between white
space), as 64-bit hashes. Texts with equal sets are one class. Every class is
embedded as minhash tokens. A run starts with all classes in one bucket and
splits buckets recursively: at each node one or two of the token positions are
sampled, the same for all members, and a class goes on to the buckets that
hold the classes with its tokens there. Classes alone in a bucket drop out. Small buckets are compared pair by pair on the tokens. A larger bucket is
first compared with one leader: classes near it are linked to it, and those so
near that all their partners were linked as well leave; the others are split
on. Runs are repeated until a pair at the threshold is found with the target
recall, as often as the depth that buckets reach asks for.

The links so far are candidates. They are united into components, and the
members of each component are compared with each other on their whole sets, in
blocks of fixed size. So reported links are exact, pairs that no path brought
together are found if a component joins them, and no pairs are written: only
each member's number of links and spanning links.

Null and empty texts and texts of white space have an empty set, which links
with nothing. Texts of one to four words have one shingle of all their words.
Repeated rows are rows of their own and link with each other. Null keys are
kept, and count as larger than all others when a class or component is named.
Texts of any length are read whole; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import slices
from driftline.llm.components import connected_components, in_blocks, local_components, runs
from driftline.operators.keyed import latest_per_key, salted_lookup
from driftline.session import stage

WORDS = 5
LEAST = 0.8
RECALL = 0.999
TOKENS = 64
# Buckets up to this size are compared pair by pair.
SMALL = 1000
# Levels after which what is left of a bucket is one set of candidates.
DEEPEST = 10
# Levels that a pair usually passes, for the number of runs that all classes
# make. Those that go deeper make as many more as their depth needs.
USUAL_DEPTH = 2
# Share of the nodes below the roots that sample two tokens; the others sample
# one. A bucket of classes that share less than 1 / (1 + TWICE) of their tokens
# so shrinks with every level.
TWICE = 0.5
# Shares of equal tokens, lower than the similarity they stand for by several
# standard deviations of the estimate: of a candidate pair, of a class that is
# linked to a leader, and of one that may leave with it.
NEAR, LINKED, LEAVES = 0.55, 0.35, 0.70
# Characters of text in one block of a component, and what a row counts besides its text.
BLOCK_CHARACTERS = 6_000_000
ROW_CHARACTERS = 1000
# Rows of a block whose links are told at once, and shingles counted at once: where
# all are near, their pairs would take hundreds of megabytes.
STRIP, COLUMNS = 64, 256

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_STEP = 4096


def _mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _powers(size: int) -> np.ndarray:
    """Powers of the hash base modulo 2**64."""
    powers = np.full(size, _BASE, dtype=np.uint64)
    powers[0] = 1
    return np.multiply.accumulate(powers)


class Shingler:
    """64-bit hashes of the shingles of a text, each once."""

    def __init__(self, words: int = WORDS):
        self.words = words
        self.powers = _powers(1 << 16)

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").lower().split()
        if not words:
            return np.zeros(0, dtype=np.uint64)
        data = np.frombuffer(" ".join(words).encode("utf-8", "surrogatepass"), dtype=np.uint8)
        spaces = np.flatnonzero(data == 32)
        starts = np.concatenate([[0], spaces + 1])
        ends = np.concatenate([spaces, [len(data)]])
        longest = int((ends - starts).max())
        if longest >= len(self.powers):
            self.powers = _powers(2 * longest)
        # The polynomial of each word counts from the word's own start.
        place = np.arange(len(data)) - np.repeat(starts, np.append(np.diff(starts), len(data) - starts[-1]))
        value = (data.astype(np.uint64) + np.uint64(1)) * self.powers[place]
        value[spaces] = 0
        hashes = _mix(np.add.reduceat(value, starts) + (ends - starts).astype(np.uint64))
        size = min(self.words, len(hashes))
        total = np.zeros(len(hashes) - size + 1, dtype=np.uint64)
        for step in range(size):
            total = total * np.uint64(0x100000001B3) + hashes[step : step + len(total)]
        return np.unique(_mix(total + np.uint64(size)))


def minhash(shingles: np.ndarray, keys: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Smallest of each of the random permutations of the set, as 32-bit tokens."""
    change, factor = keys
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(factor), 0xFFFFFFFF, dtype=np.uint32)
    for start in range(0, len(low), _STEP):
        part = (low[start : start + _STEP, None] ^ change) * factor
        least = np.minimum(least, part.min(axis=0))
    return least


def token_keys(tokens: int = TOKENS) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(20170)
    change = random.integers(0, 1 << 32, tokens, dtype=np.uint32)
    return change, random.integers(0, 1 << 31, tokens, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def text_mark(text: Column) -> Column:
    """Tells rows with one key and different texts apart."""
    return F.xxhash64(text)


def sketch(docs: DataFrame, key: str, text: str, words: int = WORDS, tokens: int = TOKENS) -> DataFrame:
    """id, mark, set hashes k1 and k2, number of shingles, minhash tokens of every row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, keys = Shingler(words), token_keys(tokens)
        for batch in slices(batches):
            k1, k2, sizes, sketches, letters = [], [], [], [], []
            for body in batch.column(2).to_pylist():
                shingles = shingler(body)
                k1.append(_mix(shingles).sum(dtype=np.uint64))
                k2.append((_mix(shingles ^ _BASE) * _BASE).sum(dtype=np.uint64))
                sizes.append(len(shingles))
                letters.append(len(body or ""))
                sketches.append(minhash(shingles, keys).tobytes() if len(shingles) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1),
                    pa.array(np.array(k1, dtype=np.uint64).view(np.int64)),
                    pa.array(np.array(k2, dtype=np.uint64).view(np.int64)),
                    pa.array(sizes, pa.int64()), pa.array(letters, pa.int64()), pa.array(sketches, pa.binary()),
                ],
                names=["id", "mark", "k1", "k2", "size", "letters", "tokens"],
            )

    return docs.select(F.col(key).alias("id"), text_mark(F.col(text)).alias("mark"), F.col(text).alias("text")).mapInArrow(
        run, f"id {kind}, mark bigint, k1 bigint, k2 bigint, size bigint, letters bigint, tokens binary"
    )


def _token_matrix(column: pa.Array, tokens: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, tokens)


def _sampled(paths: np.ndarray, tokens: int, twice: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and their token positions: one for each node, then another for some of the nodes."""
    drawn = _mix(paths + np.uint64(1))
    first = (drawn % np.uint64(tokens)).astype(np.int64)
    other = ((drawn >> np.uint64(16)) % np.uint64(tokens - 1)).astype(np.int64)
    yield np.arange(len(paths)), first
    again = np.flatnonzero((drawn >> np.uint64(40)) < np.uint64(int(twice * (1 << 24))))
    yield again, ((first + 1 + other) % tokens)[again]


def _split(members: DataFrame, tokens: int, roots: range = range(0)) -> DataFrame:
    """(node, path) of the buckets that each row goes on to; from the runs ``roots`` at the start.

    Below the roots the few rows left take their tokens along.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = _token_matrix(batch.column(1), tokens)
            node = np.asarray(batch.column(0))
            starts = (
                [_mix(np.full(len(node), 977 + r, dtype=np.uint64)) for r in roots]
                if roots else [np.asarray(batch.column(2)).view(np.uint64)]
            )
            for path in starts:
                for rows, position in _sampled(path, tokens, 1.0 if roots else TWICE):
                    token = matrix[rows, position].astype(np.uint64)
                    onward = _mix(path[rows] * np.uint64(0x100000001B3) + (token << np.uint64(8)) + position.astype(np.uint64))
                    carried = [] if roots else [batch.column(1).take(pa.array(rows))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(node[rows]), pa.array(onward.view(np.int64)), *carried],
                        names=["node", "path", "tokens"][: 2 + len(carried)],
                    )

    columns = ["node", "tokens"] if roots else ["node", "tokens", "path"]
    schema = "node bigint, path bigint" if roots else "node bigint, path bigint, tokens binary"
    return members.select(*columns).mapInArrow(run, schema)


def _compare_small(buckets: DataFrame, tokens: int, near: float) -> DataFrame:
    """Spanning links between the near members of each bucket. Its rows are adjacent."""
    schema = "a bigint, b bigint"

    def links(path: np.ndarray, node: np.ndarray, matrix: np.ndarray) -> pa.RecordBatch:
        left, right, step = [], [], 1
        while step < len(path):
            at = np.flatnonzero(path[step:] == path[:-step])
            if not len(at):
                break
            equal = (matrix[at] == matrix[at + step]).mean(axis=1)
            left.append(at[equal >= near])
            right.append(at[equal >= near] + step)
            step += 1
        none = np.zeros(0, np.int64)
        root = local_components(len(node), np.concatenate([none, *left]), np.concatenate([none, *right]))
        linked = np.flatnonzero(root != np.arange(len(node)))
        return pa.RecordBatch.from_arrays(
            [pa.array(node[linked]), pa.array(node[root[linked]])], names=["a", "b"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        for batch in slices(batches, 8192):
            path, node = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            matrix = _token_matrix(batch.column(2), tokens)
            if held is not None:
                path, node, matrix = (np.concatenate(x) for x in zip(held, (path, node, matrix), strict=True))
            cut = int(np.searchsorted(path == path[-1], True))  # the last bucket may go on
            yield links(path[:cut], node[:cut], matrix[:cut])
            held = path[cut:], node[cut:], matrix[cut:]
        if held is not None:
            yield links(*held)

    return (
        buckets.select("path", "node", "tokens").repartition("path").sortWithinPartitions("path").mapInArrow(run, schema)
    )


def _compare_leader(led: DataFrame, tokens: int) -> DataFrame:
    """node, path, leader, the share of tokens equal to the leader's, and the own tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, leader = _token_matrix(batch.column(2), tokens), _token_matrix(batch.column(3), tokens)
            equal = (own == leader).mean(axis=1) if len(own) else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(4), pa.array(equal), batch.column(2)],
                names=["node", "path", "leader", "equal", "tokens"],
            )

    return led.select("node", "path", "tokens", "leader_tokens", "leader").mapInArrow(
        run, "node bigint, path bigint, leader bigint, equal double, tokens binary"
    )


def run_count(least: float, recall: float, depth: int = USUAL_DEPTH) -> int:
    """Runs after which a pair at the threshold was found, ``depth`` levels down, with the target recall."""
    root = 1 - (1 - least) ** 2  # at least one of the sampled tokens is equal
    below = 1 - (1 - least) * (1 - TWICE * least)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - root * below ** (depth - 1))))


def candidate_links(
    classes: DataFrame, least: float = LEAST, recall: float = RECALL, tokens: int = TOKENS,
    small: int = SMALL, deepest: int = DEEPEST,
) -> DataFrame:
    """Links (a, b) that connect every candidate pair of classes (node, tokens).

    All classes make the runs that a usual depth needs. Classes whose buckets
    are still large beyond it make further runs, for the depth that was reached.
    """
    runs_made = run_count(least, recall)
    found, depth, deep = _descend(classes, range(runs_made), least, tokens, small, deepest)
    needed = run_count(least, recall, depth)
    if deep and needed > runs_made:
        nodes = deep[0]
        for more in deep[1:]:
            nodes = nodes.union(more)
        again = stage(classes.join(nodes.distinct(), "node", "left_semi"), "deep")
        found += _descend(again, range(runs_made, needed), least, tokens, small, deepest)[0]
    links = found[0]
    for more in found[1:]:
        links = links.union(more)
    return links


def _descend(
    classes: DataFrame, roots: range, least: float, tokens: int, small: int, deepest: int
) -> tuple[list[DataFrame], int, list[DataFrame]]:
    """Links of the runs ``roots``, the levels they took, and the nodes that went below the usual ones."""
    scale = least / LEAST
    found, deep = [], []
    buckets = _split(classes, tokens, roots)
    for level in range(1, deepest + 1):
        sizes = buckets.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
        met = buckets.join(sizes, "path")
        met = met.join(classes, "node") if level == 1 else met
        shared = stage(met.select("node", "path", "n", "tokens"), f"level-{level}")
        found.append(_compare_small(shared.where(F.col("n") <= small), tokens, NEAR * scale))
        large = shared.where(F.col("n") > small)
        if large.isEmpty():
            break
        if level == USUAL_DEPTH:
            deep.append(large.select("node"))
        leaders = large.groupBy("path").agg(F.min_by(F.struct("node", "tokens"), F.xxhash64("node")).alias("l")).select(
            "path", F.col("l.node").alias("leader"), F.col("l.tokens").alias("leader_tokens")
        )
        compared = stage(_compare_leader(large.join(leaders, "path"), tokens), "compared")
        linked = compared.where(
            (F.col("equal") >= LINKED * scale) | F.lit(level == deepest)
        ).select(F.col("node").alias("a"), F.col("leader").alias("b")).where("a <> b").distinct()
        found.append(linked)
        buckets = _split(compared.where(F.col("equal") < LEAVES * scale), tokens)
    return found, level, deep


def _exact(pairs: DataFrame, words: int, least: float) -> DataFrame:
    """Links of every member with the others of its component, and one link towards its root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for pair in runs(slices(batches, 256), ["component", "i", "j"]):
            node, copies, side = (np.asarray(pair[x]) for x in ("node", "copies", "side"))
            if len(node) < 2:
                continue
            sets = [shingler(body) for chunk in pair["text"].chunks for body in chunk.to_pylist()]
            size = np.array([len(x) for x in sets], dtype=np.float64)
            value, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            owner = np.repeat(np.arange(len(sets)), size.astype(np.int64))
            keep = seen[column] > 1  # others can not be in an intersection
            owner, column = owner[keep], (np.cumsum(seen > 1) - 1)[column[keep]]
            by_column = np.argsort(column, kind="stable")
            owner, column = owner[by_column], column[by_column]
            within = pair["i"][0] == pair["j"][0]
            first = np.flatnonzero(side == 0)
            second = first if within else np.flatnonzero(side == 1)
            links = np.zeros(len(node), dtype=np.int64)
            # A block of a small component may have no members.
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            width = int(seen.size and (seen > 1).sum())
            for start in range(0, len(first), 1024):
                rows = first[start : start + 1024]
                common = np.zeros((len(rows), len(second)), dtype=np.float32)
                for low in range(0, width, COLUMNS):
                    a, b = np.searchsorted(column, [low, low + COLUMNS])
                    part = np.zeros((len(node), min(COLUMNS, width - low)), dtype=np.float32)
                    part[owner[a:b], column[a:b] - low] = 1
                    common += part[rows] @ part[second].T
                for top in range(0, len(rows), STRIP):
                    some, own = rows[top : top + STRIP], common[top : top + STRIP]
                    near = own / np.maximum(size[some, None] + size[second] - own, 1) >= least
                    if within:
                        near[np.arange(len(some)), start + top + np.arange(len(some))] = False
                    links[some] += near @ copies[second]
                    if not within:
                        links[second] += copies[some] @ near
                    # One link a row and one a column keep what the strip connects only
                    # together with the components found in it.
                    x, y = np.nonzero(near)
                    local = local_components(len(node), some[x], second[y])
                    joined = np.flatnonzero(local != np.arange(len(node)))
                    left.append(joined)
                    right.append(local[joined])
            root = local_components(len(node), np.concatenate(left), np.concatenate(right))
            yield pa.RecordBatch.from_arrays(
                [pa.array(node), pa.array(links), pa.array(node[root])], names=["node", "links", "root"]
            )

    return pairs.mapInArrow(run, "node bigint, links bigint, root bigint")


def jaccard_join(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST,
    recall: float = RECALL, words: int = WORDS, tokens: int = TOKENS,
) -> DataFrame:
    """One row per row of ``docs``: key, ``mark``, ``class_id``, ``component_id``, ``n_links``, ``kept``.

    ``class_id`` is the smallest key with the same set, ``component_id`` the
    smallest that links reach, ``n_links`` the other rows at ``least`` or more.
    ``kept`` is true for one row of each component (for all its repetitions, if
    that row is repeated) and for rows with an empty set.
    """
    rows = stage(sketch(docs, key, text, words, tokens), "sketches")
    named = F.struct(F.col("id").isNull().alias("none"), "id", "mark")
    classes = rows.where("size > 0").groupBy("k1", "k2").agg(
        F.min(named).alias("name"), F.count("*").alias("copies"),
        F.first("letters").alias("letters"), F.first("tokens").alias("tokens"),
    )
    classes = stage(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    candidates = candidate_links(classes.select("node", "tokens"), least, recall, tokens)
    groups = connected_components(candidates)
    members = stage(
        groups.join(classes.select("node", "name", "copies", "letters"), "node"), "members"
    )
    bodies = docs.select(F.col(key).alias("id"), text_mark(F.col(text)).alias("mark"), F.col(text).alias("text"))
    own = members.select("node", "name", "component").alias("m").hint("shuffle_hash")
    texts = (
        bodies.alias("d").join(
            own, F.col("d.id").eqNullSafe(F.col("m.name.id")) & (F.col("d.mark") == F.col("m.name.mark"))
        )
        .select("node", "text").dropDuplicates(["node"])
    )
    weighed = members.select("node", "component", "copies", (F.col("letters") + ROW_CHARACTERS).alias("weight"))
    wide = in_blocks(weighed, "component", "node", "weight", BLOCK_CHARACTERS)
    pairs = (
        wide.join(texts, "node").select("component", "i", "j", "side", "node", "copies", "text")
        .repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    )
    verified = stage(_exact(pairs, words, least), "verified")
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    joined = connected_components(verified.select(F.col("node").alias("a"), F.col("root").alias("b")))
    names = joined.join(classes.select("node", "name"), "node").groupBy("component").agg(F.min("name").alias("first"))
    by_node = salted_lookup(joined, names, ["component"]).select("node", "first")
    found = (
        classes.select("k1", "k2", "node", "name", "copies")
        .join(links, "node", "left").join(by_node, "node", "left")
        .select(
            "k1", "k2", "name", F.coalesce("first", "name").alias("first"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
        )
    )
    return rows.select("id", "mark", "k1", "k2", "size").join(found, ["k1", "k2"], "left").select(
        F.col("id").alias(key),
        "mark",
        F.coalesce("name.id", "id").alias("class_id"),
        F.coalesce("first.id", "id").alias("component_id"),
        F.coalesce("links", F.lit(0)).alias("n_links"),
        (
            (F.col("size") == 0)
            | (F.col("id").eqNullSafe(F.col("first.id")) & F.col("mark").eqNullSafe(F.col("first.mark")))
        ).alias("kept"),
    )


def keep_first(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST, recall: float = RECALL
) -> DataFrame:
    """One row of each component, unchanged, and all rows with an empty set."""
    found = jaccard_join(docs, key, text, least, recall)
    judged = stage(found.select(F.col(key).alias("id"), "mark", "kept", "n_links"), "judged")
    dropped = judged.where(~F.col("kept")).select("id", "mark")
    column = "__mark"
    while column in docs.columns:
        column += "_"
    marked = docs.withColumn(column, text_mark(F.col(text)))

    def same(marks: DataFrame) -> Column:
        return marked[key].eqNullSafe(marks["id"]) & marked[column].eqNullSafe(marks["mark"])

    # Equal keys with equal texts are one name, so repetitions are thinned apart,
    # to the last by their other columns; those of empty sets link with nothing
    # and all stay.
    repeated = judged.where("kept AND n_links > 0").groupBy("id", "mark").count().where("count > 1").select("id", "mark")
    if repeated.isEmpty():
        return marked.join(dropped, same(dropped), "left_anti").drop(column)
    others = dropped.union(repeated)
    alike = marked.join(repeated, same(repeated), "left_semi")
    once = latest_per_key(alike, [key, column], [])
    return marked.join(others, same(others), "left_anti").union(once).drop(column)
