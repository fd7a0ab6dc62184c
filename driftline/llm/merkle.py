"""Merkle manifest of a table: a tree of hashes for every source and one above them.

Every row is a leaf. The leaves of a source stand in the order of the key, and
runs of ``FANOUT`` neighbours become their parent until one node, the subroot,
is left; the subroots in the order of the source form the last tree. Going up,
a parent's children are pivoted into one column for each slot by conditional
aggregates: the columns concatenated give its hash. Going down, the columns
without a child's own one are its siblings, so a row's proof is built from its
parent's proof and nothing is compared with anything else.

Leaves are numbered by a range shuffle and counts for each range, so a source
of any size is spread over all tasks, and the children of a parent meet before
the shuffle. Tables shrink by the fanout with every level; each is written to
the shared folder, so a lost executor costs a read. Spark expressions only.

A null source is a source of its own and comes first, as does a null key. Rows
of one key stand in the order of their leaves; repeated rows are leaves of
their own with equal hashes. Empty texts are texts, any text is hashed whole,
an empty table gives an empty result, and other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.session import stage

FANOUT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# Rows of a task come after each other in the low bits of the number that
# Spark gives them.
ROW_BITS = (1 << 33) - 1


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts, one after the other; nulls are nothing."""
    return F.sha2(F.concat(*(F.coalesce(part, F.lit("")) for part in parts)), 256)


def leaf(fields: dict[str, Column]) -> Column:
    """Hash of a row: each field with its length in bytes, or ``-`` for null."""
    texts = [field.cast("string") for field in fields.values()]
    return digest(
        *(
            F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))
            for text in texts
        )
    )


def number(df: DataFrame, order: list[str], within: str | None = None) -> DataFrame:
    """Rows with ``pos``, their place in ``order`` inside ``within``, and ``n``, how many there are.

    One range shuffle: each range counts its rows of every group, and what the
    ranges before it hold is added. The last order column tells equal rows
    apart only for the shuffle, so that copies are spread as well.
    """
    group = within or "__all"
    rows = df if within else df.withColumn(group, F.lit(0))
    keys = [*([within] if within else []), *order, "__row"]
    placed = stage(
        rows.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
        .drop("__row").withColumn("__range", F.spark_partition_id())
        .withColumn("__at", F.monotonically_increasing_id().bitwiseAND(ROW_BITS)),
        "numbered",
    )
    counts = placed.groupBy(group, "__range").agg(F.count("*").alias("__here"), F.min("__at").alias("__first"))
    ranges = Window.partitionBy(group).orderBy("__range")
    counts = counts.select(
        group, "__range", "__first",
        F.coalesce(F.sum("__here").over(ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
        F.sum("__here").over(Window.partitionBy(group)).alias("n"),
    )
    found = placed.join(counts, [group, "__range"]).withColumn("pos", F.col("__before") + F.col("__at") - F.col("__first"))
    return found.drop("__range", "__at", "__first", "__before", *([] if within else [group]))


def parents(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """One level up: children in slot columns, hashed together.

    ``nodes`` has ``g`` (tree), ``pos``, ``n`` (nodes of its level) and ``h``;
    only levels of several nodes have one above them.
    """
    slot = F.pmod("pos", F.lit(FANOUT))
    slots = [
        F.max(F.when(slot == k, F.struct("h", *carried))).alias(f"slot{k}") for k in range(FANOUT)
    ]
    pivoted = nodes.where("n > 1").groupBy("g", F.floor(F.col("pos") / FANOUT).alias("pos")).agg(
        F.ceil(F.max("n") / FANOUT).alias("n"), *slots
    )
    return pivoted.withColumn("h", digest(*(F.col(f"slot{k}.h") for k in range(FANOUT))))


def grow(leaves: DataFrame, most: int, carried: list[str]) -> list[DataFrame]:
    """All levels above ``leaves``; ``most`` is the size of the largest tree."""
    levels, size = [leaves], most
    while size > 1:
        up = parents(levels[-1], carried if len(levels) == 1 else [])
        levels.append(stage(up, "merkle"))
        size = -(-size // FANOUT)
    return levels


def descend(levels: list[DataFrame], tops: DataFrame, told: list[str], carried: list[str]) -> DataFrame:
    """Every leaf with its proof, below what ``tops`` (``g``, ``proof``, ``told``) says of its tree.

    A proof is a list from the leaf up: what stands left of the path in its
    run, and what stands right of it.
    """
    above = None
    for k in range(len(levels) - 1, 0, -1):
        own = levels[k]
        found = own.where("n = 1").join(tops, "g")
        if above is not None:
            found = found.unionByName(own.where("n > 1").join(above, ["g", "pos"]))
        children = F.array(
            *(
                F.struct(
                    F.lit(slot).alias("slot"), F.col(f"slot{slot}").alias("node"),
                    F.concat(F.lit(""), *(F.coalesce(f"slot{i}.h", F.lit("")) for i in range(slot))).alias("left"),
                    F.concat(F.lit(""), *(F.coalesce(f"slot{i}.h", F.lit("")) for i in range(slot + 1, FANOUT))).alias("right"),
                )
                for slot in range(FANOUT)
            )
        )
        spread = found.select("g", "pos", "proof", *told, F.explode(children).alias("__child")).where("__child.node IS NOT NULL")
        above = spread.select(
            "g", (F.col("pos") * FANOUT + F.col("__child.slot")).alias("pos"),
            F.concat(F.array(F.struct("__child.left", "__child.right")), F.col("proof")).alias("proof"), *told,
            *([F.col(f"__child.node.{c}").alias(c) for c in ["h", *carried]] if k == 1 else []),
        )
    # The slots of the first level hold all that is told of the leaves, so only
    # trees of one leaf are still to come.
    columns = ["h", *carried, "proof", *told]
    alone = levels[0].where("n = 1").join(tops, "g").select(*columns)
    return alone if above is None else above.select(*columns).unionByName(alone)


def fold(start: Column, proof: Column) -> Column:
    """Root that a leaf hash and a proof lead to."""
    return F.aggregate(proof, start, lambda h, step: F.sha2(F.concat(step["left"], h, step["right"]), 256))


def proof_digest(proof: Column) -> Column:
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def manifest(docs: DataFrame, claimed: Column) -> DataFrame:
    """Every row of ``docs`` with its leaf, subroot, root and proof, and what a claimed text folds to.

    ``claimed`` is the text that somebody presents for a row; the proof holds
    if it folds to the root, ``folded_root = root``.
    """
    fields = {name: F.col(name) for name in FIELDS}
    leaves = docs.select(
        "doc_id", "source", leaf(fields).alias("h"),
        F.when(~claimed.eqNullSafe(F.col("text")), leaf({**fields, "text": claimed})).alias("presented"),
    )
    # A key without nulls: joins by it keep the null source.
    keyed = stage(leaves, "leaves").withColumn("g", F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("+"), "source")))
    placed = stage(number(keyed.drop("source"), ["doc_id", "h"], "g"), "placed")
    most = placed.agg(F.max("n")).first()[0] or 0
    carried = ["doc_id", "presented"]
    levels = grow(placed, most, carried)
    subroots = levels[0].where("n = 1").select("g", "h")
    for level in levels[1:]:
        subroots = subroots.unionByName(level.where("n = 1").select("g", "h"))
    sources = number(subroots.withColumnRenamed("g", "source"), ["source"]).withColumn("g", F.lit(0))
    sources = stage(sources, "subroots")
    count = sources.count()
    above = grow(sources, count, ["source"])
    top = above[-1].where("n = 1").select(
        "g", F.col("h").alias("root"), F.expr("CAST(array() AS array<struct<left:string,right:string>>)").alias("proof")
    )
    trees = descend(above, top, ["root"], ["source"])
    trees = stage(trees.select(F.col("source").alias("g"), F.col("h").alias("subroot"), "root", "proof"), "trees")
    found = descend(levels, trees, ["subroot", "root"], carried)
    return found.select(
        "doc_id", F.col("h").alias("leaf"), "subroot", "root", "proof",
        fold(F.coalesce("presented", "h"), F.col("proof")).alias("folded_root"),
    )
