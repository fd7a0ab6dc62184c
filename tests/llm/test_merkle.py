"""The Merkle manifest against a tree built in plain Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from driftline.llm import merkle

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, h string, g string, pos int, proof string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    fields = [row[0], row[1], row[2], row[3], text]
    return sha(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def climb(nodes):
    """Root, and for each node its siblings by level as (left, right)."""
    paths, own = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, at in enumerate(own):
            run = nodes[at // 3 * 3 : at // 3 * 3 + 3]
            paths[i].append(("".join(run[: at % 3]), "".join(run[at % 3 + 1 :])))
        own = [at // 3 for at in own]
        nodes = [sha(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0] if nodes else None, paths


def brute(rows, claim):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row[0] is not None, row[0], leaf_of(row, row[4]), row))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in order:
        leaves = sorted(groups[source], key=lambda e: (e[0], e[1] or 0, e[2]))
        trees[source] = (*climb([e[2] for e in leaves]), leaves)
    root, above = climb([trees[s][0] for s in order])
    out = []
    for source, path in zip(order, above):
        subroot, paths, leaves = trees[source]
        for (_, key, own, row), below in zip(leaves, paths):
            steps = below + path
            got = leaf_of(row, claim(row))
            for left, right in steps:
                got = sha(left, got, right)
            out.append((key, own, subroot, root, sha(*(left + right for left, right in steps)), got))
    return sorted(out, key=repr)


def run(spark, rows):
    even = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    claim = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    df = spark.createDataFrame([(*r, "x", "y", 1, "z") for r in rows], SCHEMA)
    found = merkle.manifest(df, claim)
    return sorted(
        map(tuple, found.select(
            "doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")), "folded_root"
        ).collect()), key=repr,
    )


def without_lines(row):
    even = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
    return row[4].replace("\n", "") if even and row[4] is not None else row[4]


def test_sources_of_many_sizes(spark):
    rows = []
    for size, source in enumerate([None, "", "b", "a", "é", "zz", "hot"]):
        for i in range([1, 2, 3, 4, 9, 10, 100][size]):
            rows.append((i * 7 + size, source, [None, "en"][i % 2], [None, 5][i % 2], [None, "", "a\nb", "x" * 50][i % 4]))
    rows.append((None, "b", None, None, None))
    rows += [(3, "hot", "en", 1, "same\n")] * 5
    rows.append((4, "b", "de", 2, "\n" * 100_000))
    got = run(spark, rows)
    assert got == brute(rows, without_lines)
    assert {r[5] == r[3] for r in got} == {True, False}


def test_one_source_one_row_and_none(spark):
    assert run(spark, [(1, "s", "en", 3, "a\nb")]) == brute([(1, "s", "en", 3, "a\nb")], without_lines)
    rows = [(i, "s", None, i, "t") for i in range(28)]
    assert run(spark, rows) == brute(rows, without_lines)
    assert run(spark, []) == []


@pytest.mark.parametrize("partitions", ["3", "37"])
def test_spreading_does_not_matter(spark, partitions):
    rows = [(i % 40, f"s{i % 2}", "en", 1, f"t{i % 5}") for i in range(300)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert run(spark, rows) == brute(rows, without_lines)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
