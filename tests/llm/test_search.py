"""Top-k and near-duplicate vectors against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.llm import topk, vectors
from driftline.llm.components import connected_components

SCHEMA = "vec_id bigint, embedding array<float>, label int, score string, node int, links int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1, 2) for i, v, label in rows], SCHEMA)


def usable(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v)


def floats(v):
    return [float(np.float32(x)) for x in v]


def test_top_k_equals_brute_force(spark):
    random = np.random.default_rng(3)
    rows = [(i, random.normal(size=64).astype(np.float32).tolist(), 0) for i in range(700)]
    rows += [(700 + i, rows[i % 3][1], 0) for i in range(20)]  # ties
    rows += [(800 + i, (np.array(rows[0][1]) * 1e6).tolist(), 0) for i in range(3)]
    rows += [(900, None, 0), (950, [float("nan")] * 64, 0), (951, [1.0, None], 0), (952, [], 0), (None, rows[0][1], 0),
             *((1100 + i, [8e6 * (-1) ** i, 0.004 * i, 7e6 * (-1) ** (i // 2), 0.0], 0) for i in range(9)),  # beyond 32 bits
             (1000, [0.5, 0.25], 0), (1001, [1.0, 1.0], 0), (1050, [2.0] * 3, 0), (953, [float("inf")] * 64, 0)]
    got = topk.top_k(table(spark, rows), F.col("vec_id") % 50 == 0, 5, query_block=7, candidate_block=100)
    found = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    kept = [(i, [int(np.floor(256 * x)) for x in floats(v)]) for i, v, _ in rows if i is not None and usable(v)]
    want = {}
    for i, v in kept:
        if i % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in kept if j != i and len(w) == len(v))
            best = [(k + 1, j, -s) for k, (s, j) in enumerate(scored[:5])]
            if best:
                want[i] = best
    assert found == want and len(found[1000]) == 1 and 1050 not in found


def test_top_k_of_nothing(spark):
    assert topk.top_k(table(spark, []), F.col("vec_id") % 50 == 0, 5).count() == 0
    assert topk.top_k(table(spark, [(1, [1.0], 0)]), F.col("vec_id") % 50 == 0, 5).count() == 0


def brute(rows, least=0.93):
    count, parent = [0] * len(rows), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            (_, v, k), (_, w, m) = rows[a], rows[b]
            if k is None or k != m or not usable(v) or not usable(w) or len(v) != len(w) or not any(v) or not any(w):
                continue
            x, y = np.array(floats(v)), np.array(floats(w))
            if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                count[a] += 1
                count[b] += 1
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return count, [root(a) for a in range(len(rows))]


def test_near_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 50)
    random = np.random.default_rng(5)
    rows = [(i, random.normal(size=16).tolist(), i % 3) for i in range(250)]
    rows += [(1000 + i, (np.array(rows[0][1]) + random.normal(size=16) * 0.12).tolist(), 0) for i in range(180)]
    rows += [(2000 + i, rows[1][1], 1) for i in range(40)] + [(2000, rows[1][1], 1)]
    rows += [(3000, None, 0), (3001, [0.0] * 16, 0), (3002, [0.0] * 16, 0), (3003, [float("nan")] * 16, 0), (3004, rows[0][1], None),
             (3005, [1.0, None], 0), (3006, [1.0, 0.0], 0), (3007, [3.0, 0.0], 0), (3008, [], 0), (None, rows[2][1], 2)]
    got = vectors.near_vectors(table(spark, rows))
    counts, roots = brute(rows)
    ids = [r[0] for r in rows]
    want = []
    for a, key in enumerate(ids):
        members = [ids[b] for b in range(len(ids)) if roots[b] == roots[a] and ids[b] is not None]
        component = min(members) if members else None
        want.append((key, counts[a], component, key is not None and key == component))
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    found = order([tuple(r) for r in got.select("vec_id", "n_links", "component_id", "kept").collect()])
    assert sum(r[1] for r in found) >= 0.9 * sum(counts)
    assert found == order(want)


@pytest.mark.parametrize("span", [8192, 1500])
def test_near_vectors_of_a_one_sided_label(spark, monkeypatch, span):
    """Vectors with a mean cosine of 0.85 to each other, where signs alone tell little."""
    random = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    one = unit(np.sqrt(0.85) * unit(random.normal(size=64)) + np.sqrt(0.15) * unit(random.normal(size=(6000, 64))))
    side = random.normal(size=(400, 64))
    side = unit(side - (side * one[:400]).sum(axis=1, keepdims=True) * one[:400])
    v = np.concatenate([one, 0.932 * one[:400] + np.sqrt(1 - 0.932**2) * side]).astype(np.float32)
    wide = unit(v.astype(np.float64))
    want = (wide @ wide.T >= vectors.LEAST).sum(axis=1) - 1
    monkeypatch.setattr(vectors, "SPAN", span)  # of a label of several spans
    got = vectors.near_vectors(table(spark, [(i, x.tolist(), 1) for i, x in enumerate(v)]), window=24)
    found = np.array([r.n_links for r in got.orderBy("vec_id").collect()])
    assert want.sum() >= 800 and (found <= want).all()
    assert found.sum() >= 0.99 * want.sum()


def test_rounds_follow_the_size_and_the_spread_of_a_label():
    random = np.random.default_rng(9)
    even = vectors._unit(random.normal(size=(2000, 64)))
    sided = vectors._unit(even + 1.5 * even[0])
    number = {
        (name, n): vectors._rounds(*(vectors._hit_rates(x, n, 0.93, reach, 48, 1) for reach in (2048, 128)))
        for name, x in (("even", even), ("sided", sided)) for n in (50_000, 1_600_000, 100_000_000)
    }
    for name in ("even", "sided"):
        assert 1 <= number[name, 50_000] < number[name, 1_600_000] < number[name, 100_000_000]
    assert number["sided", 1_600_000] > number["even", 1_600_000]


def test_links_planted_into_the_given_vectors_are_found(spark, monkeypatch):
    """Recall of the passes alone, with spans and windows far smaller than the labels."""
    from driftline.llm import queries

    monkeypatch.setattr(vectors, "SPAN", 120)
    given = queries.table(spark, "/root/testdata/sf0.1", "embeddings").collect()
    unit = vectors._unit(np.array([r.embedding for r in given], dtype=np.float64))
    random = np.random.default_rng(10)
    origin = random.permutation(len(unit))[:400]
    side = random.normal(size=(400, unit.shape[1]))
    side = vectors._unit(side - (side * unit[origin]).sum(axis=1, keepdims=True) * unit[origin])
    near = 0.9305 * unit[origin] + np.sqrt(1 - 0.9305**2) * side
    v, labels = np.concatenate([unit, near]), np.array([r.label for r in given] + [given[i].label for i in origin])
    v = vectors._unit(v.astype(np.float32).astype(np.float64))
    want = ((v @ v.T >= vectors.LEAST) & (labels[:, None] == labels)).sum(axis=1) - 1
    rows = [(i, x.tolist(), int(label)) for i, (x, label) in enumerate(zip(v, labels, strict=True))]
    got = {r.vec_id: r.n_links for r in vectors.near_vectors(table(spark, rows), window=16).collect()}
    found = np.array([got[i] for i in range(len(v))])
    assert want.sum() >= 790 and (found <= want).all() and found.sum() >= 0.99 * want.sum()


def test_no_vectors(spark):
    assert vectors.near_vectors(table(spark, [])).count() == 0
    row = vectors.near_vectors(table(spark, [(4, [1.0, 2.0], 1)])).first()
    assert (row.vec_id, row.n_links, row.component_id, row.kept) == (4, 0, 4, True)


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(1, i) for i in range(2, 50)] + [(90, 91), (91, 90)]])
def test_components(spark, edges):
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {}
    for a, b in edges:
        if a != b:
            low = 90 if a >= 90 else 0 if len(edges) == 40 else 1
            want[a] = want[b] = low
    assert got == want


def test_a_block_of_near_copies_is_compared_in_bounded_memory():
    """All pairs of 3,000 near copies are links; they are never held at once."""
    import tracemalloc
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    from driftline.llm import jaccard

    count = 3000
    body = " ".join(f"w{i}" for i in range(60))
    block = pa.RecordBatch.from_pydict({
        "component": np.zeros(count, np.int64), "i": np.zeros(count, np.int64), "j": np.zeros(count, np.int64),
        "side": np.zeros(count, np.int64), "node": np.arange(count) + 7, "copies": np.ones(count, np.int64),
        "text": [f"{body} n{i}" for i in range(count)],
    })
    run = jaccard._exact(SimpleNamespace(mapInArrow=lambda run, schema: run), jaccard.WORDS, jaccard.LEAST)
    tracemalloc.start()
    found = list(run(iter([block])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(b.num_rows for b in found) == count
    assert all(set(b["links"].to_pylist()) == {count - 1} and set(b["root"].to_pylist()) == {7} for b in found)
    assert peak < 60e6, peak
