"""The language model: exact counts and base, proper probabilities, held-out gain."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from driftline.llm import lm, seating

SCHEMA = "doc_id bigint, text string, word string, n int, score double"


def tokens(text):
    return (text or "").encode().lower().split() + [lm.END]


def held(key):
    return key is not None and zlib.crc32(str(key).encode()) % 10 == 0


def run(spark, rows, partitions=3, **settings):
    df = spark.createDataFrame([(*r, "w", 1, 0.5) for r in rows], SCHEMA).repartition(partitions, "doc_id", "text")
    model = lm.learn(df.where(~lm.held_out("doc_id")), **settings)
    found = lm.score(df, model)
    return model, sorted(map(tuple, found.select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()), key=repr)


def base_of(rows):
    seen = Counter(w for key, text in rows if not held(key) for w in tokens(text))
    n, v = sum(seen.values()), len(seen)
    return sorted((
        (key, held(key), len(tokens(text)), sum(seen[w] > 0 for w in tokens(text)), n,
         sum(math.log10((seen[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(text)))
        for key, text in rows), key=repr)


def walk(seed, texts=120, length=60, words=50):
    """Texts of a chain of words: each is mostly followed by one of three."""
    rng = random.Random(seed)
    follow = {i: rng.choices(range(words), k=3) for i in range(words)}
    rows = []
    for key in range(texts):
        at, said = rng.randrange(words), []
        for _ in range(length):
            said.append(f"w{at}é" if at % 2 else f"W{at}")
            at = rng.choice(follow[at]) if rng.random() < 0.9 else rng.randrange(words)
        rows.append((key, " ".join(said)))
    return rows


ODD = [(None, "a b a"), (1, None), (2, ""), (3, " \n\t "), (4, "a b a\x0bb\x1cc"), (5, "A a A"), (5, "A a A"), (10**12, "never　seen")]


def close(got, wanted):
    assert [r[:5] for r in got] == [r[:5] for r in wanted]
    assert np.allclose([r[5] for r in got], [r[5] for r in wanted], rtol=1e-10)


@pytest.mark.parametrize("segment, chunk", [(1 << 22, 1_000_000), (9, 20)])
def test_counts_and_base(spark, monkeypatch, segment, chunk):
    monkeypatch.setattr(lm, "SEGMENT", segment)
    monkeypatch.setattr(lm, "TOKENS", chunk)
    rows = [*walk(1, texts=30, length=20), *ODD]
    _, got = run(spark, rows)
    close(got, base_of(rows))
    assert all(math.isfinite(r[6]) and r[6] < 0 for r in got)


def test_probabilities_of_a_context_sum_to_one(spark):
    model, _ = run(spark, walk(2), own=100, classes=50)
    buckets = [lm._bucket(tuple(row), model.contexts, len(model.floors)) for row in model.rows.select(*lm._names(lm._MODEL)).collect()]
    looks = [lm.Lookup(bucket, model.contexts, model.floors, model.base) for bucket in buckets]
    assert sum(look.words.rows for look in looks) == model.distinct and len(model.contexts.words) > 20
    for context in range(len(model.contexts.parent)):
        known = sum(look.probability(np.arange(look.words.rows), np.full(look.words.rows, context)).sum() for look in looks)
        assert known + looks[0].probability(np.array([-1]), np.array([context]))[0] == pytest.approx(1)


def test_held_out_texts_are_likelier_than_their_base(spark):
    _, got = run(spark, walk(3), own=1000)
    out = [r for r in got if r[1]]
    assert len(out) > 5 and sum(r[6] for r in out) > 0.75 * sum(r[5] for r in out)


def test_result_does_not_depend_on_spreading(spark, monkeypatch):
    rows = [*walk(4, texts=40), *ODD]
    _, one = run(spark, rows, 1)
    monkeypatch.setattr(lm, "TOKENS", 100)
    monkeypatch.setattr(lm, "BUCKET", 100)
    _, many = run(spark, rows, 7)
    assert [r[:5] for r in one] == [r[:5] for r in many]
    assert np.allclose([r[6] for r in one], [r[6] for r in many], rtol=1e-5)


def test_frequent_pairs_score_as_all_others(spark):
    rows = walk(5, texts=40)
    df = spark.createDataFrame([(*r, "w", 1, 0.5) for r in rows], SCHEMA)
    model = lm.learn(df, samples=1)
    all_local, none_local = (
        {r.doc_id: (r.n_known, r.base_score, r.score) for r in lm.score(df, model, share).collect()} for share in (10**9, 1)
    )
    assert all(np.allclose(all_local[k], none_local[k], rtol=1e-5) for k in all_local)


def test_nothing_to_learn_from(spark):
    _, got = run(spark, [(k, "a b") for k in range(60) if held(k)])
    assert got and all(r[3:] == (0, 0, 0.0, 0.0) for r in got)
    assert run(spark, [])[1] == []


def test_long_text(spark):
    rows = [(1, "alpha beta " * 300_000), (2, "x" * 3_000_000), *walk(6, texts=12)]
    close(run(spark, rows, samples=1)[1], base_of(rows))


def test_tables_are_drawn_by_their_weight():
    floor = seating.Floor(0.6, 2.0, np.array([7.0]), np.array([20.0]))
    size, base, n = 6, 0.3, 40_000
    weights = np.zeros(size + 1)

    def seat(blocks, left, weight):
        if not left:
            weights[len(blocks)] += weight
            return
        for i, b in enumerate(blocks):
            seat([*blocks[:i], b + 1, *blocks[i + 1 :]], left - 1, weight * (b - 0.6))
        seat([*blocks, 1], left - 1, weight * (2.0 + 0.6 * (7 + len(blocks))) * base)

    seat([], size, 1.0)
    drawn = seating.draw_tables(
        np.full(n, size), np.full(n, 7.0), np.full(n, base), floor, seating.log_seatings(0.6), seating.uniform(np.arange(n)))
    shares = np.bincount(drawn, minlength=size + 1) / n
    assert np.allclose(shares, weights / weights.sum(), atol=0.01)


def test_tables_of_very_many_customers():
    floor = seating.Floor(0.5, 10.0, np.array([0.0]), np.array([0.0]))
    customers = np.array([100, 200, 201, 10_000, 10**9])
    drawn = [
        seating.draw_tables(customers, np.zeros(5), np.full(5, 0.1), floor, seating.log_seatings(0.5), seating.uniform(np.arange(5), turn))
        for turn in range(50)
    ]
    means = np.mean(drawn, 0)
    assert (np.diff(means) > 0).all() and (np.max(drawn, 0) <= customers).all()
    # Others being equal, strength / discount + tables grow with this power of the customers.
    assert (20 + means[4]) / (20 + means[3]) == pytest.approx(10 ** (5 * 0.5 * 0.1), rel=0.1)
