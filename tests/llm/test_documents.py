"""Language, near copies, quality and the pipeline on small tables."""

import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.llm.components import connected_components
from driftline.llm import jaccard, language, quality, queries
from driftline.session import stage

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, mark int, kept int"


def table(spark, rows, source="s"):
    full = [(i, t, lang, source, len(t or ""), "x", 1, 2) for i, t, lang in rows]
    return spark.createDataFrame(full, DOCS).repartition(3)


def test_languages_of_held_out_texts(spark, sf):
    docs = queries.table(spark, sf, "documents")
    found = queries.op1_language(spark, sf).join(docs.select("doc_id", "lang"), "doc_id")
    held = found.where("held_out")
    assert held.count() > 20
    assert held.where("lang_pred = lang").count() >= 0.97 * held.count()
    assert found.where("score < 0 OR score > 1").count() == 0 and found.count() == docs.count()


def test_language_edges(spark):
    rows = [(i, "the cat and the dog " * 5, "en") for i in range(20)] + [(20 + i, "der hund und die katze " * 3, "de") for i in range(20)]
    filters = language.learn(table(spark, rows))
    assert filters.languages == ["de", "en"]
    odd = [(1, None, "en"), (2, "", "en"), (3, "123 ... \n", "en"), (4, "ЖЖЖЖ", "en"), (5, "THE DOG", None), (5, "THE DOG", None),
           (None, "die Katze", None), (6, "der hund " * 300_000, "x")]
    got = {(r.doc_id, r.lang_pred) for r in language.identify(table(spark, odd), filters).collect()}
    assert got == {(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "en"), (None, "de"), (6, "de")}
    assert language.identify(table(spark, odd), filters).count() == len(odd)
    assert language.identify(table(spark, []), filters).count() == 0
    kept = language.keep_identified(table(spark, odd), filters, 0.2)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 5, 5, 6] and kept.columns == table(spark, []).columns
    for nothing in ([], [(1, "123", "en"), (2, None, "en"), (3, "abc", None)]):
        unlearned = language.learn(table(spark, nothing))
        assert {(r.lang_pred, r.score) for r in language.identify(table(spark, odd), unlearned).collect()} == {("und", 0.0)}


def test_parts_of_a_long_text_give_the_same_ngrams(monkeypatch):
    text = "Émile, l'été à Ålesund; ß x" * 9
    whole = np.concatenate(list(language.ngrams(text)))
    for part in (1, 2, 7, 50):
        monkeypatch.setattr(language, "PART", part)
        assert np.array_equal(np.concatenate(list(language.ngrams(text))), whole)


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near_rows():
    chance = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [" ".join(chance.choice(vocabulary) for _ in range(chance.randint(5, 90))) for _ in range(120)]
    for base in texts[:12]:
        words = base.split()
        for _ in range(chance.randint(1, 25)):
            changed = list(words)
            for _ in range(chance.randint(0, 2)):
                changed[chance.randrange(len(changed))] = chance.choice(vocabulary)
            texts.append(" ".join(changed))
    texts += [texts[0].upper(), "  " + texts[1].replace(" ", "\n "), "one two", "One  TWO", "one", None, "", " \n", "é" * 70_000 + " b c d e f"]
    return [(i, t, "en") for i, t in enumerate(texts)] + [(0, texts[0], "en"), (None, texts[3], "en")]


@pytest.mark.parametrize("small", [1000, 4])
def test_join_equals_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "BLOCK_CHARACTERS", 2000)
    monkeypatch.setattr(jaccard.candidate_links, "__defaults__", (0.8, 0.999, 64, small, 10))
    rows = near_rows()
    sets = [shingles(t) for _, t, _ in rows]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                links[a] += 1
                links[b] += 1
                parent[max(root(a), root(b))] = min(root(a), root(b))
    want = []
    for a, (key, *_) in enumerate(rows):
        ids = [rows[b][0] for b in range(len(rows)) if root(b) == root(a)]
        known = [i for i in ids if i is not None]
        want.append((key is None, key or 0, links[a], min(known) if known else -1))
    got = jaccard.jaccard_join(table(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_links, -1 if r.component_id is None else r.component_id) for r in got) == sorted(want)
    by_class = {}
    for r in got:
        by_class.setdefault(r.class_id, set()).add(r.component_id)
    assert all(len(found) == 1 for found in by_class.values())


def test_one_of_each_group_stays(spark):
    rows = near_rows()
    docs = table(spark, rows)
    kept = jaccard.keep_first(docs)
    components = {r.component_id for r in jaccard.jaccard_join(docs).collect()}
    left = sorted(r.doc_id for r in kept.collect())
    assert left == sorted(components) and kept.columns == docs.columns
    assert jaccard.keep_first(table(spark, [])).count() == 0
    same = table(spark, [(1, "a b c d e f", "en")] * 4 + [(2, "A b c d e f", "en")])
    assert [r.doc_id for r in jaccard.keep_first(same).collect()] == [1]


def test_rows_that_stay_keep_their_columns(spark):
    """Whatever the columns are called; of rows with equal key and text always the same one."""
    rows = [(1, "a b c d e f", i % 7, f"s{i}") for i in range(30)] + [(2, "A b c d e f", 0, "z"), (3, None, 1, None)]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id bigint, text string, __mark int, id string").repartition(4)
        kept = jaccard.keep_first(docs)
        assert kept.columns == docs.columns
        assert sorted(map(tuple, kept.collect())) == [(1, "a b c d e f", 6, "s6"), (3, None, 1, None)]


def test_deeper_buckets_take_more_runs(spark):
    counts = [jaccard.run_count(0.8, 0.999, depth) for depth in range(1, 11)]
    assert counts == sorted(counts) and counts[1] == jaccard.run_count(0.8, 0.999) == 4 and counts[-1] > 15
    keys = jaccard.token_keys()
    base = np.arange(200, dtype=np.uint64)
    sets = [np.concatenate([base[:160], 1000 * (i // 2 + 1) + np.arange(40, dtype=np.uint64) + 4 * (i % 2)]) for i in range(600)]
    nodes = [(i, bytearray(jaccard.minhash(jaccard._mix(x.astype(np.uint64)), keys).tobytes())) for i, x in enumerate(sets)]
    classes = spark.createDataFrame(nodes, "node bigint, tokens binary")
    found, depth, deep = jaccard._descend(classes, range(4), 0.8, 64, 3, 10)
    assert depth > jaccard.USUAL_DEPTH and deep
    links = jaccard.candidate_links(classes, small=3)
    root = {r.node: r.component for r in connected_components(links).collect()}
    assert all(root[2 * i] == root[2 * i + 1] for i in range(300))


def test_hash_of_a_set_ignores_case_and_white_space():
    of = jaccard.Shingler()
    assert np.array_equal(of("A b  c\nd e F"), of("a B c d e f"))
    assert len(of("a b c d e f")) == 2 and len(of("a b")) == 1 and len(of(None)) == len(of(" \n")) == 0
    assert not np.intersect1d(of("ab c d e f"), of("a bc d e f")).size
    assert len(of("x " * 100)) == 1 and len(of("y" * 200_000 + " a b c d")) == 1


def quality_rows(count=400):
    chance = random.Random(9)
    words = [f"wo{c}rd" for c in "abcdefghij"]
    rows, labels = [], []
    for i in range(count):
        bad = i % 5 == 0
        body = " ".join(chance.choice(words) + ("###" if bad else "") for _ in range(chance.randint(5, 60)))
        rows.append((i, body, "en"))
        if i % 2 == 0:
            labels.append((i, 0 if bad else 1))
    return rows, labels


def test_quality_of_texts_without_labels(spark):
    rows, labels = quality_rows()
    docs = table(spark, rows)
    named = spark.createDataFrame([*labels, (None, 1), (3, None), (0, 0)], "doc_id bigint, quality int")
    model = quality.learn(docs, named)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    right = sum((got[i] >= 0.5) == (i % 5 != 0) for i in range(1, 400, 2))
    assert right >= 0.97 * 200
    odd = table(spark, [(1, None, None), (1, None, None), (2, "", "en"), (None, "wo word " * 300_000, "en")])
    scores = quality.score(odd, model).collect()
    assert len(scores) == 4 and all(0 <= r.score <= 1 for r in scores)
    kept = quality.keep_good(docs, model, 0.5)
    assert kept.columns == docs.columns and abs(kept.count() - 320) <= 8
    assert quality.score(docs.limit(0), model).count() == 0


def test_quality_without_labels_of_both_kinds(spark):
    rows, _ = quality_rows(20)
    docs = table(spark, rows)
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r.score for r in quality.score(docs, quality.learn(docs, none)).collect()} == {1.0}
    zero = spark.createDataFrame([(1, 0)], "doc_id bigint, quality int")
    assert {r.score for r in quality.score(docs, quality.learn(docs, zero)).collect()} == {0.0}


@pytest.mark.parametrize("rows", [[], [(1, None, None), (1, None, None), (None, "", "en"), (2, "12 34", "en")]])
def test_stages_on_next_to_nothing(spark, sf, rows):
    docs = table(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, sf).collect()
        if name in ("near_copies", "quality"):
            assert len(out) == len(rows)
        if name == "packing":
            assert sum(r.start == 0 for r in out) == len(rows)
        if name == "language_id":
            assert out == []


def test_pipeline_keeps_clean_documents_and_packs_all_of_them(spark, sf):
    docs = queries.table(spark, sf, "documents")
    labels = queries.table(spark, sf, "labels")
    sizes = []
    for name, step in corpus_pipeline.STAGES:
        sizes.append(docs.count())
        after = stage(step(spark, docs, sf), name)
        if name == "language_id":
            assert after.count() == docs.where("text RLIKE '[A-Za-z]'").count()
        if name == "quality":
            lost = docs.join(after, "doc_id", "left_anti").join(labels, "doc_id")
            known = docs.join(labels, "doc_id")
            # Two hundred documents teach little; larger tables lose no clean ones.
            assert lost.where("quality = 1").count() <= 0.02 * known.where("quality = 1").count()
            assert lost.where("quality = 0").count() >= 0.9 * known.where("quality = 0").count()
        if name == "near_copies":
            judged = jaccard.jaccard_join(docs)
            assert after.count() == judged.select("component_id").distinct().count()
        if name == "packing":
            assert after.select("doc_id").distinct().count() == docs.count()
            assert after.agg(F.count_if(F.col("start") == 0)).first()[0] == docs.count()
        else:
            assert after.columns == docs.columns
        docs = after
    assert sizes == sorted(sizes, reverse=True)
