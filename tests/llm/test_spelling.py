"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from driftline.llm import spelling


def apart(a, b):
    """Whether one letter replaced, inserted or deleted leads from a to b."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(rows):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    near = {w: [v for v in words if apart(w, v)] for w in words}
    form = {}
    for word, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[word] = best if best and words[best] >= 5 * words[word] else None

    def root(word):
        return root(form[word]) if form[word] else word

    return sorted((w, form[w], root(w), words[w], len(near[w]), words.get(form[w])) for w in words)


def run(spark, rows, **settings):
    df = spark.createDataFrame([(t, k, "x", 1, None) for k, t in rows], "text string, doc_id bigint, word string, n int, list string")
    found = spelling.group_variants(df, **settings)
    return sorted(map(tuple, found.select("word", "form", "root", "n", "n_near", "form_n").collect()))


def made_rows(seed, words=150, letters="abcé÷", texts=60):
    rng = random.Random(seed)
    base = ["".join(rng.choices(letters, k=rng.randint(5, 10))) for _ in range(words)]
    for _ in range(words):
        word = rng.choice(base)
        at = rng.randrange(len(word) + 1)
        base.append(word[:at] + rng.choice(["", rng.choice(letters)]) + word[at + rng.randint(0, 1) :])
    weights = [1 / (i + 1) for i in rng.sample(range(len(base)), len(base))]
    return [(k, " ".join(rng.choices(base, weights, k=400)).upper() if k % 3 else ",".join(base)) for k in range(texts)]


@pytest.mark.parametrize("seed, share, block", [(1, 1000, 4096), (2, 40, 4096), (3, 5, 7)])
def test_all_near_words_are_found(spark, seed, share, block):
    rows = made_rows(seed)
    got = run(spark, rows, share=share, block=block)
    assert got == brute(rows)
    assert sum(r[4] for r in got) > 300


def test_forms_lead_to_a_root_and_ties_go_to_the_first(spark):
    counts = {"aaaaaa": 3000, "aaaaab": 600, "aaaabb": 100, "aaabbb": 20, "zzzzzz": 25, "zzzzzy": 25, "zzzzz": 900, "zzzzzx": 5,
              "lonely": 7, "rarely": 4}
    rows = [(7, " ".join([w] * c)) for w, c in counts.items()]
    got = run(spark, rows)
    assert got == brute(rows)
    by_word = {r[0]: r for r in got}
    assert by_word["aaabbb"][2] == "aaaaaa" and by_word["lonely"][1] is None and "rarely" not in by_word
    assert by_word["zzzzzx"][1] == "zzzzzy"


def test_nulls_repeated_rows_and_long_words(spark):
    long = "ab" * 5000
    rows = [(None, "letter" * 1 + " lettex"), (1, None), (2, ""), (3, "letter lettex " * 5), (3, "letter lettex " * 5),
            (4, " ".join([long] * 30 + [long[1:]] * 6 + [long[:-1] + "c"] * 6)), (5, "x" * 200_000)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
