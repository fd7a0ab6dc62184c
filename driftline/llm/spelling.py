"""Spelling variants: words one edit apart, found through a variable-length gram index.

Grams of two letters and more are counted over the whole vocabulary; the
dictionary keeps the frequent ones. A word has one gram at every position: its
letters from there on, extended while they are a frequent gram, so common
beginnings make longer grams and lists stay short. An edit leaves all grams
alone that it does not touch, which bounds from below how many a word shares
with any word one edit away; so many of its rarest grams less one need not be
looked up. Words that meet in a list are compared letter by letter.

Grams are at most two letters shorter than the word, so every word keeps one
under any edit and no near word is missed. A list belongs to a pair of lengths,
a position and a gram. Lists beyond ``BLOCK`` words are dealt into pairs of
blocks; only words that are one edit apart leave a task. The dictionary is
bounded by ``SHARE``: it holds grams found in more than one of ``SHARE`` words,
so at most ``SHARE`` times the mean word length for each gram length.

A null text has no words; a null key counts as an empty one where it is hashed.
Texts and words of any length are read whole, repeated rows count again, an
empty table gives an empty result, and other columns are ignored.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.session import stage

LETTERS = "[a-zÀ-ÿ]+"
# One run in so many loses a letter.
DAMAGE = 199
SHORTEST, RAREST = 6, 5
# A form is so many times as frequent as its variant.
RATIO = 5
# Letters of the shortest and longest gram, and the share that makes one frequent.
LEAST_GRAM, MOST_GRAM = 2, 5
SHARE = 1000
BLOCK = 4096
# Letters compared at a time.
COMPARED = 1 << 24
# Bits of a list's number below those of its lengths are a hash; lengths beyond
# this one are told together.
LENGTH_SHIFT, MOST_TOLD = 48, 8000

_POSTINGS = "list bigint, short boolean, word binary, n bigint"
_PAIRS = "a binary, b binary, n_a bigint, n_b bigint"


def runs_of(docs: DataFrame) -> DataFrame:
    """``word``: every run of letters, some of them damaged as their hash says."""
    text = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    found = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"),
        F.explode(F.regexp_extract_all(text, F.lit(f"({LETTERS})"), F.lit(1))).alias("run"),
    )
    hashed = F.crc32(F.concat("key", F.lit(":"), "run").cast("binary"))
    at = F.pmod(hashed, F.char_length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    return found.select(F.when(F.pmod(hashed, F.lit(DAMAGE)) == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(runs: DataFrame, shortest: int = SHORTEST, rarest: int = RAREST) -> DataFrame:
    """``word`` and ``n`` of all words that are long and frequent enough."""
    counted = runs.where(F.char_length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= rarest)


def frequent_grams(words: DataFrame, share: int = SHARE) -> dict[str, int]:
    """Grams in more than one of ``share`` words, with their number of places."""

    def substrings(size: int) -> Column:
        last = F.char_length("word") - size + 1
        return F.transform(F.sequence(F.lit(1), last), lambda at: F.substring(F.col("word"), at, F.lit(size)))

    grams = words.select(F.explode(F.concat(*(substrings(q) for q in range(LEAST_GRAM, MOST_GRAM)))).alias("gram"))
    least = words.count() // share
    return {r.gram: r.places for r in grams.groupBy("gram").agg(F.count("*").alias("places")).where(F.col("places") > least).collect()}


def gram_sizes(word: str, longest: int, frequent: dict[str, int]) -> list[int]:
    """Letters of the gram at every position of ``word``."""
    sizes, end = [], len(word)
    for at in range(end - LEAST_GRAM + 1):
        size, most = LEAST_GRAM, min(longest, end - at)
        while size < most and word[at : at + size] in frequent:
            size += 1
        sizes.append(size)
    return sizes


def least_kept(word: str, sizes: list[int], longest: int, frequent: dict[str, int], edit: str) -> int:
    """Grams that are left whatever one edit is made.

    ``replace`` and ``delete`` touch the grams over a letter, ``insert`` those
    over a gap; at the end it also touches grams that only the end stopped.
    """
    touched = [0] * (len(word) + 2)
    for at, size in enumerate(sizes):
        touched[at + (edit == "insert")] += 1
        touched[at + size] -= 1
    worst = running = 0
    for change in touched:
        running += change
        worst = max(worst, running)
    if edit == "insert":
        stopped = sum(
            at + size == len(word) and size < longest and word[at:] in frequent for at, size in enumerate(sizes)
        )
        worst = max(worst, stopped)
    return len(sizes) - worst


def list_entries(word: str, frequent: dict[str, int]) -> Iterator[tuple[int, bool]]:
    """Lists that a word stands in, and whether it is the shorter word there."""
    size = len(word)
    # Lengths of the pair, the edit that leads from this word to the other one,
    # and where the other word has a gram of this one, as seen by the shorter.
    roles = [(size, size, "replace", (0,)), (size, size + 1, "insert", (0,))]
    if size > SHORTEST:
        roles.append((size - 1, size, "delete", (0, -1)))
    for short, long, edit, shifts in roles:
        longest = max(LEAST_GRAM, min(MOST_GRAM, short - 2))
        sizes = gram_sizes(word, longest, frequent)
        kept = least_kept(word, sizes, longest, frequent, edit)
        grams = [word[at : at + n] for at, n in enumerate(sizes)]
        rarest = sorted(range(len(grams)), key=lambda at: (frequent.get(grams[at], 0), -len(grams[at]), grams[at], at))
        high = 2 * min(short, MOST_TOLD) + (long - short) << LENGTH_SHIFT
        for at in rarest[: len(grams) - kept + 1]:
            for shift in shifts:
                if at + shift >= 0:
                    low = xxhash.xxh3_64_intdigest(f"{short},{long},{at + shift},{grams[at]}".encode())
                    yield high | low >> (64 - LENGTH_SHIFT), edit == "insert"


def postings(words: DataFrame, frequent: dict[str, int]) -> DataFrame:
    """A row for every list that a word stands in."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                lists, shorts, texts, counts = [], [], [], []
                for word, n in zip(*(batch.column(i).slice(start, 1000).to_pylist() for i in range(2)), strict=True):
                    coded = word.encode("latin-1")
                    for number, short in list_entries(word, frequent):
                        lists.append(number)
                        shorts.append(short)
                        texts.append(coded)
                        counts.append(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lists, pa.int64()), pa.array(shorts, pa.bool_()), pa.array(texts, pa.binary()), pa.array(counts, pa.int64())],
                    ["list", "short", "word", "n"],
                )

    return words.select("word", "n").mapInArrow(spread, _POSTINGS)


def deal_long_lists(entries: DataFrame, block: int) -> DataFrame:
    """Lists of more than ``block`` words become one list for each pair of their blocks."""
    sizes = stage(entries.groupBy("list").agg(F.count("*").alias("size")).where(F.col("size") > block), "long-lists")
    if sizes.isEmpty():
        return entries
    blocks = F.ceil(F.coalesce("size", F.lit(0)) / block).cast("int")
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    low = F.shiftrightunsigned(F.xxhash64("list", F.least("own", "other"), F.greatest("own", "other")), 64 - LENGTH_SHIFT)
    high = F.shiftleft(F.shiftright("list", LENGTH_SHIFT), LENGTH_SHIFT)
    dealt = (
        entries.join(sizes, "list", "left").withColumn("blocks", blocks)
        .withColumn("own", F.when(F.col("blocks") > 0, own))
        .withColumn("other", F.explode(F.when(F.col("blocks") > 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(0)))))
    )
    return dealt.select(
        F.when(F.col("blocks") > 0, high.bitwiseOR(low)).otherwise(F.col("list")).alias("list"), "short", "word", "n"
    )


def _whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of sorted entries that end where a list ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = np.asarray(batch.column(0))
        cut = int(np.searchsorted(lists, lists[-1]))
        if held and (cut or np.asarray(held[-1].column(0))[-1] != lists[-1]):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def near_in_lists(table: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.BinaryArray]:
    """Rows one edit apart that share a list: pairs of positions in the table's words."""
    lists = np.asarray(table.column("list").combine_chunks())
    short = np.asarray(table.column("short").combine_chunks().cast(pa.uint8())).astype(bool)
    starts = np.flatnonzero(np.r_[True, lists[1:] != lists[:-1]])
    ends = np.r_[starts[1:], len(lists)]
    number = np.repeat(np.arange(len(starts)), ends - starts)
    end = ends[number]
    # Entries of the shorter word come first; they meet the others of their
    # list. In a list of equal lengths everybody meets those that follow.
    shorter = np.bincount(number, short, len(starts)).astype(np.int64)
    first = np.where(short, (starts + shorter)[number], np.where(shorter[number] > 0, end, np.arange(len(lists)) + 1))
    # A list without a shorter word whose lengths differ has no pairs.
    mixed = (lists >> LENGTH_SHIFT) & 1 == 1
    partners = np.where(mixed & ~short, 0, np.maximum(end - first, 0))
    rows = np.flatnonzero(partners)
    words = table.column("word").combine_chunks()
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    letters = np.frombuffer(words.buffers()[2], np.uint8)
    lengths = np.diff(offsets)
    found_a, found_b = [], []
    at = 0
    totals = np.cumsum(partners[rows] * (lengths[rows] + 1))
    while at < len(rows):
        stop = max(at + 1, int(np.searchsorted(totals, (totals[at - 1] if at else 0) + COMPARED)))
        left = rows[at:stop]
        at = stop
        many = partners[left]
        a = np.repeat(left, many)
        b = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[left], many)
        wide = int(lengths[a].max())
        step = max(1, COMPARED // (wide + 2))
        for begin in range(0, len(a), step):
            pair = _one_edit(letters, offsets, lengths, a[begin : begin + step], b[begin : begin + step])
            found_a.append(a[begin : begin + step][pair])
            found_b.append(b[begin : begin + step][pair])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_a]), np.concatenate([none, *found_b]), words


def _one_edit(letters: np.ndarray, offsets: np.ndarray, lengths: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which words ``a`` become ``b`` by one letter replaced or inserted."""
    size, more = lengths[a], lengths[b] - lengths[a]
    wide = int(size.max()) if len(a) else 0
    place = np.arange(wide)
    inside = place < size[:, None]
    last = len(letters) - 1
    ours = letters[np.minimum(offsets[a][:, None] + place, last)]
    theirs = letters[np.minimum(offsets[b][:, None] + place, last)]
    same = (ours == theirs) & inside
    result = (more == 0) & (same.sum(1) == size - 1)
    longer = np.flatnonzero(more == 1)
    if len(longer):
        ahead = np.minimum.accumulate(same[longer], 1).sum(1)
        shifted = letters[np.minimum(offsets[b[longer]][:, None] + place + 1, last)] == ours[longer]
        behind = np.minimum.accumulate((shifted | ~inside[longer])[:, ::-1], 1).sum(1) - (wide - size[longer])
        result[longer] = ahead + behind >= size[longer]
    return result


def near_pairs(words: DataFrame, frequent: dict[str, int], block: int = BLOCK) -> DataFrame:
    """Words one edit apart, both ways: ``word``, ``near`` and ``near_n``."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_lists(batches):
            a, b, coded = near_in_lists(table)
            if len(a):
                n = table.column("n").combine_chunks()
                ours, theirs = pa.array(a), pa.array(b)
                yield pa.RecordBatch.from_arrays(
                    [coded.take(ours), coded.take(theirs), n.take(ours), n.take(theirs)], ["a", "b", "n_a", "n_b"]
                )

    dealt = deal_long_lists(postings(words, frequent), block)
    sides = dealt.repartition("list").sortWithinPartitions("list", F.desc("short")).mapInArrow(compare, _PAIRS)
    ordered = sides.select(
        F.when(F.col("a") < F.col("b"), F.struct("a", "b", "n_a", "n_b"))
        .otherwise(F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n_b").alias("n_a"), F.col("n_a").alias("n_b")))
        .alias("pair")
    ).distinct().select("pair.*")

    def text(name: str) -> Column:
        return F.decode(name, "ISO-8859-1")

    forth = ordered.select(text("a").alias("word"), text("b").alias("near"), F.col("n_b").alias("near_n"))
    return forth.union(ordered.select(text("b"), text("a"), "n_a"))


def group_variants(docs: DataFrame, share: int = SHARE, block: int = BLOCK) -> DataFrame:
    """``word``, ``n``, ``n_near``, its ``form`` with ``form_n``, and the ``root`` that forms lead to.

    A word's form is its most frequent near word, the first in code-point order
    of equal ones, if that is ``RATIO`` times as frequent.
    """
    words = stage(vocabulary(runs_of(docs)), "words")
    near = near_pairs(words, frequent_grams(words, share), block)
    best = near.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    told = words.join(best, "word", "left")
    chosen = F.coalesce(-F.col("best.less") >= RATIO * F.col("n"), F.lit(False))
    forms = stage(
        told.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(chosen, F.col("best.near")).alias("form"),
            F.when(chosen, -F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    ways = forms.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    most = forms.agg(F.max("n")).first()[0] or 1
    # Every step multiplies the count by RATIO, and every round doubles the steps.
    steps = max(1, math.ceil(math.log(max(most, RATIO), RATIO)))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        beyond = ways.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        ways = stage(ways.join(beyond, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")), "roots")
    found = forms.join(ways, "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
