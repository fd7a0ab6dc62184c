"""URL filters: rules first, then the likelihood ratio of two character models.

A url's host and path are cut out with Spark expressions; the longest rule that
fits decides. Two smoothed variable-order Markov models, one of the urls that
rules allow and one of those that they block, judge the rest: each character's
probability is interpolated from the longest context that was seen down to no
context, and the difference of the mean log-likelihoods is compared with a
threshold that was calibrated on urls the models had not seen.

Counts cover all urls that a rule decides. A character and the longest context
before it, one gram, tell all shorter contexts, so both models are one table of
grams that grows with the urls; counts of every order are sums over it. Each
distinct gram of the urls that no rule decides gets its log-likelihood
difference once, where the grams of its context meet, and urls the sum over
their grams. Nothing is hashed into shared cells and no model is sent to the
tasks.

A null url and one without ``://`` have an empty host and path, no rule, and a
score of 0. Urls of any length are read whole. Null keys and repeated rows are
kept, an empty table gives an empty result, and other columns are ignored.
Without urls of one kind that kind's model is uniform and the threshold is 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.llm.common import slices
from driftline.session import stage

ALLOW, BLOCK = "allow", "block"
ORDER = 5
# Weight of the shorter context in characters, and the number of characters.
SHORTER = 2.0
ALPHABET = 256.0
# One in so many ruled urls calibrates the threshold.
CALIBRATION = 5
BINS = 400
START, STOP = 1, 2
# Urls scored together.
CHUNK = 8192


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z in lower case), path, and all that follows ``://``."""
    after = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, letters, letters.lower()), path, after


def rule_column(rules: Sequence[Rule], host: Column, path: Column, value) -> Column:
    """``value`` of the longest rule that fits, else null."""
    decided = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        decided = F.when(fits, F.lit(value(rule))).otherwise(decided)
    return decided


@dataclass(frozen=True)
class UrlModel:
    """``grams``: each gram's number in allowed and blocked urls, apart and set aside."""

    grams: DataFrame
    threshold: float


def _grams(url: str) -> Counter[str]:
    """Each character of a url with the ``ORDER`` before it, and how often."""
    padded = chr(START) * ORDER + url + chr(STOP)
    return Counter(padded[at : at + ORDER + 1] for at in range(len(url) + 1))


def _count_grams(ruled: DataFrame) -> DataFrame:
    """gram and its numbers by verdict and set aside or not, of urls that a rule decides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8192):
            counts: dict[tuple[str, bool], Counter[str]] = {}
            for url, *kind in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                counts.setdefault(tuple(kind), Counter()).update(_grams(url))
            for (verdict, aside), found in counts.items():
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([verdict] * len(found)), pa.array([aside] * len(found)),
                        pa.array(list(found)), pa.array(list(found.values()), pa.int64()),
                    ],
                    names=["verdict", "aside", "gram", "n"],
                )

    def number(verdict: str, aside: bool) -> Column:
        return F.sum(F.when((F.col("verdict") == verdict) & (F.col("aside") == F.lit(aside)), F.col("n")).otherwise(0))

    return ruled.select("after", "verdict", "aside").mapInArrow(
        run, "verdict string, aside boolean, gram string, n bigint"
    ).groupBy("gram").agg(
        *(number(v, a).alias(f"{v}_{'aside' if a else 'apart'}") for v in (ALLOW, BLOCK) for a in (False, True))
    )


def _context(order: int) -> Column:
    """The ``order`` characters before the last one of a gram."""
    return F.substring("gram", ORDER + 1 - order, order)


def _seen(order: int) -> Column:
    """The last character of a gram and the ``order`` before it."""
    return F.substring("gram", ORDER + 1 - order, order + 1)


def _chances(lower: dict[str, Column], seen: str, context: str) -> dict[str, Column]:
    """Probability of a character in each kind of url, interpolated with that of the shorter context."""
    return {
        v: (F.coalesce(f"{seen}_{v}", F.lit(0)) + SHORTER * lower[v]) / (F.coalesce(f"{context}_{v}", F.lit(0)) + SHORTER)
        for v in (ALLOW, BLOCK)
    }


def _pair_chances(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """Probabilities of the last character of ``pairs`` (two characters) after the first."""

    def sums(key: Column, name: str) -> DataFrame:
        return counts.groupBy(key.alias(name)).agg(*(F.sum(v).alias(f"{name}_{v}") for v in (ALLOW, BLOCK)))

    everything = counts.agg(*(F.coalesce(F.sum(v), F.lit(0)).alias(f"all_{v}") for v in (ALLOW, BLOCK)))
    rows = (
        pairs.withColumn("before", F.substring("pair", 1, 1)).withColumn("last", F.substring("pair", 2, 1))
        .join(sums(_seen(0), "last"), "last", "left").join(sums(_context(1), "before"), "before", "left")
        .join(sums(_seen(1), "pair"), "pair", "left").crossJoin(F.broadcast(everything))
    )
    chances = _chances({v: F.lit(1 / ALPHABET) for v in (ALLOW, BLOCK)}, "last", "all")
    chances = _chances(chances, "pair", "before")
    return rows.select("pair", *(chances[v].alias(f"lower_{v}") for v in (ALLOW, BLOCK)))


def _differences(wanted: DataFrame, grams: DataFrame, whole: bool) -> DataFrame:
    """``difference``: log-likelihood allowed less blocked of each distinct gram in ``wanted``.

    Grams with the same two characters before the last one meet in one task,
    and all counts of longer contexts are sums there. Single characters and
    pairs of them are few and come by joins.
    """
    counts = grams.select(
        "gram", *((F.col(f"{v}_apart") + (F.col(f"{v}_aside") if whole else 0)).alias(v) for v in (ALLOW, BLOCK))
    )
    pairs = stage(_pair_chances(wanted.select(_seen(1).alias("pair")).distinct(), counts), "pairs")
    asked = wanted.select("gram", *(F.lit(0).cast("bigint").alias(v) for v in (ALLOW, BLOCK)), F.lit(True).alias("asked"))
    every = counts.withColumn("asked", F.lit(False)).unionByName(asked).groupBy("gram").agg(
        *(F.sum(v).alias(v) for v in (ALLOW, BLOCK)), F.max("asked").alias("asked")
    )
    near = every.withColumn("near", _context(2)).repartition("near")
    for order in range(2, ORDER + 1):
        for name, key in (("context", _context(order)), ("seen", _seen(order))):
            group = Window.partitionBy("near", "key")
            near = near.withColumn("key", key).withColumns({f"{name}{order}_{v}": F.sum(v).over(group) for v in (ALLOW, BLOCK)})
    rows = near.where("asked").withColumn("pair", _seen(1)).join(pairs, "pair")
    chances = {v: F.col(f"lower_{v}") for v in (ALLOW, BLOCK)}
    for order in range(2, ORDER + 1):
        chances = _chances(chances, f"seen{order}", f"context{order}")
    return rows.select("gram", (F.log(chances[ALLOW]) - F.log(chances[BLOCK])).alias("difference"))


def _scored(df: DataFrame, grams: DataFrame, whole: bool) -> DataFrame:
    """All columns and ``url_score``, the mean difference per character of ``after``.

    Urls are dealt with in chunks. A chunk asks for each of its grams once, so
    a gram comes at most once from each chunk and no gram or url is hot.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("__chunk", T.LongType())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        for number, batch in enumerate(slices(batches, CHUNK), first):
            yield batch.append_column("__chunk", pa.array(np.full(batch.num_rows, number)))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks = np.asarray(batch.column(0))
            for chunk in np.unique(chunks):
                urls = batch.column(1).filter(pa.array(chunks == chunk)).to_pylist()
                found = list(set(chain.from_iterable(map(_grams, urls))))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), chunk)), pa.array(found, pa.string())], ["__chunk", "gram"])

    names = df.columns

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        current = None
        for batch in slices(batches, CHUNK):
            gram, text = (batch.column(batch.schema.get_field_index(name)).to_pylist() for name in ("__gram", "after"))
            difference = batch.column(batch.schema.get_field_index("__difference")).to_pylist()
            rows, scores = [], []
            for i, chunk in enumerate(batch.column(batch.schema.get_field_index("__chunk")).to_pylist()):
                if chunk != current:
                    known, current = {}, chunk
                if gram[i] is not None:
                    known[gram[i]] = difference[i]
                else:
                    rows.append(i)
                    found = _grams(text[i])
                    scores.append(sum(known[g] * n for g, n in found.items()) / max(1, len(text[i]) + 1) if text[i] else 0.0)
            kept = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*(kept.column(kept.schema.get_field_index(name)) for name in names), pa.array(scores, pa.float64())], [*names, "url_score"]
            )

    chunked = stage(df.mapInArrow(deal, schema), "urls")
    asked = chunked.where("after <> ''").select("__chunk", "after").mapInArrow(ask, "__chunk bigint, gram string")
    differences = stage(_differences(asked.select("gram").distinct(), grams, whole), "differences")
    answers = asked.join(differences, "gram").select("__chunk", F.col("gram").alias("__gram"), F.col("difference").alias("__difference"))
    together = answers.unionByName(chunked, allowMissingColumns=True)
    return together.repartition("__chunk").sortWithinPartitions("__chunk", F.col("__gram").isNull()).mapInArrow(
        answer, T.StructType([*df.schema.fields, T.StructField("url_score", T.DoubleType())])
    )


def learn(pages: DataFrame, rules: Sequence[Rule], url: str = "url") -> UrlModel:
    """Count the characters of all urls that a rule decides, and calibrate the threshold."""
    host, path, after = url_parts(F.col(url))
    ruled = pages.select(after.alias("after"), rule_column(rules, host, path, lambda r: r.verdict).alias("verdict"))
    ruled = ruled.where("verdict IS NOT NULL").withColumn(
        "aside", F.pmod(F.xxhash64("after"), F.lit(CALIBRATION)) == 0
    )

    grams = stage(_count_grams(ruled), "grams")
    bins = (
        _scored(ruled.where("aside").select("after", "verdict"), grams, whole=False)
        .groupBy("verdict", F.greatest(F.lit(-BINS), F.least(F.lit(BINS), F.floor(F.col("url_score") * 100))).alias("bin"))
        .count().collect()  # at most one row per verdict and bin
    )
    histogram = {v: np.zeros(2 * BINS + 1) for v in (ALLOW, BLOCK)}
    for row in bins:
        histogram[row["verdict"]][row["bin"] + BINS] += row["count"]
    threshold = 0.0
    if histogram[ALLOW].any() and histogram[BLOCK].any():
        kept = 1 - np.concatenate([[0], np.cumsum(histogram[ALLOW])]) / histogram[ALLOW].sum()
        stopped = np.concatenate([[0], np.cumsum(histogram[BLOCK])]) / histogram[BLOCK].sum()
        cuts = (np.arange(2 * BINS + 2) - BINS) / 100
        best = np.flatnonzero(np.isclose(kept + stopped, (kept + stopped).max()))
        threshold = float(cuts[best[np.argmin(np.abs(cuts[best]))]])
    return UrlModel(grams, threshold)


def judge(
    pages: DataFrame, rules: Sequence[Rule], model: UrlModel, key: str = "page_id", url: str = "url"
) -> DataFrame:
    """Key, ``host``, ``path``, ``rule``, ``verdict`` and ``score`` of every row; a rule leaves no score."""
    host, path, after = url_parts(F.col(url))
    parts = pages.select(
        F.col(key), host.alias("host"), path.alias("path"), after.alias("after"),
        rule_column(rules, host, path, lambda r: r.name).alias("rule"),
        rule_column(rules, host, path, lambda r: r.verdict).alias("verdict"),
    )
    open_ = _scored(parts.where("verdict IS NULL").drop("rule", "verdict"), model.grams, whole=True)
    by_score = F.when(F.col("url_score") >= model.threshold, ALLOW).otherwise(BLOCK)
    ruled = parts.where("verdict IS NOT NULL").select(
        key, "host", "path", "rule", "verdict", F.lit(None).cast("double").alias("score")
    )
    nothing = F.lit(None).cast("string").alias("rule")
    return ruled.union(open_.select(key, "host", "path", nothing, by_score, "url_score"))
