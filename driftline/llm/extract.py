"""Main text of web pages by gradient-boosted trees over their elements.

Every element gets features of its subtree (text, link and element density),
its attribute words, its depth and its siblings. Boosted trees give each the
log-odds of belonging to the article. A page is decoded as a whole: an element
can only be kept inside kept ones, and of all such choices the one with the
largest sum of log-odds wins, so no ancestor and descendant contradict.

The trees learn from elements that the pages themselves mark: what stands
inside article or main elements, against navigation, headers, footers, asides,
notices, adverts, forms and comments. Each is learned from three times: as it
is, with its marks hidden, so that pages without marks are judged by density,
and with its marks beside the other features of another element, so that marks
weigh more than the habits of one site. Outside elements are also shown as if inside an article. At most about ``PAGES`` pages are read
to learn.

Null and empty html gives an empty text, and so does a page without an
article. Html may be cut off or wrongly nested. Texts of any length are read
whole; null keys and repeated rows are kept; an empty table gives an empty
result; other columns are ignored. Where pages mark nothing, long texts with
few links count as content for learning.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import slices
from driftline.llm.dom import FEATURES, NAMED, Page, features, kept_text

PAGES = 1500
TREES, DEPTH, BINS, RATE = 40, 4, 32, 0.3


@dataclass(frozen=True)
class Trees:
    """Complete binary trees: feature and threshold of each inner node, value of each leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    start: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total += value[at - len(feature)]
        return total


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, rate: float = RATE) -> Trees:
    """Boosted trees for the logistic loss, split on quantile bins."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    total = np.full(len(y), start)
    inner = 2**DEPTH - 1
    all_features, all_thresholds, all_values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        gradient, curve = y - p, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
        at = np.zeros(len(y), dtype=np.int64)
        for level in range(DEPTH):
            first, count = 2**level - 1, 2**level
            node = at - first
            best = np.full(count, 1e-6)
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                cell = node * (BINS + 1) + binned[:, f]
                g = np.bincount(cell, gradient, count * (BINS + 1)).reshape(count, -1).cumsum(axis=1)
                h = np.bincount(cell, curve, count * (BINS + 1)).reshape(count, -1).cumsum(axis=1)
                right_g, right_h = g[:, -1:] - g, h[:, -1:] - h
                gain = g**2 / (h + 1) + right_g**2 / (right_h + 1) - g[:, -1:] ** 2 / (h[:, -1:] + 1)
                gain = gain[:, : len(c)]
                place = gain.argmax(axis=1)
                top = gain[np.arange(count), place]
                better = top > best
                best[better] = top[better]
                feature[first : first + count][better] = f
                threshold[first : first + count][better] = c[place[better]]
            at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > threshold[at])
        leaf = at - inner
        g = np.bincount(leaf, gradient, inner + 1)
        h = np.bincount(leaf, curve, inner + 1)
        value = rate * g / (h + 1)
        total += value[leaf]
        all_features.append(feature)
        all_thresholds.append(threshold)
        all_values.append(value)
    return Trees(np.stack(all_features), np.stack(all_thresholds), np.stack(all_values), start)


def decode(parents: Sequence[int], odds: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Kept elements: the choice with the largest sum that keeps nothing inside a dropped one.

    ``own`` is the length of an element's own text, negative if it is never
    shown. Elements without text of their own only count for what is in them.
    """
    gain = np.where(own > 0, odds * np.log1p(np.maximum(own, 0)), np.minimum(odds, 0) * 0.1)
    worth = gain.tolist()
    shown = own >= 0
    for i in range(len(parents) - 1, 0, -1):
        if shown[i] and worth[i] > 0:
            worth[parents[i]] += worth[i]
    keep = np.zeros(len(parents), dtype=bool)
    keep[0] = True
    for i in range(1, len(parents)):
        keep[i] = keep[parents[i]] and shown[i] and worth[i] > 0
    return keep


def learn(pages: DataFrame, key: str = "page_id", html: str = "html", most: int = PAGES) -> Trees:
    """Boost trees on the marked elements of a bounded sample of pages."""
    body = pages.select(F.col(key).alias("key"), F.col(html).alias("html")).where("html IS NOT NULL")
    spread = F.pmod(F.xxhash64(F.lit(8), "key"), F.lit(1 << 20))
    some = body.where(spread < int(min(1.0, most / max(1, body.count())) * (1 << 20)) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for html_of in batch.column(1).to_pylist():
                x, label, _ = features(Page(html_of))
                if not (label >= 0).any():
                    long = (x[:, 23] > np.log1p(25)) & (x[:, 20] < 0.3)
                    label = np.where(x[:, 19] > 0, long.astype(int), -1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[label >= 0].tobytes()]), pa.array([label[label >= 0].astype(np.uint8).tobytes()])],
                    names=["x", "y"],
                )

    rows = some.select("key", "html").mapInArrow(run, "x binary, y binary").toPandas()  # bounded by ``most``
    x = np.frombuffer(b"".join(rows["x"]), dtype=np.float32).reshape(-1, FEATURES)
    y = np.frombuffer(b"".join(rows["y"]), dtype=np.uint8).astype(np.float64)
    if not len(y):
        none = np.zeros((0, 2**DEPTH - 1))
        return Trees(none.astype(np.int64), none, np.zeros((0, 2**DEPTH)), 0.0)
    order = np.lexsort((*x.T, y))  # whatever order the rows came in
    x, y = x[order], y[order]
    unmarked, moved = x.copy(), x.copy()
    unmarked[:, :NAMED] = 0
    moved[:, NAMED:] = x[np.random.default_rng(len(x)).permutation(len(x)), NAMED:]
    # What is marked as outside stays outside when it stands inside an article.
    nested = moved[y == 0].copy()
    nested[:, 3] = 1
    return boost(np.concatenate([x, unmarked, moved, nested]), np.concatenate([y, y, y, y[y == 0]]))


def main_text(source: str | None, trees: Trees) -> str:
    page = Page(source or "")
    x, _, own = features(page)
    return kept_text(page, decode(page.parents, trees.log_odds(x), own))


def extract(
    pages: DataFrame, trees: Trees, key: str = "page_id", html: str = "html", keep: Sequence[str] = ()
) -> DataFrame:
    """Key, the columns ``keep``, and ``text`` of every row."""
    kept = pages.select(F.col(key), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            read = [Page(x or "") for x in batch.column(0).to_pylist()]
            found = [features(page) for page in read]
            # One pass of the trees over the elements of all pages of the slice.
            odds = trees.log_odds(np.concatenate([x for x, _, _ in found]))
            texts, start = [], 0
            for page, (x, _, own) in zip(read, found, strict=True):
                texts.append(kept_text(page, decode(page.parents, odds[start : start + len(x)], own)))
                start += len(x)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(texts, pa.string())], names=[*batch.schema.names[1:], "text"]
            )

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return pages.select(F.col(html), F.col(key), *keep).mapInArrow(run, f"{columns}, text string")
