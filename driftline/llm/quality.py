"""Quality classifier by co-training of a text view and a metadata view.

The text view sees hashed character trigrams of the whole text and trigrams of
its shape (letters, digits, spaces, signs), and how often a word or a line
repeats the one before; the metadata view sees source,
language and length as the table states them. Both are logistic models. In
each round, each view labels the unlabelled texts of which it is surest, in
the proportion of the labels, and the other view learns from them too. Each
view is calibrated on labelled rows that neither learned from, a model over
both calibrated log-odds combines them, and all documents are scored.

The fit reads at most about ``labelled`` labelled and ``pool`` unlabelled rows,
chosen by a hash of their keys; scoring reads all rows.

Null and empty texts have no trigrams and are scored by their metadata; null
metadata is a value of its own. A key with several labels has their majority,
a tie counts as good. Without two labels of either kind every score is the share of
good labels (1 without any). Null keys and repeated rows are kept, an empty
table gives an empty result, and other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import once, slices

LABELLED = 4000
POOL = 4000
ROUNDS = 3
# Texts that one view gives the other in a round, and the least certainty.
GIVEN = 400
SURE = 0.95
LETTERS, SHAPES, REPEATS = 512, 256, 8
PART = 1 << 20
META = 1 + 64 + 16 + 16


def _shape_table() -> np.ndarray:
    """One small code per kind of character; signs of ASCII keep their own."""
    table = np.full(0x110000, 6, dtype=np.uint32)
    for code in range(0x30000):
        c = chr(code)
        if c.isalpha():
            table[code] = 2 if c.isupper() else 1
        elif c.isdigit():
            table[code] = 3
        elif c == "\n":
            table[code] = 5
        elif c.isspace():
            table[code] = 4
        elif code < 128:
            table[code] = 8 + code
    return table


def _trigrams(codes: np.ndarray, cells: int) -> np.ndarray:
    value = codes[:-2].astype(np.uint64)
    for more in (codes[1:-1], codes[2:]):
        value = value * np.uint64(0x100000001B3) + more
    value = (value ^ (value >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return np.bincount((value >> np.uint64(40)).astype(np.int64) % cells, minlength=cells)


def text_features(text: str | None) -> np.ndarray:
    """Square roots of trigram shares and of shares of repeats."""
    shapes = once("shapes", _shape_table)
    letters, shape = np.zeros(LETTERS), np.zeros(SHAPES)
    text = text or ""
    for start in range(0, len(text), PART):
        codes = np.frombuffer(text[start : start + PART + 2].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        if len(codes) > 2:
            letters += _trigrams(codes, LETTERS)
            shape += _trigrams(shapes[codes], SHAPES)
    total = max(1.0, letters.sum())
    repeats = np.zeros(REPEATS)
    for place, parts in ((0, text.split()), (4, [x for x in text.split("\n") if x])):
        # Shares of parts that are equal to the one, two and three before, and of repeated ones.
        for back in (1, 2, 3):
            equal = sum(map(eq, parts, islice(parts, back, None)))
            repeats[place + back - 1] = equal / max(1, len(parts))
        repeats[place + 3] = 1 - len(set(parts)) / max(1, len(parts)) if place else 0
    return np.concatenate([np.sqrt(letters / total), np.sqrt(shape / total), np.sqrt(repeats)]).astype(np.float32)


def _slot(value: str | None, cells: int) -> int:
    hashed = 7
    for byte in (value or "").encode():
        hashed = (hashed * 31 + byte) % 1_000_003
    return 0 if value is None else 1 + hashed % (cells - 1)


def meta_features(source: str | None, lang: str | None, length: float | None) -> np.ndarray:
    out = np.zeros(META, dtype=np.float32)
    out[0] = np.log1p(max(length or 0, 0)) / 10
    out[1 + _slot(source, 64)] = 1
    out[65 + _slot(lang, 16)] = 1
    out[81 + (0 if length is None else min(15, 1 + int(np.log2(max(length, 0) + 1))))] = 1
    return out


def fit_logistic(
    x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, steps: int = 150, start: np.ndarray | None = None
) -> np.ndarray:
    """Weights with the bias last, by accelerated gradient steps; both classes weigh the same."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float32)
    y = y.astype(np.float32)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())).astype(np.float32)
    scale = np.float32(0.25 * float((weight * np.einsum("ij,ij->i", x, x)).sum()) + ridge)
    w = np.zeros(x.shape[1], np.float32) if start is None else start.astype(np.float32)
    ahead, before = w, w
    for step in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        w = ahead - (x.T @ (weight * (p - y)) + np.float32(ridge) * ahead) / scale
        ahead, before = w + np.float32(step / (step + 3)) * (w - before), w
    return w


def log_odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def _chance(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


@dataclass(frozen=True)
class QualityModel:
    text: np.ndarray
    meta: np.ndarray
    text_scale: np.ndarray  # slope and offset of the calibrated log-odds
    meta_scale: np.ndarray
    both: np.ndarray
    constant: float | None = None

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chance of good by text, by metadata, and by both."""
        if self.constant is not None:
            same = np.full(len(text), self.constant)
            return same, same, same
        t = log_odds(log_odds(text, self.text)[:, None], self.text_scale)
        m = log_odds(log_odds(meta, self.meta)[:, None], self.meta_scale)
        return _chance(t), _chance(m), _chance(log_odds(np.stack([t, m], axis=1), self.both))


def co_train(
    text: np.ndarray, meta: np.ndarray, y: np.ndarray, aside: np.ndarray,
    pool_text: np.ndarray, pool_meta: np.ndarray, rounds: int = ROUNDS, given: int = GIVEN,
) -> QualityModel:
    """Fit both views from labelled rows, those ``aside`` only to calibrate."""
    good = y[~aside].mean()
    views = [(text[~aside], pool_text), (meta[~aside], pool_meta)]
    labels = [y[~aside], y[~aside]]
    added: list[dict[int, int]] = [{}, {}]  # pool row to label, learned from the other view
    models: list = [None, None]
    for turn in range(rounds + 1):
        for view, (own, pool) in enumerate(views):
            rows = sorted(added[view])
            x = np.concatenate([own, pool[rows]]) if rows else own
            given_labels = np.array([added[view][r] for r in rows], dtype=float)
            models[view] = fit_logistic(x, np.concatenate([labels[view], given_labels]), start=models[view])
        if turn == rounds or not len(pool_text):
            break
        for view, (_, pool) in enumerate(views):
            chance = _chance(log_odds(pool, models[view]))
            order = np.argsort(chance, kind="stable")
            other = added[1 - view]
            bad = [int(r) for r in order[: max(1, round(given * (1 - good)))] if chance[r] <= 1 - SURE]
            fine = [int(r) for r in order[::-1][: max(1, round(given * good))] if chance[r] >= SURE]
            other.update({r: 0 for r in bad if r not in other})
            other.update({r: 1 for r in fine if r not in other})
    odds = [log_odds(text[aside], models[0]), log_odds(meta[aside], models[1])]
    scales = [fit_logistic(o[:, None], y[aside], 1e-3) for o in odds]
    calibrated = np.stack([log_odds(o[:, None], s) for o, s in zip(odds, scales, strict=True)], axis=1)
    return QualityModel(models[0], models[1], *scales, fit_logistic(calibrated, y[aside], 1e-3))


def _features(docs: DataFrame, text: str, source: str, lang: str, length: str, more: list) -> DataFrame:
    """Both views of every row as bytes, and the columns ``more``."""
    picked = docs.select(
        F.col(text).alias("text"), F.col(source).cast("string").alias("source"),
        F.col(lang).cast("string").alias("lang"), F.col(length).cast("double").alias("length"), *more,
    )
    rest = picked.schema[4:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            bodies, sources, langs, lengths = (batch.column(i).to_pylist() for i in range(4))
            texts = [text_features(x).astype(np.float16).tobytes() for x in bodies]
            metas = [meta_features(*x).tobytes() for x in zip(sources, langs, lengths, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.binary()), pa.array(metas, pa.binary()), *batch.columns[4:]],
                names=["text_view", "meta_view", *batch.schema.names[4:]],
            )

    kept = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rest)
    return picked.mapInArrow(run, f"text_view binary, meta_view binary{kept}")


def _arrays(rows) -> tuple[np.ndarray, np.ndarray]:
    text = np.frombuffer(b"".join(rows["text_view"]), dtype=np.float16).reshape(-1, LETTERS + SHAPES + REPEATS)
    meta = np.frombuffer(b"".join(rows["meta_view"]), dtype=np.float32).reshape(-1, META)
    return text.astype(np.float32), meta


def learn(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    lang: str = "lang", length: str = "n_chars", label: str = "quality",
    labelled: int = LABELLED, pool: int = POOL, rounds: int = ROUNDS,
) -> QualityModel:
    """Co-train on bounded samples of the labelled and of the unlabelled rows."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(
        (F.avg(label) >= 0.5).cast("int").alias("y")
    )
    spread = F.pmod(F.xxhash64(F.lit(9), "key"), F.lit(1 << 20))
    some = known.where(spread < int(min(1.0, labelled / max(1, known.count())) * (1 << 20)) + 1)
    columns = (text, source, lang, length)
    own = docs.select(F.col(key).alias("key"), *(F.col(c).alias(f"own_{i}") for i, c in enumerate(columns)))
    columns = tuple(f"own_{i}" for i in range(len(columns)))
    # The sample of labels is bounded by ``labelled``.
    rows = _features(own.join(F.broadcast(some), "key"), *columns, ["key", "y"]).toPandas()
    total = own.count()
    spare = own.where(spread < int(min(1.0, pool / max(1, total)) * (1 << 20)) + 1).join(known, "key", "left_anti")
    more = _features(spare, *columns, []).toPandas()
    rows = rows.iloc[np.lexsort((pd.util.hash_array(rows["key"].to_numpy()), rows["y"].to_numpy()))]
    y = rows["y"].to_numpy(dtype=float)
    # One in five of either kind only calibrates, in an order that keys do not tell.
    place = np.arange(len(y)) - np.searchsorted(y, y)
    aside = place % 5 == 0
    if not all((y[part] == kind).any() for part in (aside, ~aside) for kind in (0, 1)):
        none = np.zeros(0)
        return QualityModel(none, none, none, none, none, float(y.mean()) if len(y) else 1.0)
    return co_train(*_arrays(rows), y, aside, *_arrays(more), rounds=rounds)


def score(
    docs: DataFrame, model: QualityModel, key: str = "doc_id", text: str = "text",
    source: str = "source", lang: str = "lang", length: str = "n_chars",
) -> DataFrame:
    """Key, ``text_score``, ``meta_score`` and ``score`` (chance of good) of every row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores = _batch_scores(model, *(batch.column(i).to_pylist() for i in range(1, 5)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.float64()) for x in scores)],
                names=[key, "text_score", "meta_score", "score"],
            )

    return docs.select(
        F.col(key), F.col(text), F.col(source).cast("string"), F.col(lang).cast("string"), F.col(length).cast("double")
    ).mapInArrow(run, f"`{key}` {kind}, text_score double, meta_score double, score double")


def _batch_scores(model: QualityModel, bodies: list, sources: list, langs: list, lengths: list):
    texts = np.stack([text_features(x) for x in bodies]).astype(np.float16).astype(np.float32)
    metas = np.stack([meta_features(*x) for x in zip(sources, langs, lengths, strict=True)])
    return model.scores(texts, metas)


def keep_good(
    docs: DataFrame, model: QualityModel, least: float, text: str = "text",
    source: str = "source", lang: str = "lang", length: str = "n_chars",
) -> DataFrame:
    """The rows, unchanged, whose chance of good is at least ``least``."""
    at = [docs.columns.index(c) for c in (text, source, lang, length)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            views = [batch.column(i).to_pylist() for i in at]
            views[1:3] = [[None if x is None else str(x) for x in view] for view in views[1:3]]
            yield batch.filter(pa.array(_batch_scores(model, *views)[2] >= least))

    return docs.mapInArrow(run, docs.schema)
