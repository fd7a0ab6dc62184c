"""Language identification with language-bitmask n-gram filters.

A bit-sliced Bloom filter holds the frequent letter n-grams of all languages:
its cell is a bitmask with one bit per language, and an n-gram's languages are
the AND of its cells. A text is scored by how many of its n-grams have each
language's bit. A filter with fill f and k probes says yes to a foreign n-gram
with probability f**k; each language's share is corrected by that, and the
largest share decides (ties: the alphabetically first language).

There is one n-gram per letter: the character before it, the letter, and up to
two more as far as the word goes, in lower case; any character that is not a
letter counts as the same boundary.

Null text and text without letters give ``und`` with score 0. Other texts get
a learned language, also if none of their n-grams is known (then the most
frequent language, score 0). Null keys and repeated rows are kept, texts of
any length are read whole, an empty table gives an empty result, and other
columns are ignored. Where nothing can be learned (no labelled text with a
letter), every text gets ``und``. Up to 64 languages fit into a bitmask; more
are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import once, slices

UNKNOWN = "und"
# At most about so many labelled texts are read to fill the filters.
TRAINING_TEXTS = 20_000
# An n-gram belongs to a language if it makes up this share of its n-grams.
LEAST_SHARE = 2e-5
CELLS = 1 << 19
PROBES = 3
# Characters of one text that are worked on at a time.
PART = 1 << 20


def _letters() -> np.ndarray:
    """Lower-case code point of every letter, 0 for everything else."""
    table = np.zeros(0x110000, dtype=np.uint32)
    for code in range(0x30000):
        character = chr(code)
        if character.isalpha():
            table[code] = ord(character.lower()[0])
    return table


def _mix(values: np.ndarray) -> np.ndarray:
    values = values ^ (values >> np.uint64(31))
    values = values * np.uint64(0x9E3779B97F4A7C15)
    return values ^ (values >> np.uint64(29))


def ngrams(text: str) -> Iterator[np.ndarray]:
    """64-bit codes of the n-grams of a text, part by part."""
    table = once("letters", _letters)
    for start in range(0, len(text), PART):
        # One character before and two after belong to the part's n-grams.
        part = text[max(0, start - 1) : start + PART + 2]
        codes = table[np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        first = 1 if start else 0
        size = min(PART, len(text) - start)
        codes = np.concatenate([np.zeros(1 - first, np.uint32), codes, np.zeros(2, np.uint32)])
        before, letter = codes[:size], codes[1 : size + 1]
        third, fourth = codes[2 : size + 2], codes[3 : size + 3]
        fourth = np.where(third > 0, fourth, 0)
        at = np.flatnonzero(letter)
        gram = before[at].astype(np.uint64)
        for more in (letter, third, fourth):
            gram = gram * np.uint64(0x100000001B3) + more[at]
        yield _mix(gram)


def _cells(grams: np.ndarray, cells: int, probes: int) -> list[np.ndarray]:
    step = (grams >> np.uint64(32)) | np.uint64(1)
    return [((grams + np.uint64(i) * step) % np.uint64(cells)).astype(np.int64) for i in range(probes)]


@dataclass(frozen=True)
class LanguageFilters:
    languages: list[str]
    masks: np.ndarray
    probes: int
    usual: int  # index of the most frequent language
    wrong: np.ndarray  # how often each filter says yes to a foreign n-gram

    def by_bit(self, found: np.ndarray) -> list[int]:
        """How many of the masks have each language's bit."""
        masks, number = np.unique(found, return_counts=True) if self.masks.dtype.itemsize > 2 else (
            np.arange(1 << len(self.languages)), np.bincount(found, minlength=1 << len(self.languages))
        )
        return [int(number[(masks >> masks.dtype.type(b)) & masks.dtype.type(1) == 1].sum()) for b in range(len(self.languages))]

    def shares(self, text: str) -> tuple[int, np.ndarray]:
        """Number of n-grams, and each language's corrected share of them."""
        total, counts = 0, np.zeros(len(self.languages), dtype=np.int64)
        for grams in ngrams(text):
            found = np.full(len(grams), ~self.masks.dtype.type(0))
            for cell in _cells(grams, len(self.masks), self.probes):
                found &= self.masks[cell]
            total += len(grams)
            counts += self.by_bit(found & self.masks.dtype.type((1 << len(self.languages)) - 1))
        wrong = self.wrong
        return total, np.clip((counts / max(total, 1) - wrong) / (1 - wrong), 0, 1)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages:
            return UNKNOWN, 0.0
        total, shares = self.shares(text or "")
        if not total:
            return UNKNOWN, 0.0
        best = int(np.argmax(shares))
        if shares[best] <= 0:
            return self.languages[self.usual], 0.0
        return self.languages[best], float(shares[best])


def held_out(key: str) -> Column:
    """Rows that learning must not see. A null key is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def learn(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
    most: int = TRAINING_TEXTS, least_share: float = LEAST_SHARE,
    cells: int = CELLS, probes: int = PROBES,
) -> LanguageFilters:
    """Fill the filters from texts with a language that are not held out.

    About ``most`` texts are used, chosen by a hash of their keys. They are
    counted by language and n-gram on the executors; what reaches the driver is
    the n-grams over ``least_share``, at most ``1 / least_share`` a language.
    """
    known = docs.where(
        F.col(text).isNotNull() & F.col(lang).isNotNull() & ~held_out(key)
    ).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    total = known.count()
    spread = F.pmod(F.xxhash64("key"), F.lit(1 << 20))
    known = known.where(spread < int(min(1.0, most / max(1, total)) * (1 << 20)) + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[np.ndarray]] = {}
        for batch in slices(batches):
            for body, language in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for grams in ngrams(body):
                    counts.setdefault(language, []).append(grams)
            for language, parts in counts.items():
                grams, number = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([language] * len(grams)), pa.array(grams.view(np.int64)), pa.array(number)],
                    names=["lang", "gram", "n"],
                )
            counts = {}

    grams = (
        known.select("text", "lang").mapInArrow(count, "lang string, gram bigint, n bigint")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    )
    # One hashed row per language and share of its n-grams; languages are few.
    totals = {r["lang"]: r["n"] for r in grams.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    if len(languages) > 64:
        raise ValueError(f"{len(languages)} languages do not fit into a bitmask of 64")
    if not languages:
        return LanguageFilters([], np.zeros(cells, dtype=np.uint8), probes, 0, np.zeros(0))
    least = F.create_map(*[F.lit(x) for name in languages for x in (name, max(1.0, totals[name] * least_share))])
    frequent = grams.where(F.col("n") >= least[F.col("lang")]).toPandas()
    kind = next(k for bits, k in ((8, np.uint8), (16, np.uint16), (32, np.uint32), (64, np.uint64)) if bits >= len(languages))
    masks = np.zeros(cells, dtype=kind)
    for number, language in enumerate(languages):
        own = frequent["gram"][frequent["lang"] == language].to_numpy().astype(np.int64).view(np.uint64)
        for cell in _cells(own, cells, probes):
            masks[cell] |= kind(1 << number)
    usual = max(range(len(languages)), key=lambda i: totals[languages[i]])
    bits = np.arange(len(languages), dtype=kind)
    fill = np.array([np.mean((masks >> bit) & kind(1)) for bit in bits])
    return LanguageFilters(languages, masks, probes, usual, fill**probes)


def identify(docs: DataFrame, filters: LanguageFilters, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, ``lang_pred`` and ``score`` (0 to 1) of every row.

    The filters travel with the task: half a megabyte for up to 8 languages.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [filters.predict(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                names=[key, "lang_pred", "score"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double")


def keep_identified(
    docs: DataFrame, filters: LanguageFilters, least: float, text: str = "text"
) -> DataFrame:
    """The rows, unchanged, whose text is in a learned language with ``least`` score."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [filters.predict(x) for x in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([x[0] != UNKNOWN and x[1] >= least for x in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
