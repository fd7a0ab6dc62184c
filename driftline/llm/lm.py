"""Scores of texts under a hierarchical Pitman-Yor model of words.

A token is seated in the restaurant of the word before it. Words that are more
than one in ``OWN`` of all tokens have a restaurant of their own, whose parent
is that of their class: words with the same last two bytes, if these are
frequent. Other words before a token share the restaurant of their class, and
all classes share the root. Gibbs rounds draw the tables of every word's dish
in all its restaurants, given the totals of all restaurants; only these, a
bounded list, go to the driver. Scores average the probabilities of the last
rounds.

Words are dealt into buckets by hash, as many as the tokens need, and a bucket
is one row: its words, how often each stood in each context, and their
seatings. Tasks count in chunks of documents and ship one row for each bucket a
chunk has words of. Frequent words have buckets of their own, and these have
copies that chunks take turns with, so no word is hot. Scoring looks up pairs
above one in ``FREQUENT`` of all tokens, a bounded table, where the text is
read; other tokens go to the bucket of their word and come back to their chunk.
So what is learned grows with the texts, and nothing that grows is broadcast.

A null text is empty and has one token, the end. Null keys count as learned
from. Repeated rows are scored and counted one by one, texts of any length are
read in segments, and other columns are ignored. Without texts to learn from
every word is the unknown one, with probability 1.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from driftline.llm import seating
from driftline.llm.seating import Contexts, Floor, State, Words
from driftline.session import delete_folder, stage

# One in so many texts is not learned from.
HELD_OUT = 10
# The end of a text; no token holds it.
END = b"\n"
# Contexts: a word or a class of words is one in so many tokens at least.
OWN, CLASS = 10_000, 2_000
# Pairs looked up where texts are read.
FREQUENT = 500_000
# Gibbs rounds before those that are averaged, and those.
BURN_IN, SAMPLES = 1, 3
SEED = 12
# Tokens and documents of a chunk, bytes of a text worked on at a time, and
# words counted before they leave a task.
TOKENS, DOCUMENTS, SEGMENT, COUNTED = 400_000, 60_000, 1 << 22, 200_000
# Tokens whose words share a bucket, and buckets of the frequent words.
BUCKET, HOT = 1_000_000, 64
SMOOTH = 0.1

_PACKED = "bucket bigint, words binary, lengths binary, contexts binary, counts binary"
_COUNTED = "bucket bigint, words binary, counts binary"
_FOUND = "whole bigint, word binary, n bigint"
_STATES = ("tables", "customers", "class_tables", "root_tables")
_MODEL = f"{_PACKED}, seeds binary, {', '.join(f'{name} binary' for name in _STATES)}"
_ASKED = f"kind int, chunk bigint, docs binary, {_MODEL}"
_TOLD = "held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def held_out(key: str) -> Column:
    """Whether the model may not learn from a document."""
    rest = F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(HELD_OUT))
    return F.coalesce(rest == 0, F.lit(False))


# Tokens -------------------------------------------------------------------------


def segments(text: bytes) -> Iterator[list[bytes]]:
    """Tokens of a text, and its end, a few megabytes at a time."""
    at, space = 0, re.compile(rb"[\x20\x09-\x0d]")
    while len(text) - at > SEGMENT:
        cut = space.search(text, at + SEGMENT)
        if not cut:
            break
        yield text[at : cut.start()].lower().split()
        at = cut.end()
    yield [*text[at:].lower().split(), END]


@dataclass
class Chunk:
    """Tokens of neighbouring documents by number of word, document and context."""

    first: int
    words: list[bytes]
    word: np.ndarray
    doc: np.ndarray
    context: np.ndarray


def chunks(texts: Iterator[bytes | None], contexts: Contexts, first: int = 0) -> Iterator[Chunk]:
    """Documents numbered from ``first``; a long one may go on in the next chunk."""
    tokens: list[bytes] = []
    parts: list[tuple[int, int, int]] = []
    start = number = first

    def made() -> Chunk:
        known: defaultdict[bytes, int] = defaultdict(count().__next__)
        word = np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))
        words = list(known)
        context = np.r_[0, contexts.of(words)[word[:-1]]]
        docs, sizes, opened = (np.array(values) for values in zip(*parts, strict=True))
        context[np.cumsum(sizes) - sizes] = opened
        return Chunk(start, words, word, np.repeat(docs, sizes), context)

    for number, text in enumerate(texts, first):
        before = Contexts.START
        for found in segments(text or b""):
            if not found:
                continue
            if not tokens:
                start = number
            tokens += found
            parts.append((number - start, len(found), before))
            before = int(contexts.of(found[-1:])[0])
            if len(tokens) >= TOKENS or number - start >= DOCUMENTS:
                yield made()
                tokens, parts = [], []
    if tokens:
        yield made()


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes | None]:
    for batch in batches:
        texts = _column(batch, "text").cast(pa.binary())
        for start in range(0, len(texts), 512):
            yield from texts.slice(start, 512).to_pylist()


# Rows and binary columns --------------------------------------------------------


def ragged(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column, and how many each row has."""
    if not len(column):
        return np.zeros(0, kind), np.zeros(0, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].tobytes() if data else b""
    return np.frombuffer(flat, kind), np.diff(offsets) // np.dtype(kind).itemsize


def binary(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths * values.dtype.itemsize, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _names(ddl: str, *more: str) -> list[str]:
    return [*more, *(part.split()[0] for part in ddl.split(", "))]


_KINDS = {"bigint": pa.int64(), "binary": pa.binary()}


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def _batch(schema: pa.Schema, columns: dict, rows: int) -> pa.RecordBatch:
    """Columns by name, the others null."""

    def made(field: pa.Field) -> pa.Array:
        values = columns.get(field.name)
        if values is None:
            return pa.nulls(rows, field.type)
        return values.cast(field.type) if isinstance(values, pa.Array) else pa.array(values, field.type)

    return pa.RecordBatch.from_arrays([made(field) for field in schema], schema=schema)


def _record(ddl: str, rows: list[tuple]) -> pa.RecordBatch:
    """Rows of whole numbers and binary values."""
    schema = pa.schema([(part.split()[0], _KINDS[part.split()[1]]) for part in ddl.split(", ")])
    columns = zip(*rows, strict=True)
    return _batch(schema, dict(zip(_names(ddl), map(list, columns), strict=True)) if rows else {}, len(rows))


def _rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        columns = [_column(batch, name) for name in names]
        for i in range(batch.num_rows):
            yield tuple(column[i].as_py() for column in columns)


# Buckets of words ---------------------------------------------------------------


@dataclass
class Buckets:
    """Where words go: one of ``plain`` buckets, or one of the frequent words' copies."""

    plain: int
    salts: int
    contexts: Contexts

    def of(self, words: list[bytes], turn: int) -> np.ndarray:
        number = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        hot = (self.contexts.own(words) >= 0) | np.fromiter(map(END.__eq__, words), bool, len(words))
        own = self.plain + (number % np.uint64(HOT)).astype(np.int64) * self.salts + turn % self.salts
        return np.where(hot, own, (number % np.uint64(self.plain)).astype(np.int64))

    def first_copy(self) -> Column:
        """The bucket, of a frequent word the first copy."""
        past = F.col("bucket") - self.plain
        return F.when(past < 0, F.col("bucket")).otherwise(F.col("bucket") - F.pmod(past, F.lit(self.salts)))

    def copies(self) -> Column:
        """All copies of a bucket."""
        last = F.when(F.col("bucket") < self.plain, 0).otherwise(self.salts - 1)
        return F.explode(F.sequence(F.col("bucket"), F.col("bucket") + last))


def _pack(words: list[bytes]) -> bytes:
    """Words hold no spaces."""
    return b" ".join(words)


def _unpack(packed: bytes) -> list[bytes]:
    return packed.split(b" ")


def _squeeze(values: np.ndarray) -> bytes:
    """Small numbers take little room, so that rows of a model stay small in every batch."""
    return len(values).to_bytes(8, "little") + pa.compress(values.tobytes(), "zstd", asbytes=True)


def _expand(squeezed: bytes, kind: type) -> np.ndarray:
    size = int.from_bytes(squeezed[:8], "little") * np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(squeezed[8:], size, "zstd", asbytes=True) if size else b"", kind)


def _spread(chunk: Chunk, word: np.ndarray, buckets: Buckets, *values: np.ndarray) -> Iterator[tuple]:
    """For each bucket its words, how many of the given tokens each has, and the values of these."""
    place = buckets.of(chunk.words, chunk.first)
    order = np.argsort(place, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    by_rank = np.argsort(rank[word], kind="stable")
    lengths = np.bincount(rank[word], minlength=len(order))
    asked = np.flatnonzero(lengths)
    bounds = np.flatnonzero(np.diff(place[order[asked]], prepend=-1))
    ends = np.r_[0, np.cumsum(lengths[asked])]
    for start, stop in zip(bounds, np.r_[bounds[1:], len(asked)], strict=True) if len(asked) else ():
        inside = by_rank[ends[start] : ends[stop]]
        words = [chunk.words[i] for i in order[asked[start:stop]]]
        yield int(place[order[asked[start]]]), words, lengths[asked[start:stop]], *(value[inside] for value in values)


# Counting -----------------------------------------------------------------------


def count_words(docs: DataFrame, buckets: int) -> DataFrame:
    """One row for each bucket of words: the words and how often each stands in all texts, ends included."""

    def told(seen: Counter) -> pa.RecordBatch:
        words, counts = list(seen), np.fromiter(seen.values(), np.int64, len(seen))
        place = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) % np.uint64(buckets)
        order = np.argsort(place, kind="stable")
        cuts = np.flatnonzero(np.diff(place[order].astype(np.int64), prepend=-1))
        return _record(_COUNTED, [
            (int(place[inside[0]]), _pack([words[i] for i in inside]), counts[inside].tobytes())
            for inside in np.split(order, cuts[1:]) if len(inside)
        ])

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for text in _texts(batches):
            for found in segments(text or b""):
                seen.update(found)
            if len(seen) > COUNTED:
                yield told(seen)
                seen.clear()
        yield told(seen)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, seen = None, Counter()
        for bucket, words, counts in _rows(batches, _names(_COUNTED)):
            if bucket != current and seen:
                yield packed(current, seen)
                seen = Counter()
            current = bucket
            for word, n in zip(_unpack(words), np.frombuffer(counts, np.int64).tolist(), strict=True):
                seen[word] += n
        if seen:
            yield packed(current, seen)

    def packed(bucket: int, seen: Counter) -> pa.RecordBatch:
        return _record(_COUNTED, [(bucket, _pack(list(seen)), np.fromiter(seen.values(), np.int64, len(seen)).tobytes())])

    spread = docs.select("text").mapInArrow(tell, _COUNTED).repartition("bucket").sortWithinPartitions("bucket")
    return spread.mapInArrow(add, _COUNTED)


def choose_contexts(counted: DataFrame, own: int, classes: int) -> tuple[int, int, Contexts]:
    """All tokens, different words, and the frequent words and endings: bounded by their shares."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, lengths = ragged(_column(batch, "counts"), np.int64)
            yield _record("tokens bigint, words bigint", [(int(counts.sum()), int(lengths.sum()))])

    tokens, distinct = counted.mapInArrow(sizes, "tokens bigint, words bigint").agg(
        F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))
    ).first()

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        endings: Counter = Counter()
        for _, words, counts in _rows(batches, _names(_COUNTED)):
            pairs = list(zip(_unpack(words), np.frombuffer(counts, np.int64).tolist(), strict=True))
            for word, n in pairs:
                endings[word[-2:]] += n
            found = [(1, word, n) for word, n in pairs if n * own > tokens and word != END]
            if found:
                yield _record(_FOUND, found)
        yield _record(_FOUND, [(0, ending, n) for ending, n in endings.items()])

    found = counted.mapInArrow(pick, _FOUND).groupBy("whole", "word").agg(F.sum("n").alias("n"))
    kept = found.where((F.col("whole") == 1) | (F.col("n") * classes > tokens)).collect()
    by_kind = [[bytes(r.word) for r in kept if r.whole == whole] for whole in (0, 1)]
    return tokens, distinct, Contexts.build(*by_kind)


def count_pairs(docs: DataFrame, contexts: Contexts, buckets: Buckets) -> DataFrame:
    """The first seating of each bucket: its words, their contexts, and how often they stood in them."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(_texts(batches), contexts, TaskContext.get().partitionId()):
            keys, n = np.unique(chunk.word << 16 | chunk.context, return_counts=True)
            yield _record(_PACKED, [
                (bucket, _pack(words), lengths.astype(np.int32).tobytes(), context.astype(np.uint16).tobytes(), times.astype(np.uint32).tobytes())
                for bucket, words, lengths, context, times in _spread(chunk, keys >> 16, buckets, keys & 0xFFFF, n)
            ])

    def open_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, packed, lengths, context, times in _rows(batches, _names(_PACKED)):
            words = Words.of(np.frombuffer(lengths, np.int32), np.frombuffer(context, np.uint16), np.frombuffer(times, np.uint32), contexts)
            seeds = np.fromiter(map(xxhash.xxh3_64_intdigest, _unpack(packed)), np.uint64, words.rows)
            yield Bucket(number, packed, seeds, words, []).record([seating.first_state(words)])

    def together(rows: DataFrame) -> DataFrame:
        return rows.repartition("bucket").sortWithinPartitions("bucket")

    # Rows of a frequent word meet in several tasks before they meet in one.
    once = stage(together(docs.select("text").mapInArrow(tell, _PACKED)).mapInArrow(_add_up, _PACKED), "pairs")
    hot = together(once.where(F.col("bucket") >= buckets.plain).withColumn("bucket", buckets.first_copy()))
    plain = once.where(F.col("bucket") < buckets.plain)
    return plain.mapInArrow(open_tables, _MODEL).union(hot.mapInArrow(lambda batches: open_tables(_add_up(batches)), _MODEL))


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each run of a bucket, counts added up."""
    current = None
    known: dict[bytes, int] = {}
    keys: list[np.ndarray] = []
    sums: list[np.ndarray] = []

    def compact() -> None:
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        keys[:], sums[:] = [distinct], [np.bincount(place, np.concatenate(sums), len(distinct))]

    def packed() -> pa.RecordBatch:
        compact()
        lengths = np.bincount(keys[0] >> 16, minlength=len(known)).astype(np.int32)
        context, count = (keys[0] & 0xFFFF).astype(np.uint16), sums[0].astype(np.uint32)
        return _record(_PACKED, [(current, _pack(list(known)), lengths.tobytes(), context.tobytes(), count.tobytes())])

    for bucket, words, lengths, context, count in _rows(batches, _names(_PACKED)):
        if bucket != current:
            if known:
                yield packed()
            current, known = bucket, {}
            keys.clear()
            sums.clear()
        number = np.array([known.setdefault(word, len(known)) for word in _unpack(words)], np.int64)
        keys.append(np.repeat(number, np.frombuffer(lengths, np.int32)) << 16 | np.frombuffer(context, np.uint16))
        sums.append(np.frombuffer(count, np.uint32))
        if len(keys) > 8 and sum(map(len, keys)) > 2 * max(TOKENS, len(keys[0])):
            compact()
    if known:
        yield packed()


# Seating ------------------------------------------------------------------------


@dataclass
class Bucket:
    """An unpacked row of the model."""

    number: int
    packed: bytes
    seeds: np.ndarray
    words: Words
    states: list[State]

    def record(self, states: list[State]) -> pa.RecordBatch:
        w = self.words
        lengths = np.bincount(w.row, minlength=w.rows).astype(np.int32)
        columns = [_squeeze(np.stack([getattr(state, name) for state in states]).astype(np.uint32).ravel()) for name in _STATES]
        row = (self.number, self.packed, _squeeze(lengths), _squeeze(w.context.astype(np.uint16)), _squeeze(w.count.astype(np.uint32)),
               self.seeds.tobytes(), *columns)
        return _record(_MODEL, [row])


def _bucket(row: tuple, contexts: Contexts, kept: int) -> Bucket:
    number, packed, lengths, context, times, seeds, *states = row
    words = Words.of(_expand(lengths, np.int32), _expand(context, np.uint16), _expand(times, np.uint32), contexts)
    columns = [_expand(state, np.uint32).reshape(max(1, kept), -1).astype(np.int64) for state in states]
    return Bucket(number, packed, np.frombuffer(seeds, np.uint64), words, [State(*(c[s] for c in columns)) for s in range(kept)])


def _buckets(batches: Iterator[pa.RecordBatch], contexts: Contexts, kept: int) -> Iterator[Bucket]:
    for row in _rows(batches, _names(_MODEL)):
        yield _bucket(row, contexts, kept)


def totals(model: DataFrame, contexts: Contexts, kept: int) -> dict[tuple[int, int], tuple[int, int]]:
    """Tables and customers of every restaurant in the last seating, by (floor, number).

    Floors 3 to 5 tell how many dishes have one and two customers on floors 0 to 2.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(contexts.parent)
        sums = np.zeros((6, size, 2), np.int64)
        for bucket in _buckets(batches, contexts, kept):
            words, state = bucket.words, bucket.states[-1]
            own = words.own
            served = [(words.context[own], state.tables[own], words.count[own]), (words.klass, state.class_tables, state.customers),
                      (np.zeros(words.rows, np.int64), state.root_tables, seating.root_customers(words, state))]
            for floor, (place, tables, customers) in enumerate(served):
                sums[floor, :, 0] += np.bincount(place, tables, size).astype(np.int64)
                sums[floor, :, 1] += np.bincount(place, customers, size).astype(np.int64)
                sums[3 + floor, 0] += [(customers == 1).sum(), (customers == 2).sum()]
        floor, place = np.nonzero(sums.any(2))
        arrays = [pa.array(floor), pa.array(place), pa.array(sums[floor, place, 0]), pa.array(sums[floor, place, 1])]
        yield pa.RecordBatch.from_arrays(arrays, ["floor", "place", "tables", "customers"])

    rows = model.mapInArrow(add, "floor bigint, place bigint, tables bigint, customers bigint")
    found = rows.groupBy("floor", "place").agg(F.sum("tables").alias("tables"), F.sum("customers").alias("customers"))
    return {(r.floor, r.place): (r.tables, r.customers) for r in found.collect()}


def _floors(found: dict, contexts: Contexts, before: list[Floor] | None, turn: int) -> list[Floor]:
    """The restaurants of a seating: discounts from counts of counts, strengths drawn."""
    floors = []
    for number, size in enumerate((len(contexts.parent), len(contexts.parent), 1)):
        tables, customers = np.zeros(size), np.zeros(size)
        for (floor, place), (t, c) in found.items():
            if floor == number:
                tables[place], customers[place] = t, c
        if before:
            discount = before[number].discount
        else:
            ones, twos = found.get((3 + number, 0), (0, 0))
            discount = min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))
        floor = Floor(discount, 1.0, tables, customers)
        floor.strength = seating.draw_strength(floor, float(seating.uniform(SEED, number, turn)[0]))
        floors.append(floor)
    return floors


@dataclass
class Model:
    """Buckets of all words with their kept seatings, and the restaurants of each."""

    rows: DataFrame
    buckets: Buckets
    floors: list[list[Floor]]
    tokens: int
    distinct: int

    @property
    def contexts(self) -> Contexts:
        return self.buckets.contexts

    @property
    def base(self) -> float:
        return 1 / (self.distinct + 1)


def learn(docs: DataFrame, burn_in: int = BURN_IN, samples: int = SAMPLES, own: int = OWN, classes: int = CLASS) -> Model:
    """Seat the tokens of all ``docs``."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tokens, distinct, contexts = choose_contexts(stage(count_words(docs, 16 * partitions), "lm-words"), own, classes)
    base = 1 / (distinct + 1)
    buckets = Buckets(1 + tokens // BUCKET, max(16, partitions // 4), contexts)
    model = stage(count_pairs(docs, contexts, buckets), "seating")
    floors: list[list[Floor]] = []
    kept, now = 1, _floors(totals(model, contexts, 1), contexts, None, 0)
    weights = [seating.log_seatings(floor.discount) for floor in now]
    for turn in range(1, burn_in + samples + 1):
        beside = len(floors) > 0
        model = _round(model, contexts, kept, now, weights, base, turn, beside)
        kept += beside
        now = _floors(totals(model, contexts, kept), contexts, now, turn)
        if turn > burn_in:
            floors.append(now)
    return Model(model, buckets, floors, tokens, distinct)


def _round(
    model: DataFrame, contexts: Contexts, kept: int, floors: list[Floor], weights: list, base: float, turn: int, beside: bool
) -> DataFrame:
    """Draw the next seating of all words, beside the kept ones or in their place."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in _buckets(batches, contexts, kept):
            drawn = seating.redraw(bucket.words, bucket.states[-1], floors, weights, base, bucket.seeds, turn)
            yield bucket.record([*bucket.states, drawn] if beside else [drawn])

    drawn = stage(model.mapInArrow(work, _MODEL), "seating")
    for path in {file.rsplit("/", 1)[0] for file in model.inputFiles()}:
        delete_folder(model.sparkSession, path)
    return drawn


# Scoring ------------------------------------------------------------------------


class Lookup:
    """Probabilities of tokens whose word's bucket is at hand."""

    def __init__(self, bucket: Bucket, contexts: Contexts, floors: list[list[Floor]], base: float):
        self.contexts, self.floors, self.base = contexts, floors, base
        self.words = words = bucket.words
        self.count = np.bincount(words.row, words.count, words.rows + 1).astype(np.int64)
        self.entries = words.row << 16 | words.context
        self.classes = words.class_row << 16 | words.klass
        self.predicted = [seating.predict(words, state, of, base) for state, of in zip(bucket.states, floors, strict=True)]
        self.entry = np.mean([predicted.entry for predicted in self.predicted], 0)

    def probability(self, row: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Average over the seatings; row -1 is a word that was not seen."""
        entry, seen = _find(self.entries, np.where(row < 0, -1, row << 16 | context))
        average = np.empty(len(row))
        average[seen] = self.entry[entry[seen]]
        row, context = row[~seen], context[~seen]
        up = self.contexts.parent[context]
        klass, near = _find(self.classes, np.where(row < 0, -1, row << 16 | up))
        own = context >= self.contexts.first_word
        total = np.zeros(len(row))
        for (word, group, root), predicted in zip(self.floors, self.predicted, strict=True):
            p0 = np.r_[predicted.root, root.escape()[0] * self.base][row]
            p1 = group.escape()[up] * p0
            p1[near] = predicted.klass[klass[near]]
            total += np.where(own, word.escape()[context] * p1, p1)
        average[~seen] = total / len(self.floors)
        return average


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in sorted ``keys``, and which of them are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return place, keys[place] == wanted


@dataclass
class FrequentPairs:
    """Log-probabilities of frequent pairs, bounded by their share of all tokens."""

    words: dict[bytes, int]
    counts: np.ndarray
    keys: np.ndarray
    logs: np.ndarray


def frequent_pairs(model: Model, share: int) -> FrequentPairs:
    least = model.tokens / share
    contexts, floors, base = model.contexts, model.floors, model.base

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in _buckets(batches, contexts, len(floors)):
            lookup = Lookup(bucket, contexts, floors, base)
            at = np.flatnonzero(lookup.words.count > least)
            row, context = lookup.words.row[at], lookup.words.context[at]
            words = _unpack(bucket.packed)
            logs = np.log10(lookup.probability(row, context))
            yield _batch(schema, {"word": [words[i] for i in row], "n": lookup.count[row], "context": context, "log": logs}, len(at))

    ddl = "word binary, n bigint, context bigint, log double"
    schema = _arrow(ddl)
    found = model.rows.mapInArrow(pick, ddl).toArrow()
    words: dict[bytes, int] = {}
    numbers = np.array([words.setdefault(word, len(words)) for word in found.column("word").to_pylist()], np.int64)
    counts = np.zeros(len(words), np.int64)
    counts[numbers] = found.column("n").to_numpy()
    keys = numbers << 16 | found.column("context").to_numpy()
    order = np.argsort(keys)
    return FrequentPairs(words, counts, keys[order], found.column("log").to_numpy()[order])


def score(docs: DataFrame, model: Model, share: int = FREQUENT) -> DataFrame:
    """Every row with ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``."""
    contexts, floors, base = model.contexts, model.floors, model.base
    tokens, buckets = model.tokens, model.buckets
    below = np.log10(tokens + SMOOTH * (model.distinct + 1))
    local = frequent_pairs(model, share)
    key_type = docs.schema["doc_id"].dataType.simpleString()
    asked_ddl = f"{_ASKED}, doc_id {key_type}, {_TOLD}"
    answer_ddl = f"chunk bigint, docs binary, logs binary, seen binary, doc_id {key_type}, {_TOLD}"
    sum_ddl = f"doc bigint, doc_id {key_type}, {_TOLD}"
    asked_arrow, answer_arrow, sum_arrow = map(_arrow, (asked_ddl, answer_ddl, sum_ddl))

    def known_here(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which tokens are frequent pairs, and their parts of the base and of the score."""
        number = np.fromiter((local.words.get(word, -1) for word in chunk.words), np.int64, len(chunk.words))[chunk.word]
        place, here = _find(local.keys, np.where(number < 0, -1, number << 16 | chunk.context))
        if not here.any():
            return here, np.zeros(0), np.zeros(0)
        return here, np.log10(local.counts[number[here]] + SMOOTH) - below, local.logs[place[here]]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list = []
        held: list[bool] = []

        def read() -> Iterator[bytes | None]:
            for batch in batches:
                keys.extend(_column(batch, "doc_id").to_pylist())
                held.extend(_column(batch, "held_out").to_pylist())
                yield from _texts(iter([batch]))

        done = TaskContext.get().partitionId() << 33
        for chunk in chunks(read(), contexts, done):
            del keys[: chunk.first - done], held[: chunk.first - done]
            done = chunk.first
            size = int(chunk.doc[-1]) + 1
            here, bases, logs = known_here(chunk)
            at, numbers = chunk.doc[here], chunk.first + np.arange(size)
            yield _batch(asked_arrow, {
                "kind": np.full(size, 2), "bucket": numbers % 4096, "chunk": numbers, "doc_id": keys[:size], "held_out": held[:size],
                "n_tokens": np.bincount(chunk.doc, minlength=size), "n_known": np.bincount(at, minlength=size),
                "base_score": np.bincount(at, bases, size), "score": np.bincount(at, logs, size),
            }, size)
            other = np.flatnonzero(~here)
            asked = [
                (bucket, _pack(words), lengths.astype(np.int32).tobytes(), context.astype(np.uint16).tobytes(), doc.astype(np.uint16).tobytes())
                for bucket, words, lengths, context, doc in _spread(chunk, chunk.word[other], buckets, chunk.context[other], chunk.doc[other])
            ]
            if asked:
                columns = dict(zip(("bucket", "words", "lengths", "contexts", "docs"), map(list, zip(*asked, strict=True)), strict=True))
                yield _batch(asked_arrow, {**columns, "kind": np.ones(len(asked)), "chunk": np.full(len(asked), chunk.first)}, len(asked))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, lookup = None, None
        known: dict[bytes, int] = {}
        waiting: list[tuple] = []

        def answered() -> pa.RecordBatch:
            row, context, doc, chunk = (np.concatenate(parts) for parts in zip(*waiting, strict=True))
            waiting.clear()
            logs = np.log10(lookup.probability(row, context.astype(np.int64))).astype(np.float32)
            seen = np.where(row < 0, 0, lookup.count[row]).astype(np.uint32)
            order = np.argsort(chunk, kind="stable")
            numbers, lengths = np.unique(chunk, return_counts=True)
            columns = {"chunk": numbers, "docs": binary(doc[order], lengths), "logs": binary(logs[order], lengths), "seen": binary(seen[order], lengths)}
            return _batch(answer_arrow, columns, len(numbers))

        nothing = _squeeze(np.zeros(0))
        nobody = (-1, b"", nothing, nothing, nothing, b"", *[nothing] * len(_STATES))
        for batch in batches:
            kinds, numbers = np.asarray(_column(batch, "kind")), np.asarray(_column(batch, "bucket"))
            told = batch.filter(pa.array(kinds == 2))
            if told.num_rows:
                yield _batch(answer_arrow, {n: _column(told, n) for n in _names(_TOLD, "doc_id", "chunk")}, told.num_rows)
            for i in np.flatnonzero(kinds < 2):
                if numbers[i] != current:
                    if waiting:
                        yield answered()
                    current = numbers[i]
                    row = next(_rows(iter([batch.slice(i, 1)]), _names(_MODEL))) if kinds[i] == 0 else nobody
                    bucket = _bucket(row, contexts, len(floors))
                    lookup = Lookup(bucket, contexts, floors, base)
                    known = {word: at for at, word in enumerate(_unpack(bucket.packed))} if bucket.words.rows else {}
                if kinds[i] == 1:
                    words, lengths, context, doc, chunk = (_column(batch, n)[i].as_py() for n in ("words", "lengths", "contexts", "docs", "chunk"))
                    row = np.fromiter((known.get(word, -1) for word in _unpack(words)), np.int64)
                    row = np.repeat(row, np.frombuffer(lengths, np.int32))
                    waiting.append((row, np.frombuffer(context, np.uint16), np.frombuffer(doc, np.uint16), np.full(len(row), chunk)))
                    if sum(len(w[0]) for w in waiting) > TOKENS:
                        yield answered()
        if waiting:
            yield answered()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = batch.filter(pc.is_null(_column(batch, "docs")))
            if told.num_rows:
                yield _batch(sum_arrow, {"doc": _column(told, "chunk"), **{n: _column(told, n) for n in _names(_TOLD, "doc_id")}}, told.num_rows)
            sums = batch.filter(pc.is_valid(_column(batch, "docs")))
            if sums.num_rows:
                offset, lengths = ragged(_column(sums, "docs"), np.uint16)
                logs, seen = ragged(_column(sums, "logs"), np.float32)[0], ragged(_column(sums, "seen"), np.uint32)[0]
                numbers, place = np.unique(np.repeat(np.asarray(_column(sums, "chunk")), lengths) + offset, return_inverse=True)
                n = len(numbers)
                yield _batch(sum_arrow, {
                    "doc": numbers, "n_tokens": np.zeros(n), "n_known": np.bincount(place, seen > 0, n),
                    "base_score": np.bincount(place, np.log10(seen + SMOOTH) - below, n), "score": np.bincount(place, logs, n),
                }, n)

    questions = docs.select("doc_id", "text", held_out("doc_id").alias("held_out")).mapInArrow(ask, asked_ddl)
    rows = model.rows.withColumn("kind", F.lit(0)).withColumn("bucket", buckets.copies())
    joined = questions.unionByName(rows, allowMissingColumns=True)
    answers = joined.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(answer, answer_ddl)
    added = answers.repartition("chunk").mapInArrow(add, sum_ddl).groupBy("doc").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"),
        F.sum("n_known").alias("n_known"), F.sum("base_score").alias("base_score"), F.sum("score").alias("score"),
    )
    return added.drop("doc").withColumn("train_tokens", F.lit(tokens).cast("bigint"))
