"""Seatings of a hierarchical Pitman-Yor model: draws of tables, and what they predict.

Three floors of restaurants: one for each frequent word before a token, one for
each class of words, and the root. The tables of a restaurant are customers of
its parent. All arrays here hold the entries of many words one after the other.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np

# Customers of a dish whose tables are drawn at once; those beyond are seated
# in steps of one in ``STEP`` of the customers already there.
EXACT = 200
STEP = 16
CELLS = 1 << 20


@dataclass
class Floor:
    """Restaurants of one level: discount, strength, and totals by restaurant."""

    discount: float
    strength: float
    tables: np.ndarray
    customers: np.ndarray

    def escape(self) -> np.ndarray:
        """Share of a restaurant's probability that comes from its parent."""
        return (self.strength + self.discount * self.tables) / (self.strength + self.customers)


@dataclass
class Contexts:
    """Numbers of contexts: classes of words from 0 on, then the words that are contexts of their own."""

    classes: dict[bytes, int] = field(default_factory=dict)
    words: dict[bytes, int] = field(default_factory=dict)
    parent: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    # Fixed numbers of the start of a text and of words in no class of their own.
    START, OTHER = 0, 1

    @classmethod
    def build(cls, endings: Sequence[bytes], words: Sequence[bytes]) -> Contexts:
        classes = {ending: 2 + i for i, ending in enumerate(sorted(endings))}
        first = 2 + len(classes)
        own = {word: first + i for i, word in enumerate(sorted(words))}
        parent = np.arange(first + len(own))
        parent[first:] = [classes.get(word[-2:], cls.OTHER) for word in own]
        return cls(classes, own, parent)

    @property
    def first_word(self) -> int:
        return 2 + len(self.classes)

    def own(self, words: Sequence[bytes]) -> np.ndarray:
        """Numbers of words that are contexts of their own, -1 for others."""
        return np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words))

    def of(self, words: Sequence[bytes]) -> np.ndarray:
        """Numbers of the contexts that words are for what follows them."""
        own, endings = self.own(words), [word[-2:] for word in words]
        return np.where(own >= 0, own, np.fromiter(map(self.classes.get, endings, repeat(self.OTHER)), np.int64, len(words)))


def uniform(*parts: np.ndarray | int) -> np.ndarray:
    """Numbers in (0, 1) that follow from whole numbers, so a repeated task draws the same."""
    mixed = np.zeros(1, np.uint64)
    with np.errstate(over="ignore"):
        for part in parts:
            mixed = (mixed ^ np.asarray(part).astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            mixed ^= mixed >> np.uint64(31)
    return ((mixed >> np.uint64(12)).astype(np.float64) + 0.5) / float(1 << 52)


def log_seatings(discount: float, most: int = EXACT) -> np.ndarray:
    """Log of the generalised Stirling numbers: weight of all seatings of c customers at t tables."""
    table = np.full((most + 1, most + 1), -np.inf)
    table[1, 1] = 0.0
    for c in range(1, most):
        stay = np.log(np.maximum(c - np.arange(1, c + 1) * discount, 1e-300)) + table[c, 1 : c + 1]
        table[c + 1, 1 : c + 1] = np.logaddexp(stay, table[c, :c])
        table[c + 1, c + 1] = table[c, c]
    return table


def draw_tables(
    customers: np.ndarray, others: np.ndarray, base: np.ndarray, floor: Floor, weights: np.ndarray, chance: np.ndarray
) -> np.ndarray:
    """Tables of each dish, given its customers, the other tables of its restaurant and its parent's probability.

    One Gibbs step for a whole dish: with table sizes summed out, t tables weigh
    the number of their seatings times what opening each of them weighs.
    """
    tables = np.minimum(customers, 1)
    if not len(tables):
        return tables
    sizes = np.minimum(customers, EXACT)
    order = np.argsort(sizes, kind="stable")
    bounds = np.flatnonzero(np.diff(sizes[order], prepend=-1))
    for start, stop in zip(bounds, [*bounds[1:], len(order)], strict=True):
        size = int(sizes[order[start]])
        if size < 2:
            continue
        for at in range(start, stop, max(1, CELLS // size)):
            rows = order[at : min(stop, at + max(1, CELLS // size))]
            opening = floor.strength + floor.discount * (others[rows, None] + np.arange(size))
            weight = np.cumsum(np.log(opening * base[rows, None]), 1) + weights[size, 1 : size + 1]
            weight = np.cumsum(np.exp(weight - weight.max(1, keepdims=True)), 1)
            tables[rows] = 1 + (weight < chance[rows, None] * weight[:, -1:]).sum(1)
    rest = np.flatnonzero(customers > EXACT)
    seated = np.full(len(rest), EXACT, np.int64)
    turn = 0
    while len(rest):
        more = np.minimum(customers[rest] - seated, np.maximum(1, seated // STEP))
        opening = (floor.strength + floor.discount * (others[rest] + tables[rest])) * base[rest]
        share = opening / (opening + seated - floor.discount * tables[rest])
        tables[rest] += np.minimum(more, np.floor(more * share + uniform(np.floor(chance[rest] * (1 << 52)), turn))).astype(np.int64)
        seated += more
        turn += 1
        left = seated < customers[rest]
        rest, seated = rest[left], seated[left]
    return tables


def draw_strength(floor: Floor, chance: float) -> float:
    """A strength drawn from its posterior on a grid of powers of two."""
    d = floor.discount
    pairs = [(t, c) for t, c in zip(floor.tables.tolist(), floor.customers.tolist(), strict=True) if c > 0]
    grid = [2.0**k for k in range(-4, 24)]
    logs = []
    for s in grid:
        logs.append(sum(
            math.lgamma(s / d + t) - math.lgamma(s / d + 1) - math.lgamma(s + c) + math.lgamma(s + 1) for t, c in pairs
        ))
    weights = np.cumsum(np.exp(np.array(logs) - max(logs)))
    return grid[int((weights < chance * weights[-1]).sum())]


@dataclass
class Words:
    """Entries of many words: how often each stood in a context, and its classes."""

    row: np.ndarray
    context: np.ndarray
    count: np.ndarray
    class_row: np.ndarray
    klass: np.ndarray
    # Where an entry's class entry is.
    up: np.ndarray
    # Whether an entry's context is a word of its own.
    own: np.ndarray
    rows: int

    @classmethod
    def of(cls, lengths: np.ndarray, context: np.ndarray, count: np.ndarray, contexts: Contexts) -> Words:
        row = np.repeat(np.arange(len(lengths)), lengths)
        context = context.astype(np.int64)
        keys, up = np.unique(row << 16 | contexts.parent[context], return_inverse=True)
        return cls(row, context, count.astype(np.int64), keys >> 16, keys & 0xFFFF, up, context >= contexts.first_word, len(lengths))


@dataclass
class State:
    """One seating: tables of the entries, customers and tables of the class entries, tables of the root."""

    tables: np.ndarray
    customers: np.ndarray
    class_tables: np.ndarray
    root_tables: np.ndarray


def first_state(words: Words) -> State:
    """Everybody who orders a dish of a restaurant sits at one table."""
    tables = words.own.astype(np.int64)
    return State(tables, _customers(words, tables), np.ones(len(words.klass), np.int64), np.ones(words.rows, np.int64))


def _customers(words: Words, tables: np.ndarray) -> np.ndarray:
    sent = np.where(words.own, tables, words.count)
    return np.bincount(words.up, sent, len(words.klass)).astype(np.int64)


def root_customers(words: Words, state: State) -> np.ndarray:
    return np.bincount(words.class_row, state.class_tables, words.rows)


def _share(customers, tables, floor: Floor, place, base):
    """Probability of a dish with so many customers and tables in restaurant ``place``."""
    total = floor.strength + floor.customers[place]
    return (np.maximum(customers - floor.discount * tables, 0) + (floor.strength + floor.discount * floor.tables[place]) * base) / total


def redraw(words: Words, state: State, floors: Sequence[Floor], weights: Sequence[np.ndarray], base: float, seeds: np.ndarray, turn: int) -> State:
    """The next seating of every word, given the totals of all restaurants.

    A dish leaves its restaurant before it is seated again: its own tables
    count neither there nor in the parent's probability.
    """
    word, klass, root = floors
    sitting = root_customers(words, state)
    p0 = _share(sitting, state.root_tables, root, 0, base)
    sent = np.where(words.own, state.tables, 0)
    without = state.customers[words.up] - sent
    p1 = _share(without, np.minimum(state.class_tables[words.up], without), klass, words.klass[words.up], p0[words.row])
    tables = np.zeros(len(words.row), np.int64)
    own = np.flatnonzero(words.own)
    tables[own] = draw_tables(
        words.count[own], np.maximum(word.tables[words.context[own]] - state.tables[own], 0), p1[own], word, weights[0],
        uniform(seeds[words.row[own]], words.context[own], turn),
    )
    customers = _customers(words, tables)
    without = sitting[words.class_row] - state.class_tables
    p0 = _share(without, np.minimum(state.root_tables[words.class_row], without), root, 0, base)
    class_tables = draw_tables(
        customers, np.maximum(klass.tables[words.klass] - state.class_tables, 0), p0, klass, weights[1],
        uniform(seeds[words.class_row], words.klass, turn),
    )
    drawn = State(tables, customers, class_tables, state.root_tables)
    drawn.root_tables = draw_tables(
        root_customers(words, drawn).astype(np.int64), np.maximum(root.tables[0] - state.root_tables, 0),
        np.full(words.rows, base), root, weights[2], uniform(seeds, 0xFFFFF, turn),
    )
    return drawn


@dataclass
class Predicted:
    """Probabilities of one seating: of entries, of class entries and of words at the root."""

    entry: np.ndarray
    klass: np.ndarray
    root: np.ndarray


def predict(words: Words, state: State, floors: Sequence[Floor], base: float) -> Predicted:
    word, klass, root = floors
    p0 = _share(root_customers(words, state), state.root_tables, root, 0, base)
    p1 = _share(state.customers, state.class_tables, klass, words.klass, p0[words.class_row])
    entry = p1[words.up]
    own = np.flatnonzero(words.own)
    entry[own] = _share(words.count[own], state.tables[own], word, words.context[own], entry[own])
    return Predicted(entry, p1, p0)
