"""Helpers shared by the operators: worker caches, text pieces, staged tables."""

from __future__ import annotations

import re
import sys
import types
from collections.abc import Callable, Iterable, Iterator
from itertools import chain
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Pieces longer than this are computed again each time, so that the cache's
# memory follows its number of entries.
LONGEST_CACHED = 48

# Rows of one Arrow batch that are worked on at a time, and bytes of their texts
# if there is more than one.
ROWS_AT_A_TIME = 512
BYTES_AT_A_TIME = 1 << 22

_MIXED_SPACE = re.compile(r"\s ")
_WORD_THEN_SPACE = re.compile(r"(?<=\S)(?= )")


def once(key: str, make: Callable[[], Any]) -> Any:
    """A value made once in each Python worker and shared by its later tasks."""
    kept = sys.modules.setdefault("_driftline_worker_values", types.ModuleType("_driftline_worker_values"))
    if key not in kept.__dict__:
        kept.__dict__[key] = make()
    return kept.__dict__[key]


def slices(batches: Iterable[pa.RecordBatch], rows: int = ROWS_AT_A_TIME) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``rows`` and ``BYTES_AT_A_TIME`` at most, or one row."""
    for batch in batches:
        size = np.zeros(batch.num_rows, dtype=np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                size += pc.fill_null(pc.binary_length(column), 0).to_numpy()
        ends = np.cumsum(size)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = min(start + rows, int(np.searchsorted(ends, before + BYTES_AT_A_TIME, "right")))
            stop = max(stop, start + 1)
            yield batch.slice(start, stop - start)
            start = stop


class PieceCache:
    """Results for the pieces of texts between spaces, bounded in entries.

    ``work`` maps a list of pieces to a list of results. A piece keeps the one
    space before it. When ``limit`` entries are kept, all are dropped and the
    frequent ones come back soon.
    """

    def __init__(self, work: Callable[[list[str]], list[bytes]], limit: int):
        self.work = work
        self.limit = limit
        self.known: dict[str, bytes] = {}

    def results(self, texts: list[list[str]]) -> Callable[[str], bytes]:
        known = self.known
        if len(known) > self.limit:
            known.clear()
        new = list(set(chain.from_iterable(texts)).difference(known))
        made = dict(zip(new, self.work(new), strict=True))
        for piece, result in made.items():
            if len(piece) <= LONGEST_CACHED:
                known[piece] = result
        if len(made) and max(map(len, new)) > LONGEST_CACHED:
            return lambda piece: made[piece] if piece in made else known[piece]
        return known.__getitem__


def space_pieces(text: str) -> list[str]:
    """Cut before every space that follows no white space. Joined, the pieces are the text.

    Words of a byte-level pattern hold white space only at their start, or
    nothing else, so a cut never falls into a word, and a run of white space
    stays together with what comes after it.
    """
    if _MIXED_SPACE.search(text):
        return _WORD_THEN_SPACE.split(text)
    first, *rest = text.split(" ")
    return [first, *[" " + piece for piece in rest]] if first else [" " + piece for piece in rest]


def list_array(values: np.ndarray, lengths: np.ndarray, of: pa.DataType) -> pa.ListArray:
    """Lists of ``lengths`` over ``values``."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=of))
