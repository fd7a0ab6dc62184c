"""BPE encoding by dynamic programming over prefixes, and decoding.

The merges of a byte-level BPE give every prefix of a word exactly one last
token. All vocabulary tokens that end at a position are found with a suffix
automaton (Aho-Corasick); of these the last one is the token that may stand
beside the last token of the prefix before it. A pair may stand side by side
if encoding it gives the pair back. The test undoes the merges along the
border: no two pieces that once met there may have a merge that came before
both were merged away. Back-pointers from the end of the word emit the ids.

Null text counts as empty and has no ids; null keys and repeated rows are
kept; an empty table gives an empty result; other columns are ignored. Texts
of any length are encoded whole, in time linear in their length. Special
tokens in a text become their ids. Decoding accepts null lists (as empty).
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from driftline.llm.common import PieceCache, list_array, once, slices, space_pieces

# Fixed value: how byte-level vocabularies cut a text into words.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Entries kept of the pair test and of words, before they are made anew.
KEPT_PAIRS = 300_000
KEPT_WORDS = 250_000
KEPT_PIECES = 400_000
NEVER = 1 << 40


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def read_tokenizer(path: str) -> dict:
    with open(path, encoding="utf-8") as file:
        return json.load(file)


def token_bytes(described: dict) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary and its special tokens."""
    to_byte = byte_characters()
    vocabulary = described["model"]["vocab"]
    added = {x["content"]: x["id"] for x in described["added_tokens"]}
    contents = [b""] * (1 + max([*vocabulary.values(), *added.values()]))
    for token, number in vocabulary.items():
        if token not in added:
            contents[number] = bytes(to_byte[c] for c in token)
    for token, number in added.items():
        contents[number] = token.encode()
    return contents


class PrefixEncoder:
    """Vocabulary, automaton and pair test of one tokenizer file."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        described = read_tokenizer(path)
        vocabulary = described["model"]["vocab"]
        added = {x["content"]: x["id"] for x in described["added_tokens"]}
        self.special = added
        self.special_pattern = (
            regex.compile("|".join(regex.escape(x) for x in sorted(added, key=len, reverse=True)))
            if added else None
        )
        self.words = regex.compile(WORDS)
        self.token_bytes = token_bytes(described)
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(described["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            first, second = vocabulary[left], vocabulary[right]
            self.rank[first << 20 | second] = rank
            self.parts.setdefault(vocabulary[left + right], (first, second, rank))
        self.automaton = ahocorasick.Automaton()
        for token, number in vocabulary.items():
            if token not in added:
                content = self.token_bytes[number]
                self.automaton.add_word(content.decode("latin-1"), (len(content), number))
        self.automaton.make_automaton()
        self.right_edges = self._edges(1)
        self.left_edges = self._edges(0)
        self.pairs: dict[int, bool] = {}
        self.by_word: dict[str, bytes] = {}
        self.cache = PieceCache(self._pieces, KEPT_PIECES)

    def _edges(self, side: int) -> list[list[tuple[int, int]]]:
        """Per token the pieces at one of its ends, each with the rank that merged it away."""
        edges: list[list[tuple[int, int]]] = []
        for token in range(len(self.token_bytes)):
            chain, gone = [], NEVER
            while True:
                chain.append((token, gone))
                if token not in self.parts:
                    break
                gone = self.parts[token][2]
                token = self.parts[token][side]
            edges.append(chain)
        return edges

    def beside(self, left: int, right: int) -> bool:
        """Whether encoding the two tokens' text gives these two tokens."""
        rank = self.rank
        for a, a_gone in self.right_edges[left]:
            for b, b_gone in self.left_edges[right]:
                met = rank.get(a << 20 | b)
                # Of equal merges the left one is made first.
                if met is not None and met < a_gone and met <= b_gone:
                    return False
        return True

    def word_ids(self, word: bytes) -> list[int]:
        """Ids of one word: the last token of every prefix, then back from the end."""
        last = [0] * (len(word) + 1)
        back = [0] * (len(word) + 1)
        pairs, settled = self.pairs, -1
        if len(pairs) > KEPT_PAIRS:
            pairs.clear()
        for position, (length, token) in self.automaton.iter(word.decode("latin-1")):
            if position == settled:
                continue
            end = position + 1
            start = end - length
            if start:
                code = last[start] << 20 | token
                fits = pairs.get(code)
                if fits is None:
                    fits = pairs[code] = self.beside(last[start], token)
                if not fits:
                    continue
            last[end], back[end], settled = token, start, position
        ids, at = [], len(word)
        while at:
            ids.append(last[at])
            at = back[at]
        return ids[::-1]

    def _plain(self, text: str, out: list[bytes]) -> None:
        by_word = self.by_word
        for word in self.words.findall(text):
            ids = by_word.get(word)
            if ids is None:
                ids = array("i", self.word_ids(word.encode("utf-8"))).tobytes()
                if len(word) < 32:
                    if len(by_word) > KEPT_WORDS:
                        by_word.clear()
                    by_word[word] = ids
            out.append(ids)

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        results = []
        for piece in pieces:
            out: list[bytes] = []
            at = 0
            for match in self.special_pattern.finditer(piece) if self.special_pattern else ():
                self._plain(piece[at : match.start()], out)
                out.append(np.array([self.special[match[0]]], dtype="<i4").tobytes())
                at = match.end()
            self._plain(piece[at:], out)
            results.append(b"".join(out))
        return results

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        cut = [space_pieces(text) for text in texts]
        ids = self.cache.results(cut)
        return [b"".join(map(ids, pieces)) for pieces in cut]


class Decoder:
    """Bytes of all tokens in one array, for whole batches of ids."""

    def __init__(self, token_bytes: list[bytes]):
        self.joined = np.frombuffer(b"".join(token_bytes), dtype=np.uint8)
        self.lengths = np.array([len(x) for x in token_bytes], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """One text per run of ``counts`` ids; broken UTF-8 becomes replacement characters."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        shift = np.repeat(self.starts[ids] - (ends - lengths), lengths)
        data = self.joined[np.arange(len(shift)) + shift].tobytes()
        at = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]


def _encoder(path: str) -> PrefixEncoder:
    return once(f"bpe {path}", lambda: PrefixEncoder(path))


def encode(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and ``ids`` (array of int) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for batch in slices(batches):
            ids = encoder.encode([x or "" for x in batch.column(1).to_pylist()])
            values = np.frombuffer(b"".join(ids), dtype="<i4")
            counts = np.array([len(x) // 4 for x in ids], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), list_array(values, counts, pa.int32())], names=[key, "ids"]
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode(
    encoded: DataFrame, tokenizer: str, key: str = "doc_id", ids: str = "ids", keep_ids: bool = True
) -> DataFrame:
    """Key, ids and ``decoded`` text of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = once(f"bpe decoder {tokenizer}", lambda: Decoder(token_bytes(read_tokenizer(tokenizer))))
        for batch in slices(batches):
            lists = batch.column(1)
            counts = np.asarray(lists.value_lengths().fill_null(0), dtype=np.int64)
            texts = decoder.decode(np.asarray(lists.flatten(), dtype=np.int64), counts)
            kept = [batch.column(0), lists] if keep_ids else [batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(texts, pa.string())],
                names=[key, ids, "decoded"] if keep_ids else [key, "decoded"],
            )

    kind = encoded.schema[key].dataType.simpleString()
    kept = f"`{ids}` array<int>, " if keep_ids else ""
    return encoded.select(key, ids).mapInArrow(run, f"`{key}` {kind}, {kept}decoded string")
