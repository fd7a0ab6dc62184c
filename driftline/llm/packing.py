"""Best-fit packing: bounded-space online best-fit of token pieces into sequences.

A document is its token ids and one end id. One longer than a sequence is cut
into full pieces, the remainder first; every other document is one piece. Full
pieces are sequences of their own and stay where they are. The others are dealt
by hash into buckets, and each bucket is packed online by best-fit: pieces
arrive in waves, by hash, and the long ones of a wave first; a fixed number of
bins is open, a bitset has bit f set while an open bin has f tokens free, and
the fullest bin closes when a new one has to open.

Null text counts as empty: one piece that holds the end id. Null keys and
repeated rows are kept; each row is packed by itself. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.bpe import WORDS, byte_characters
from driftline.llm.common import once, slices
from driftline.session import stage

LENGTH = 1024
END_ID = 2
# Bins open at a time in one bucket, pieces that arrive together, and the pieces
# a bucket should hold. A wave opens about half as many bins as it has pieces,
# so those that its short pieces could still fill stay open until they arrive.
OPEN_BINS = 1024
WAVE = 2048
BUCKET_PIECES = 12_000


def _encoding(path: str):
    """The tokenizer file's byte-level BPE in the faster of two libraries.

    Ids are the same as the tokenizers library's own; that library needs three
    to five times the CPU seconds.
    """
    import tiktoken

    with open(path, encoding="utf-8") as file:
        described = json.load(file)
    to_byte = byte_characters()
    special = {x["content"]: x["id"] for x in described["added_tokens"]}
    ranks = {
        bytes(to_byte[c] for c in token): number
        for token, number in described["model"]["vocab"].items()
        if token not in special
    }
    return tiktoken.Encoding(path, pat_str=WORDS, mergeable_ranks=ranks, special_tokens=special)


def _library(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _ids(text: str, tokenizer: str) -> np.ndarray:
    """Token ids of a text.

    The faster library's pattern gives up on about a million white-space
    characters in a row; such a text goes to the tokenizers library.
    """
    encoding = once(f"packing {tokenizer}", lambda: _encoding(tokenizer))
    try:
        return encoding.encode_to_numpy(text, allowed_special="all")
    except ValueError:
        library = once(f"packing library {tokenizer}", lambda: _library(tokenizer))
        return np.array(library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def token_pieces(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text",
    length: int = LENGTH, end_id: int = END_ID,
) -> DataFrame:
    """Pieces of every document: key, piece, start, length and the CRC-32 of its ids."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, pieces, starts, lengths, sums = [], [], [], [], []
            for row, text_of in enumerate(batch.column(1).to_pylist()):
                ids = _ids(text_of or "", tokenizer)
                ids = ids.astype("<u4", copy=False).tobytes() + end
                total = len(ids) // 4
                first = total % length or length
                start, stop, piece = 0, min(first, total), 0
                while start < total:
                    rows.append(row)
                    pieces.append(piece)
                    starts.append(start)
                    lengths.append(stop - start)
                    sums.append(zlib.crc32(ids[4 * start : 4 * stop]))
                    start, stop, piece = stop, stop + length, piece + 1
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()),
                    pa.array(lengths, pa.int64()), pa.array(sums, pa.int64()),
                ],
                names=[key, "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(
        run, f"`{key}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    )


def best_fit(lengths: list[int], size: int, open_bins: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece, in order of arrival.

    A piece goes to the open bin with the least sufficient space. Where none
    has room, a bin opens, and beyond ``open_bins`` the fullest one closes.
    """
    free = 0  # bit f: an open bin has f tokens free
    stacks: list[list[int]] = [[] for _ in range(size + 1)]
    bins, offsets, opened, open_now = [], [], 0, 0
    for length in lengths:
        fitting = free >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            stack = stacks[space]
            bin_no = stack.pop()
            if not stack:
                free ^= 1 << space
        else:
            if open_now == open_bins:
                fullest = (free & -free).bit_length() - 1
                stacks[fullest].pop()
                if not stacks[fullest]:
                    free ^= 1 << fullest
                open_now -= 1
            bin_no, space = opened, size
            opened += 1
            open_now += 1
        bins.append(bin_no)
        offsets.append(size - space)
        rest = space - length
        if rest:
            stacks[rest].append(bin_no)
            free |= 1 << rest
        else:
            open_now -= 1
    return bins, offsets


def pack(
    pieces: DataFrame, buckets: int, key: str = "doc_id", length: int = LENGTH,
    open_bins: int = OPEN_BINS, wave: int = WAVE,
) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to staged pieces with a ``length`` up to ``length``.

    Sequence ids are unique, not dense; those of full pieces are negative.
    Pieces have a ``__row`` number, which spreads repeated rows.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        bucket = int(rows["__bucket"].iloc[0])
        rows = rows.sort_values(["__order", "__row"])
        rows["__wave"] = np.arange(len(rows)) // wave
        rows = rows.sort_values(["__wave", "length", "__order", "__row"], ascending=[True, False, True, True])
        bins, offsets = best_fit(rows["length"].tolist(), length, open_bins)
        rows["sequence_id"] = np.array(bins, dtype=np.int64) * buckets + bucket
        rows["offset"] = np.array(offsets, dtype=np.int64)
        return rows.drop(columns=["__bucket", "__order", "__wave", "__row"])

    order = F.xxhash64("piece", "ids_crc32", "__row")
    dealt = pieces.where(F.col("length") < length).withColumn("__order", order).withColumn(
        "__bucket", F.pmod("__order", F.lit(buckets)).cast("int")
    )
    columns = [f for f in pieces.schema if f.name != "__row"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns)
    packed = dealt.groupBy("__bucket").applyInPandas(run, f"{schema}, sequence_id bigint, `offset` bigint")
    full = pieces.where(F.col("length") >= length).select(
        *(f"`{f.name}`" for f in columns), (-1 - F.col("__row")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )
    return packed.unionByName(full)


def pack_documents(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text",
    length: int = LENGTH, end_id: int = END_ID, open_bins: int = OPEN_BINS, wave: int = WAVE,
    bucket_pieces: int = BUCKET_PIECES,
) -> DataFrame:
    """Tokenise, cut and pack documents into sequences of ``length`` tokens at most."""
    pieces = token_pieces(docs, tokenizer, key, text, length, end_id)
    pieces = stage(pieces.withColumn("__row", F.monotonically_increasing_id()), "pieces")
    buckets = max(1, -(-pieces.where(F.col("length") < length).count() // bucket_pieces))
    return pack(pieces, buckets, key, length, open_bins, wave)
