r"""Chat formatting in Spark expressions: turns to one marked text with a loss mask.

The turns of a conversation are collected as structs and sorted by turn, role
and text. Adjacent turns of one role become one block; the turns inside a
block are kept apart by a mark, so the turns can be read back as they were.

    <|system|>text<|end|><|user|>text<|next|>text<|end|><|assistant|>text<|end|>

Inside roles and texts a backslash goes before every backslash, every ``|``
after ``<`` and every ``>`` after ``|``. So no text can hold the start or the
end of a mark, and dropping these backslashes gives the text back.
``spans`` are the places of assistant texts in the formatted text (start from
0 and length, in code points and in bytes, still escaped), in order. Time is
near linear in the turns of a conversation.

Null text and null role count as empty; a null turn sorts first; rows with a
null conversation are one conversation of their own. Repeated rows are turns
of their own. A conversation has to fit into one row, whatever its length; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOSS_ROLE = "assistant"
OPEN, CLOSE, NEXT, END = "<|", "|>", "<|next|>", "<|end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\|(?<=<)\||(?<=\|)>", r"\\$0")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|>])", "$1")


def _bound(df: DataFrame, **columns: Column) -> DataFrame:
    """Columns that later expressions read as they are, instead of computing them for every element."""
    for name, column in columns.items():
        df = df.select(*(c for c in df.columns if c != name), F.explode(F.array(column)).alias(name))
    return df


def _starts(turns: str) -> Column:
    """Where blocks start: at turns whose role differs from the one before, counted from 1."""
    before = lambda i: F.element_at(turns, F.greatest(i - 1, F.lit(1)))["role"]
    return F.filter(
        F.sequence(F.lit(1), F.size(turns)), lambda i: (i == 1) | (F.element_at(turns, i)["role"] != before(i))
    )


def _blocks(turns: str, starts: str) -> Column:
    """Sorted turns as an array of blocks (role, texts)."""
    return F.transform(
        starts,
        lambda start, k: F.struct(
            F.element_at(turns, start)["role"].alias("role"),
            F.transform(
                F.slice(turns, start, F.coalesce(F.get(starts, k + 1), F.size(turns) + 1) - start), lambda turn: turn["text"]
            ).alias("texts"),
        ),
    )


def _spans(df: DataFrame) -> DataFrame:
    """``spans`` of the parts under the loss mask.

    Running sums go over blocks of about the root of the number of parts, then
    over the blocks, so that no list grows with every part.
    """
    zero = F.lit(0).cast("bigint")
    span = "array<struct<start:bigint,length:bigint,at_byte:bigint,bytes:bigint>>"
    size = F.ceil(F.sqrt(F.size("parts"))).cast("int")

    def within(number: Column) -> Column:
        return F.aggregate(
            F.slice("parts", number * size + 1, size),
            F.struct(zero.alias("at"), zero.alias("at_byte"), F.array().cast(span).alias("spans")),
            lambda seen, part: F.struct(
                (seen["at"] + part["length"]).alias("at"),
                (seen["at_byte"] + part["bytes"]).alias("at_byte"),
                F.when(
                    part["loss"],
                    F.concat(seen["spans"], F.array(F.struct(
                        seen["at"].alias("start"), part["length"].alias("length"), seen["at_byte"].alias("at_byte"), part["bytes"].alias("bytes")
                    ))),
                ).otherwise(seen["spans"]).alias("spans"),
            ),
        )

    offsets = F.aggregate(
        "inside",
        F.struct(zero.alias("at"), zero.alias("at_byte"), F.array().cast("array<struct<at:bigint,at_byte:bigint>>").alias("before")),
        lambda seen, block: F.struct(
            (seen["at"] + block["at"]).alias("at"), (seen["at_byte"] + block["at_byte"]).alias("at_byte"),
            F.concat(seen["before"], F.array(F.struct(seen["at"].alias("at"), seen["at_byte"].alias("at_byte")))).alias("before"),
        ),
        lambda seen: seen["before"],
    )
    numbers = F.sequence(F.lit(0), F.ceil(F.size("parts") / size).cast("int") - 1)
    df = _bound(df, inside=F.transform(numbers, within), before=offsets)
    return df.withColumn("spans", F.flatten(F.transform(
        "inside",
        lambda block, k: F.transform(block["spans"], lambda s: F.struct(
            (s["start"] + F.get("before", k)["at"]).alias("start"), s["length"].alias("length"),
            (s["at_byte"] + F.get("before", k)["at_byte"]).alias("at_byte"), s["bytes"].alias("bytes"),
        )),
    )))


def format_chats(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
    text: str = "text", loss_role: str = LOSS_ROLE,
) -> DataFrame:
    """``conv``, ``formatted`` and ``spans`` (array of start, length, and both in bytes) per conversation."""
    turns = rows.select(
        F.col(conv).alias("conv"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(role, F.lit("")).alias("role"),
            F.coalesce(text, F.lit("")).alias("text"),
        ).alias("t"),
    )
    collected = turns.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    shown = _bound(_bound(collected, starts=_starts("turns")), blocks=_blocks("turns", "starts")).select("conv", "blocks")
    # Alternating outer parts and texts: every odd element is one turn's text.
    parts = F.flatten(
        F.transform(
            "blocks",
            lambda block: F.flatten(
                F.transform(
                    block["texts"],
                    lambda body, i: F.array(
                        F.struct(
                            F.when(i == 0, F.concat(F.lit(OPEN), escape(block["role"]), F.lit(CLOSE)))
                            .otherwise(F.lit(NEXT)).alias("s"),
                            F.lit(False).alias("loss"),
                        ),
                        F.struct(escape(body).alias("s"), (block["role"] == loss_role).alias("loss")),
                        F.struct(
                            F.when(i == F.size(block["texts"]) - 1, F.lit(END)).otherwise(F.lit("")).alias("s"),
                            F.lit(False).alias("loss"),
                        ),
                    ),
                )
            ),
        )
    )
    placed = _bound(shown.select("conv", parts.alias("parts")), parts=F.transform("parts", lambda part: F.struct(
        part["s"].alias("s"), part["loss"].alias("loss"),
        F.length(part["s"]).cast("bigint").alias("length"), F.octet_length(part["s"]).cast("bigint").alias("bytes"),
    )))
    return _spans(placed).select(
        F.col("conv").alias(conv),
        F.array_join(F.transform("parts", lambda part: part["s"]), "").alias("formatted"),
        "spans",
    )


def read_chats(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Read formatted texts back: ``turns`` (role, text) and ``loss_texts`` under the spans."""
    # Every block ends with a mark, so the last element is empty and no other is.
    blocks = F.filter(F.split("formatted", r"<\|end\|>", -1), lambda block: block != "")
    def opened(block: Column) -> Column:
        block = F.substr(block, F.lit(len(OPEN) + 1))
        body = F.substr(block, F.instr(block, CLOSE) + len(CLOSE))
        return F.struct(
            unescape(F.substring_index(block, CLOSE, 1)).alias("role"),
            F.split(body, r"<\|next\|>", -1).alias("bodies"),
        )

    read = _bound(
        formatted.select(F.col(conv).alias("conv"), "formatted", "spans"),
        blocks=F.transform(blocks, opened), data=F.encode("formatted", "UTF-8"),
    )
    turns = F.flatten(F.transform("blocks", lambda block: F.transform(
        block["bodies"], lambda body: F.struct(block["role"].alias("role"), unescape(body).alias("text"))
    )))
    # Places in bytes are reached without reading what is before them.
    loss = F.transform("spans", lambda span: unescape(F.decode(
        F.substr("data", (span["at_byte"] + 1).cast("int"), span["bytes"].cast("int")), "UTF-8"
    )))
    return read.select(F.col("conv").alias(conv), "formatted", turns.alias("turns"), loss.alias("loss_texts"))
