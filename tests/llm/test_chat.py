"""Chat formatting: exact round trips and the loss mask."""

import random
import time

from driftline.llm import chat

ROWS = "conv_id bigint, turn bigint, role string, text string, formatted string, spans int"


def expected(rows):
    by_conv = {}
    for conv, turn, role, text in rows:
        by_conv.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for *_, r, t in sorted(turns)] for c, turns in by_conv.items()}


def test_round_trip_of_hard_texts(spark):
    chance = random.Random(2)
    parts = ["<|", "|>", "<", "|", ">", "\\", "\\\\", "end", "next", "<|end|>", "<|next|>", "a", "😀é", "\n", "user", "$1", "\\<"]
    rows = [
        (conv, chance.choice([None, *range(6)]), chance.choice(["user", "assistant", "system", None, "a|>b", ">", "<|", "|"]),
         chance.choice([None, "".join(chance.choice(parts) for _ in range(chance.randint(0, 9)))]))
        for conv in [None, *range(-2, 60)] for _ in range(chance.randint(1, 9))
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], ROWS)
    formatted = chat.format_chats(df)
    for row in chat.read_chats(formatted).collect():
        turns = expected(rows)[row.conv_id]
        assert [(t.role, t.text) for t in row.turns] == turns
        assert list(row.loss_texts) == [text for role, text in turns if role == "assistant"]
        assert row.formatted.count("<|end|>") == sum(
            i == 0 or turns[i][0] != turns[i - 1][0] for i in range(len(turns))
        )


def test_spans_lie_on_assistant_text_only(spark):
    rows = [(1, 0, "user", "hi 😀"), (1, 1, "assistant", "a|>b"), (1, 2, "assistant", "c"), (1, 3, "user", "assistant")]
    row = chat.format_chats(spark.createDataFrame([(*r, "x", 1) for r in rows], ROWS)).first()
    assert row.formatted == "<|user|>hi 😀<|end|><|assistant|>a|\\>b<|next|>c<|end|><|user|>assistant<|end|>"
    assert [row.formatted[s.start : s.start + s.length] for s in row.spans] == ["a|\\>b", "c"]


def test_long_conversation_and_empty_table(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(2000)] + [(2, 0, "user", "x" * 300_000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], ROWS)
    read = {r.conv_id: r for r in chat.read_chats(chat.format_chats(df)).collect()}
    assert len(read[1].turns) == 2000 and "".join(read[1].loss_texts) == "".join(f"t{i}" for i in range(1, 2000, 2))
    assert len(read[2].turns[0].text) == 300_000 and list(read[2].loss_texts) == []
    assert chat.format_chats(df.limit(0)).count() == 0


def test_time_follows_the_turns(spark):
    """One conversation of very many turns, and one whose turns are all of one role."""
    count = 100_000
    rows = spark.range(2 * count).selectExpr(
        "id % 2 AS conv_id", "id DIV 2 AS turn", "CASE WHEN id % 2 = 0 AND id DIV 2 % 3 > 0 THEN 'user' ELSE 'assistant' END AS role",
        "concat('é', id DIV 2) AS text",
    )
    begin = time.time()
    read = {r.conv_id: r for r in chat.read_chats(chat.format_chats(rows)).selectExpr(
        "conv_id", "size(turns) AS turns", "array_join(loss_texts, '') AS loss").collect()}
    assert time.time() - begin < 150
    assert read[0].turns == read[1].turns == count
    assert read[0].loss == "".join(f"é{i}" for i in range(0, count, 3)) and read[1].loss == "".join(f"é{i}" for i in range(count))


def test_repeated_rows_are_turns(spark):
    rows = [(1, 0, "assistant", "same")] * 3
    row = chat.read_chats(chat.format_chats(spark.createDataFrame([(*r, "x", 1) for r in rows], ROWS))).first()
    assert len(row.turns) == 3 and "".join(row.loss_texts) == "same" * 3
