"""Labels and short texts: change operations, log levels, durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftline.functions.times import millis_between

# Operation codes of a change row.
DELETE, INSERT, UPDATE_OLD, UPDATE_NEW = 1, 2, 3, 4
OP_LABELS = {DELETE: "D", INSERT: "I", UPDATE_OLD: "UO", UPDATE_NEW: "UN"}
SIMPLE_OP_LABELS = {DELETE: "D", INSERT: "I", UPDATE_NEW: "U"}

# Log level names and their ranks; names not listed rank as 1.
LEVEL_RANKS = {
    "VERBOSE": -1,
    "DBG": 0,
    "DEBUG": 0,
    "INF": 1,
    "INFO": 1,
    "INFORMATION": 1,
    "WRN": 2,
    "WARN": 2,
    "WARNING": 2,
    "ERR": 3,
    "ERROR": 3,
    "FATAL": 4,
}
OTHER_LEVEL_RANK = 1


def op_label(code: Column, simple: bool = False) -> Column:
    """Operation code to its label, unknown codes to their number.

    The simple form has I, U and D only; old images have no label there
    (NULL), so filter them out first with ``code <> 3``.
    """
    labels = SIMPLE_OP_LABELS if simple else OP_LABELS
    label = F.when(code == DELETE, labels[DELETE]).when(code == INSERT, labels[INSERT])
    label = label.when(code == UPDATE_NEW, labels[UPDATE_NEW])
    old_image = F.lit(None).cast("string") if simple else F.lit(labels[UPDATE_OLD])
    return label.when(code == UPDATE_OLD, old_image).otherwise(code.cast("string"))


def level_rank(level: Column) -> Column:
    name = F.upper(F.trim(level))
    ranks: dict[int, list[str]] = {}
    for text, rank in LEVEL_RANKS.items():
        ranks.setdefault(rank, []).append(text)
    expression = None
    for rank, names in ranks.items():
        test = name.isin(names)
        expression = F.when(test, rank) if expression is None else expression.when(test, rank)
    return expression.otherwise(OTHER_LEVEL_RANK)


def level_rank_of(level: str) -> int:
    return LEVEL_RANKS.get(level.strip().upper(), OTHER_LEVEL_RANK)


def duration_text(started: Column, finished: Column) -> Column:
    """``12.3s`` below a minute, else ``1.2m``; ``In progress`` while open.

    Tenths are rounded half up in whole milliseconds.
    """
    millis = millis_between(started, finished)

    def tenths(unit_millis: int, suffix: str) -> Column:
        step = unit_millis // 10
        count = F.floor((millis + step // 2) / step).cast("bigint")
        return F.concat(
            F.floor(count / 10).cast("bigint").cast("string"),
            F.lit("."),
            (count % 10).cast("string"),
            F.lit(suffix),
        )

    return (
        F.when(finished.isNull(), F.lit("In progress"))
        .when(millis < 60_000, tenths(1_000, "s"))
        .otherwise(tenths(60_000, "m"))
    )
