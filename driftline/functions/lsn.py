"""Log sequence numbers as column expressions.

An LSN is ten bytes, ordered byte by byte. Columns hold its text form,
``0x`` and 20 upper-case hex digits: text order equals byte order, range
filters reach the Parquet scan, and files sorted by it prune by row group.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO_LSN = "0x" + "0" * 20
LAST_LSN = "0x" + "F" * 20

_HALF = (1 << 40) - 1
_SPELLING = re.compile(r"(?:0[xX])?([0-9A-Fa-f]{20})")


def canonical_lsn(text: str) -> str:
    """Canonical text of a single value the driver holds, from any accepted spelling."""
    match = _SPELLING.fullmatch(text)
    if not match:
        raise ValueError(f"not an LSN: {text!r}")
    return "0x" + match[1].upper()


def lsn_format(binary: Column) -> Column:
    """Ten bytes to text."""
    return F.concat(F.lit("0x"), F.hex(binary))


def is_lsn(text: Column) -> Column:
    return text.rlike(r"\A(0[xX])?[0-9A-Fa-f]{20}\z")


def lsn_text(text: Column, strict: bool = False) -> Column:
    """Any accepted spelling to the canonical text.

    Other text is NULL, or an error when ``strict``.
    """
    canonical = F.concat(F.lit("0x"), F.upper(F.right(text, F.lit(20))))
    other = (
        F.raise_error(F.concat(F.lit("not an LSN: "), F.coalesce(text, F.lit("NULL"))))
        if strict
        else F.lit(None)
    )
    return F.when(is_lsn(text), canonical).otherwise(other.cast("string"))


def lsn_parse(text: Column, strict: bool = False) -> Column:
    """Text to ten bytes, with the same rules as :func:`lsn_text`."""
    return F.unhex(F.substring(lsn_text(text, strict), 3, 20))


def next_lsn(text: str) -> str:
    """The next position of a single value the driver holds."""
    return f"0x{min(int(text, 16) + 1, (1 << 80) - 1):020X}"


def lsn_increment(text: Column) -> Column:
    """The next LSN, as an 80-bit number; NULL after the last one."""
    high = F.conv(F.substring(text, 3, 10), 16, 10).cast("bigint")
    low = F.conv(F.substring(text, 13, 10), 16, 10).cast("bigint")
    carry = low == F.lit(_HALF)
    next_low = F.when(carry, F.lit(0).cast("bigint")).otherwise(low + 1)
    next_high = F.when(carry, high + 1).otherwise(high)
    joined = F.concat(
        F.lit("0x"), F.lpad(F.hex(next_high), 10, "0"), F.lpad(F.hex(next_low), 10, "0")
    )
    return F.when(text < F.lit(LAST_LSN), joined)
