"""Values as text, CSV lines and row sizes, as column expressions.

The text form of a value depends on the column's type only, so it is chosen
once from the schema and runs as generated code.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.times import local_time_text

SERVICE_COLUMNS = ("_op", "_lsn", "_seqval", "_ts")

# Text of a timestamp, and sizes counted per row.
TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSS"
OFFSET_TIMESTAMP_FORMAT = TIMESTAMP_FORMAT + "xxx"
SEPARATOR_SIZE = 1
LINE_END_SIZE = 2
SERVICE_SIZE = 30

_QUOTED = ('"', ",", "\n", "\r")


def _floating_text(column: Column, digits: int) -> Column:
    """Shortest round-trip text without a trailing ``.0``.

    Plain notation for exponents from -4 up to ``digits - 1``, otherwise
    ``d.dddE+XX``. Text without an exponent only loses trailing zeros; the
    rest sits in a lambda, which keeps the generated code of wide rows small
    enough for the JIT compiler.
    """
    text = column.cast("string")
    rewritten = F.transform(F.array(text), lambda t: _exponent_text(t, digits))[0]
    # Java writes no other zeros at the end of a fraction.
    plain = F.when(F.endswith(text, F.lit(".0")), F.substr(text, F.lit(1), F.length(text) - 2)).otherwise(text)
    return F.when(F.contains(text, F.lit("E")), rewritten).otherwise(plain)


def _exponent_text(text: Column, digits: int) -> Column:
    """Text like ``-1.5E-7`` in the notation described above."""
    parts = F.split(text, "E")
    exponent = parts[1].cast("int")
    mantissa = F.regexp_replace(parts[0], r"\.0$", "")
    sign = F.when(F.startswith(text, F.lit("-")), F.lit("-")).otherwise(F.lit(""))
    figures = F.regexp_replace(mantissa, "[-.]", "")
    fraction = F.substr(figures, exponent + F.lit(2))
    large = F.concat(
        sign,
        F.rpad(figures, exponent + 1, F.lit("0")).substr(F.lit(1), exponent + 1),
        F.when(F.length(fraction) > 0, F.concat(F.lit("."), fraction)).otherwise(F.lit("")),
    )
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), figures)
    power = F.abs(exponent).cast("string")
    scientific = F.concat(
        mantissa,
        F.when(exponent < 0, F.lit("E-")).otherwise(F.lit("E+")),
        F.when(F.length(power) < 2, F.concat(F.lit("0"), power)).otherwise(power),
    )
    return (
        F.when((exponent >= 0) & (exponent < digits), large)
        .when((exponent < 0) & (exponent > -5), small)
        .otherwise(scientific)
    )


def value_text(field: T.StructField, column: Column | None = None) -> Column:
    """Text written for a value of ``field``; NULL stays NULL."""
    column = F.col(f"`{field.name}`") if column is None else column
    kind = field.dataType
    if isinstance(kind, T.StringType):
        return column
    if isinstance(kind, T.DoubleType):
        return _floating_text(column, 15)
    if isinstance(kind, T.FloatType):
        return _floating_text(column, 7)
    if isinstance(kind, T.TimestampNTZType):
        return local_time_text(column, "T", 7)
    if isinstance(kind, T.TimestampType):
        return F.date_format(column, OFFSET_TIMESTAMP_FORMAT)
    if isinstance(kind, T.DateType):
        return F.concat(column.cast("string"), F.lit("T00:00:00.0000000"))
    if isinstance(kind, T.BinaryType):
        return F.regexp_replace(F.base64(column), r"[\r\n]", "")
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(column)
    return column.cast("string")


def csv_field(text: Column) -> Column:
    """Quote text that holds a quote, comma or line break."""
    special = reduce(lambda a, b: a | b, (F.contains(text, F.lit(c)) for c in _QUOTED))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(special, quoted).otherwise(text)


def _may_need_quotes(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.StringType, T.ArrayType, T.MapType, T.StructType))


def _fields(df: DataFrame, columns: Sequence[str]) -> list[T.StructField | None]:
    """Schema fields of the wanted columns, names compared without case."""
    known = {field.name.lower(): field for field in df.schema.fields}
    return [known.get(name.lower()) for name in columns]


def _texts(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    return [
        F.lit("") if field is None else F.coalesce(value_text(field), F.lit(""))
        for field in _fields(df, columns)
    ]


def service_time_text(field: T.StructField) -> Column:
    """``_ts`` always carries an offset; a value without zone is UTC."""
    text = value_text(field)
    if isinstance(field.dataType, T.TimestampNTZType):
        return F.concat(text, F.lit("+00:00"))
    return text


def header_line(columns: Sequence[str], service: bool = False) -> str:
    names = [*SERVICE_COLUMNS, *columns] if service else list(columns)
    return ",".join(
        '"' + name.replace('"', '""') + '"' if any(c in name for c in _QUOTED) else name
        for name in names
    )


def row_size(df: DataFrame, columns: Sequence[str], service: bool = False) -> Column:
    """Estimated size of a row: text lengths, separators and line end."""
    texts = [value_text(field) for field in _fields(df, columns) if field is not None]
    fixed = len(columns) * SEPARATOR_SIZE + LINE_END_SIZE
    if service:
        texts += [F.col("_op"), F.col("_lsn"), F.col("_seqval")]
        fixed += SERVICE_SIZE
    # NULLs are left out, and one length is shorter code than many.
    return (F.length(F.concat_ws("", *texts)) + fixed).cast("bigint")


def csv_rows(
    df: DataFrame,
    columns: Sequence[str],
    service: bool = False,
    keep: Sequence[str] = (),
    size_name: str | None = None,
) -> DataFrame:
    """One CSV line per row in column order, as column ``line``.

    With ``service`` the change columns come first. ``keep`` carries further
    columns along, ``size_name`` adds the estimated row size.
    """
    projected: list[Column] = []
    quote: list[bool] = []
    if service:
        stamp = df.schema["_ts"]
        for name in SERVICE_COLUMNS:
            text = service_time_text(stamp) if name == "_ts" else F.col(name)
            projected.append(F.coalesce(text, F.lit("")))
            quote.append(False)
    for field, text in zip(_fields(df, columns), _texts(df, columns)):
        projected.append(text)
        quote.append(field is not None and _may_need_quotes(field))
    names = [f"__t{i}" for i in range(len(projected))]
    texts = df.select(*keep, *(c.alias(n) for c, n in zip(projected, names)))
    parts = [csv_field(F.col(n)) if q else F.col(n) for n, q in zip(names, quote)]
    output = [F.concat_ws(",", *parts).alias("line")]
    if size_name:
        # ``_ts`` counts with a fixed size, not with its text.
        stamp_at = SERVICE_COLUMNS.index("_ts") if service else -1
        counted = [name for position, name in enumerate(names) if position != stamp_at]
        fixed = len(columns) * SEPARATOR_SIZE + LINE_END_SIZE + (SERVICE_SIZE if service else 0)
        size = F.length(F.concat_ws("", *counted)) + fixed
        output.append(size.cast("bigint").alias(size_name))
    return texts.select(*keep, *output)
