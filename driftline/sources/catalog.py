"""What is known about source tables: keys, profile, extraction mode, schema."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Default row limit of a small table, and column types that can
# bound a snapshot by time.
SMALL_TABLE_ROWS = 1000
WATERMARK_TYPES = ("datetime", "datetime2", "datetimeoffset")

# SQL type names of Spark types.
SQL_TYPES = {
    T.StringType: "nvarchar",
    T.LongType: "bigint",
    T.IntegerType: "int",
    T.ShortType: "smallint",
    T.ByteType: "smallint",
    T.BooleanType: "bit",
    T.DoubleType: "float",
    T.FloatType: "real",
    T.DateType: "date",
    T.TimestampNTZType: "datetime2",
    T.TimestampType: "datetimeoffset",
    T.BinaryType: "varbinary",
    T.DecimalType: "decimal",
}
# Decimal digits of whole-number and floating types.
PRECISIONS = {"bigint": 19, "int": 10, "smallint": 5, "float": 53, "real": 24}

COLUMN_SCHEMA = T.ArrayType(
    T.StructType(
        [
            T.StructField("name", T.StringType()),
            T.StructField("sqlType", T.StringType()),
            T.StructField("isNullable", T.BooleanType()),
            T.StructField("maxLength", T.IntegerType()),
            T.StructField("precision", T.IntegerType()),
            T.StructField("scale", T.IntegerType()),
            T.StructField("ordinalPosition", T.IntegerType()),
        ]
    )
)


def key_check(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Is the column set unique and free of NULLs in the data? One row.

    Rows are counted per key before the shuffle, so repeated keys stay cheap.
    """
    any_null = reduce(lambda a, b: a | b, (F.col(name).isNull() for name in columns))
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n"))
    nulls = F.coalesce(F.sum(F.when(any_null, F.col("__n"))), F.lit(0)).cast("bigint")
    repeated = F.count(F.when(~any_null & (F.col("__n") > 1), 1))
    return counted.agg(
        nulls.alias("null_keys"), repeated.alias("duplicate_groups")
    ).select(
        ((F.col("null_keys") == 0) & (F.col("duplicate_groups") == 0)).alias("is_unique"),
        "null_keys",
        "duplicate_groups",
    )


def table_profile(
    tables: Mapping[str, DataFrame],
    keys: Mapping[str, Sequence[str]],
    cdc_tables: Iterable[str] = (),
    verify: bool = True,
) -> DataFrame:
    """One row per table: change capture, unique key and row count.

    With ``verify`` a key counts only when the data confirms it, which
    shuffles the keys of the whole table. Tables without a declared or
    verified key are just counted, which Parquet answers from its footers.
    """
    tracked = {name.lower() for name in cdc_tables}
    parts = []
    for name, df in tables.items():
        columns = keys.get(name)
        if columns and verify:
            counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n"))
            any_null = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in columns))
            part = counted.agg(
                (F.count(F.when(any_null | (F.col("__n") > 1), 1)) == 0).alias("has_unique_key"),
                F.coalesce(F.sum("__n"), F.lit(0)).cast("bigint").alias("estimated_rows"),
            )
        else:
            part = df.agg(F.count(F.lit(1)).alias("estimated_rows")).select(
                F.lit(bool(columns)).alias("has_unique_key"), "estimated_rows"
            )
        parts.append(
            part.select(
                F.lit(name).alias("table_name"),
                F.lit(name.lower() in tracked).alias("cdc_enabled"),
                "has_unique_key",
                "estimated_rows",
            )
        )
    return reduce(DataFrame.unionByName, parts)


def extraction_mode(profile: DataFrame, small_table_rows: int = SMALL_TABLE_ROWS) -> DataFrame:
    """Add ``mode`` (CDC, SNAP or BLOCK) and ``reason``."""
    keyed = F.col("cdc_enabled") | F.col("has_unique_key")
    small = F.col("estimated_rows") <= small_table_rows
    reason = (
        F.when(F.col("cdc_enabled"), "change capture is on")
        .when(F.col("has_unique_key"), "unique key")
        .when(small, F.lit(f"no unique key, at most {small_table_rows} rows"))
        .otherwise(F.lit(f"no unique key, more than {small_table_rows} rows"))
    )
    mode = F.when(keyed, "CDC").when(small, "SNAP").otherwise("BLOCK")
    return profile.withColumn("mode", mode).withColumn("reason", reason)


def _max_length(field: T.StructField) -> int | None:
    """Declared length of a text column, from its type or its metadata.

    Spark keeps the declaration of a char or varchar column it reads as text
    under the second key; ``maxLength`` is for sources that state it themselves.
    """
    if isinstance(field.dataType, (T.CharType, T.VarcharType)):
        return field.dataType.length
    if "maxLength" in field.metadata:
        return int(field.metadata["maxLength"])
    declared = re.fullmatch(r"(?:var)?char\((\d+)\)", field.metadata.get("__CHAR_VARCHAR_TYPE_STRING", ""))
    return int(declared[1]) if declared else None


def column_details(schema: T.StructType) -> list[dict]:
    """Column descriptions in ordinal order, from the schema alone."""
    details = []
    for position, field in enumerate(schema.fields, start=1):
        sql_type = SQL_TYPES.get(type(field.dataType), field.dataType.simpleString())
        scale = None
        precision = PRECISIONS.get(sql_type)
        if isinstance(field.dataType, T.DecimalType):
            precision, scale = field.dataType.precision, field.dataType.scale
        elif sql_type in ("bigint", "int", "smallint"):
            scale = 0
        details.append(
            {
                "name": field.name,
                "sqlType": sql_type,
                "isNullable": field.nullable,
                "maxLength": _max_length(field),
                "precision": precision,
                "scale": scale,
                "ordinalPosition": position,
            }
        )
    return details


def schema_json() -> Column:
    """Canonical text of a manifest row; leaves out when it was captured."""
    return F.to_json(
        F.struct(
            F.col("table_name").alias("table"),
            "columns",
            F.col("primary_key").alias("primaryKey"),
            F.col("unique_keys").alias("uniqueKeys"),
            F.col("watermark_column").alias("watermarkColumn"),
        )
    )


def schema_hash(json: Column) -> Column:
    return F.sha2(json, 256)


def schema_manifest(
    name: str,
    df: DataFrame,
    primary_key: Sequence[str] = (),
    unique_keys: Sequence[Sequence[str]] = (),
    verify: bool = True,
) -> DataFrame:
    """Manifest of a table: columns, keys, watermark column and hash. One row.

    Parquet declares no keys, so with ``verify`` a key is listed only when the
    data confirms it.
    """
    details = column_details(df.schema)
    watermark = next((c["name"] for c in details if c["sqlType"] in WATERMARK_TYPES), None)
    columns = F.array(
        *(
            F.struct(*(F.lit(value).cast(COLUMN_SCHEMA.elementType[key].dataType).alias(key)
                       for key, value in column.items()))
            for column in details
        )
    )

    def names(key: Sequence[str]) -> Column:
        return F.array(*(F.lit(c) for c in key)).cast("array<string>")

    def confirmed(key: Sequence[str], label: str) -> DataFrame:
        checked = key_check(df, key) if verify else df.sparkSession.range(1).select(
            F.lit(True).alias("is_unique")
        )
        return checked.select(
            F.lit(label).alias("label"), F.when(F.col("is_unique"), names(key)).alias("key")
        )

    declared = [(primary_key, "0")] if primary_key else []
    declared += [(key, f"{i + 1:06d}") for i, key in enumerate(unique_keys)]
    if declared:
        keys = reduce(DataFrame.unionByName, (confirmed(key, label) for key, label in declared))
        gathered = keys.agg(
            F.coalesce(
                F.max(F.when(F.col("label") == "0", F.col("key"))), names(())
            ).alias("primary_key"),
            F.transform(
                F.sort_array(
                    F.collect_list(
                        F.when(
                            (F.col("label") != "0") & F.col("key").isNotNull(),
                            F.struct("label", "key"),
                        )
                    )
                ),
                lambda entry: entry["key"],
            ).alias("unique_keys"),
        )
    else:
        gathered = df.sparkSession.range(1).select(
            names(()).alias("primary_key"),
            F.array().cast("array<array<string>>").alias("unique_keys"),
        )
    return (
        gathered.select(
            F.lit(name).alias("table_name"),
            columns.alias("columns"),
            "primary_key",
            "unique_keys",
            F.lit(watermark).cast("string").alias("watermark_column"),
        )
        .withColumn("manifest_json", schema_json())
        .withColumn("schema_hash", schema_hash(F.col("manifest_json")))
    )


def schema_changed(manifests: DataFrame, known: DataFrame) -> DataFrame:
    """Compare current hashes with known ones (both by ``table_name``).

    A table without a known hash counts as changed.
    """
    previous = known.select(
        F.lower("table_name").alias("__table"), F.col("schema_hash").alias("previous_hash")
    )
    current = manifests.select("table_name", F.col("schema_hash").alias("current_hash"))
    same = F.lower("previous_hash").eqNullSafe(F.lower("current_hash"))
    return (
        current.withColumn("__table", F.lower("table_name"))
        .join(previous, "__table", "left")
        .select("table_name", "previous_hash", "current_hash", (~same).alias("changed"))
    )
