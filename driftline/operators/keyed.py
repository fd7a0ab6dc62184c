"""Latest row per key, keyed merge and joins against one-row-per-key tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def latest_per_key(df: DataFrame, keys: Sequence[str], version: str | Sequence[str]) -> DataFrame:
    """The newest version of each key.

    A missing version is older than any other. Rows with equal versions are
    told apart by their other columns as far as these can be ordered (maps can
    not), so the result does not depend on how rows were spread. An aggregate,
    not a window: each task reduces its rows to one per key before the
    shuffle, so a hot key stays small.
    """
    versions = [version] if isinstance(version, str) else list(version)
    rest = [name for name in df.columns if name not in keys]
    ties = [n for n in rest if n not in versions and not _holds_map(df.schema[n].dataType)]
    order = F.struct(*versions, *ties)
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__row"))
    return newest.select(
        *(F.col(name) if name in keys else F.col(f"__row.`{name}`") for name in df.columns)
    )


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_holds_map(field.dataType) for field in kind)
    if isinstance(kind, T.ArrayType):
        return _holds_map(kind.elementType)
    return isinstance(kind, (T.MapType, T.VariantType))


def keyed_merge(
    current: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    version: str | Sequence[str],
    deleted_col: str = "deleted",
) -> DataFrame:
    """Insert, replace or delete rows of a keyed table in bulk.

    ``current`` has one row per key. Only the newest change per key counts; a
    change flagged ``deleted_col`` removes its row, one without a version says
    nothing and is passed over. Rows without a change are those an anti join
    leaves, so a small set of changes is broadcast and the table stays put.
    """
    versions = [version] if isinstance(version, str) else list(version)
    known = changes.dropna("all", subset=versions)
    newest = latest_per_key(known, keys, version)
    kept = newest.where(~F.coalesce(F.col(deleted_col), F.lit(False))).select(*current.columns)
    return current.join(newest.select(*keys), list(keys), "left_anti").select(*current.columns).union(kept)


def salted_lookup(
    facts: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "inner", salts: int | None = None
) -> DataFrame:
    """Join rows with a table of one row per key when keys may be hot.

    Rows of one key spread over ``salts`` tasks and the lookup row goes to
    each of them. By default that is a quarter of the shuffle partitions and 16
    at least, so a hot key gets more tasks where the session has more. ``how`` is ``inner`` or ``left``. Made for lookups that are
    aggregates, which AQE's own skew join does not split. Rows are told apart
    by a hash of their other columns, so ``facts`` should be free of copies.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    if salts is None:
        salts = max(16, int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4)
    others = [name for name in facts.columns if name not in keys]
    spread = F.pmod(F.xxhash64(*others) if others else F.lit(0), F.lit(salts)).cast("int")
    copies = lookup.withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    return facts.withColumn("__salt", spread).join(copies, [*keys, "__salt"], how).drop("__salt")
