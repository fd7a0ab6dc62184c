"""Append-only ledgers, publication of datasets and reads through the ledger.

Every append goes to a folder of its own, so appends never meet. A dataset is
visible from the moment its COMMITTED row exists; its files, its chunk rows
and what a failed attempt left behind are not looked at before.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.text import SERVICE_COLUMNS
from driftline.operators.keyed import latest_per_key, salted_lookup
from driftline.session import delete_folder

LEDGERS = {
    "table_state": (
        "table_schema string, table_name string, extraction_mode string, "
        "last_processed_lsn string, bootstrap_status string, schema_hash string, "
        "capture_instance string, last_sync_time timestamp_ntz, error_message string, "
        "updated_at timestamp_ntz, version bigint, deleted boolean"
    ),
    "batch_history": (
        "batch_id string, source string, batch_type string, trigger string, status string, "
        "started_at timestamp_ntz, finished_at timestamp_ntz, epoch bigint, version bigint, "
        "tables_total bigint, tables_succeeded bigint, rows bigint, bytes bigint"
    ),
    "dataset_history": (
        "dataset_id string, batch_id string, table_schema string, table_name string, "
        "from_lsn string, to_lsn string, schema_hash string, status string, row_count bigint, "
        "chunk_count bigint, bytes_sent bigint, error_code string, error_message string, "
        "attempt string, version bigint"
    ),
    "chunk_manifest": (
        "dataset_id string, attempt string, chunk_no int, row_count bigint, "
        "compressed_size bigint, path string"
    ),
    "error_event": (
        "occurred_at timestamp_ntz, batch_id string, scope string, table string, "
        "dataset_id string, severity string, code string, message string, "
        "is_retryable boolean, is_terminal boolean"
    ),
    "stream_start": "stream string, table_name string, from_lsn string",
    "floor": "capture_instance string, floor_lsn string, recorded_at timestamp_ntz",
    "schema_manifest": (
        "table_name string, captured_at timestamp_ntz, schema_hash string, manifest_json string"
    ),
}

# Ledger statuses.
OPEN_DATASET = ("CREATED", "UPLOADING")
CLOSED_DATASET = ("COMMITTED", "ABORTED", "SKIPPED")
TERMINAL_RUN = ("SUCCEEDED", "FAILED", "ABORTED")
ALLOWED_STEPS = (
    ("CREATED", "UPLOADING"),
    ("CREATED", "SKIPPED"),
    ("CREATED", "ABORTED"),
    ("UPLOADING", "COMMITTED"),
    ("UPLOADING", "ABORTED"),
)


# Tasks that read chunks, at most.
MOST_READERS = 10_000
# Bytes that a reader parses at a time; twice as many while a row is longer, up
# to what the parser can count.
READ_BLOCK = 1 << 20
MOST_BLOCK = (1 << 31) - 1

_ARROW_TYPES = {
    "string": pa.string(),
    "long": pa.int64(),
    "integer": pa.int32(),
    "boolean": pa.bool_(),
    "timestamp_ntz": pa.timestamp("us"),
}


class LeaseConflict(RuntimeError):
    """A newer run of the same source exists; this one may not commit."""


class DatasetError(RuntimeError):
    """A dataset that must not be published."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def read_ledger(spark: SparkSession, root: str, name: str) -> DataFrame:
    """All rows of a ledger: its newest compaction and what was appended since."""
    reader = spark.read.schema(LEDGERS[name]).option("recursiveFileLookup", "true")
    covered, snapshot = _compaction(spark, root, name)
    try:
        if not snapshot:
            return reader.parquet(f"{root}/{name}")
        later = [f for f in _folders(spark, f"{root}/{name}", "append-") if f not in covered]
        return reader.parquet(*(f"{root}/{name}/{f}" for f in [snapshot, *later]))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return rows_frame(spark, [], LEDGERS[name])


def _folders(spark: SparkSession, path: str, prefix: str, finished: bool = False) -> list[str]:
    """Names of the folders in ``path``, on demand only those whose write has ended."""
    context = spark.sparkContext
    hadoop_path = context._jvm.org.apache.hadoop.fs.Path(path)
    filesystem = hadoop_path.getFileSystem(context._jsc.hadoopConfiguration())
    if not filesystem.exists(hadoop_path):
        return []
    names = [status.getPath().getName() for status in filesystem.listStatus(hadoop_path)]
    done = context._jvm.org.apache.hadoop.fs.Path
    return sorted(
        name
        for name in names
        if name.startswith(prefix) and (not finished or filesystem.exists(done(f"{path}/{name}/_SUCCESS")))
    )


def _compaction(spark: SparkSession, root: str, name: str) -> tuple[set[str], str | None]:
    """Folders that the newest compaction covers, and its own folder."""
    marks = _folders(spark, f"{root}/_compacted", f"{name}-", finished=True)
    if not marks:
        return set(), None
    rows = spark.read.parquet(f"{root}/_compacted/{marks[-1]}").collect()
    return {row.folder for row in rows if not row.made}, next(row.folder for row in rows if row.made)


def compact(spark: SparkSession, root: str, name: str) -> int:
    """Write a ledger's rows as one table; returns how many folders it covers.

    One compaction at a time. The new table counts from the moment its mark is
    written whole. Its mark also names what earlier ones covered and is still
    there, so nothing counts twice while that is deleted, or if it never is.
    Newly covered folders are deleted after the next compaction, so readers
    that listed them before still find them.
    """
    before, old = _compaction(spark, root, name)
    # An append that is not finished is left for the next compaction.
    present = _folders(spark, f"{root}/{name}", "append-", finished=True)
    later = [folder for folder in present if folder not in before]
    if not later:
        return 0
    made = f"table-{uuid.uuid4().hex}"
    parts = [*([old] if old else []), *later]
    reader = spark.read.schema(LEDGERS[name]).option("recursiveFileLookup", "true")
    rows = reader.parquet(*(f"{root}/{name}/{part}" for part in parts))
    rows.repartition(1 + len(parts) // 1000).write.parquet(f"{root}/{name}/{made}")
    number = 1 + len(_folders(spark, f"{root}/_compacted", f"{name}-"))
    gone = [folder for folder in present if folder in before]
    marks = [{"folder": made, "made": True}, *({"folder": folder, "made": False} for folder in [*gone, *later])]
    rows_frame(spark, marks, "folder string, made boolean").coalesce(1).write.parquet(
        f"{root}/_compacted/{name}-{number:09d}"
    )
    tables = _folders(spark, f"{root}/{name}", "table-")
    for folder in [*gone, *(table for table in tables if table not in (made, old))]:
        delete_folder(spark, f"{root}/{name}/{folder}")
    return len(later)


def append(df: DataFrame, root: str, name: str) -> None:
    columns = [field.name for field in T.StructType.fromDDL(LEDGERS[name]).fields]
    df.select(*columns).write.parquet(f"{root}/{name}/append-{uuid.uuid4().hex}")


def rows_frame(spark: SparkSession, rows: Sequence[dict], ddl: str) -> DataFrame:
    """A few rows the driver made itself, as one local partition."""
    schema = T.StructType.fromDDL(ddl)
    columns = {
        field.name: pa.array([row.get(field.name) for row in rows], _ARROW_TYPES[field.dataType.typeName()])
        for field in schema.fields
    }
    return spark.createDataFrame(pa.table(columns), schema=schema)


def append_rows(spark: SparkSession, root: str, name: str, rows: Sequence[dict]) -> None:
    """Append rows of the control plane: one run, one dataset, one state."""
    append(rows_frame(spark, rows, LEDGERS[name]), root, name)


def current_states(spark: SparkSession, root: str) -> DataFrame:
    """Newest state of each table; deleted ones are gone. Names ignore case."""
    ledger = read_ledger(spark, root, "table_state")
    keyed = ledger.withColumn("__s", F.lower("table_schema")).withColumn("__t", F.lower("table_name"))
    newest = latest_per_key(keyed, ["__s", "__t"], "version")
    return newest.where(~F.coalesce("deleted", F.lit(False))).drop("__s", "__t")


def current_runs(spark: SparkSession, root: str) -> DataFrame:
    return latest_per_key(read_ledger(spark, root, "batch_history"), ["batch_id"], "version")


def current_datasets(spark: SparkSession, root: str) -> DataFrame:
    return latest_per_key(read_ledger(spark, root, "dataset_history"), ["dataset_id"], "version")


def dataset_id(table: str, from_lsn: str, to_lsn: str) -> str:
    """The same table and range always give the same id."""
    return hashlib.sha256(f"{table.lower()}|{from_lsn}|{to_lsn}".encode()).hexdigest()


def dataset_id_column(table: Column, from_lsn: Column, to_lsn: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lower(table), from_lsn, to_lsn), 256)


def commit_once(candidates: DataFrame, committed: DataFrame) -> DataFrame:
    """Candidates not committed before, each (table, from, to) once, with their ids.

    Repeated candidates collapse before the join, so both sides are unique;
    ids are computed for what is left.
    """
    keys = ["table_name", "from_lsn", "to_lsn"]

    def once(df: DataFrame) -> DataFrame:
        return df.select(F.lower("table_name").alias("table_name"), *keys[1:]).distinct()

    new = once(candidates).join(once(committed), keys, "left_anti")
    return new.withColumn("dataset_id", dataset_id_column(*(F.col(k) for k in keys)))


def is_superseded(spark: SparkSession, root: str, run: dict) -> bool:
    """Whether a later run of the same source was opened.

    Runs are ordered by (epoch, id). Two that were opened at once have equal
    epochs and different ids, so one of them is the later one for both.
    """
    newest = (
        read_ledger(spark, root, "batch_history")
        .where(F.col("source") == run["source"])
        .agg(F.max(F.struct("epoch", "batch_id")))
        .first()[0]
    )
    return newest is not None and tuple(newest) > (run["epoch"], run["batch_id"])


def committed_row(spark: SparkSession, root: str, identity: str) -> dict | None:
    """The dataset's newest row if that is a COMMITTED one."""
    rows = (
        read_ledger(spark, root, "dataset_history")
        .where(F.col("dataset_id") == identity)
        .orderBy(F.desc("version"))
        .limit(1)
        .collect()
    )
    return rows[0].asDict() if rows and rows[0].status == "COMMITTED" else None


def committed_ends(spark: SparkSession, root: str) -> DataFrame:
    """Where the committed changes of each table end: ``table`` (lower case) and ``to_lsn``."""
    return (
        current_datasets(spark, root)
        .where((F.col("status") == "COMMITTED") & F.col("from_lsn").isNotNull())
        .groupBy(F.lower(F.concat_ws(".", "table_schema", "table_name")).alias("table"))
        .agg(F.max("to_lsn").alias("to_lsn"))
    )


def recorded_floors(spark: SparkSession, root: str) -> DataFrame:
    """Highest floor that purges recorded for each capture instance."""
    return read_ledger(spark, root, "floor").groupBy("capture_instance").agg(F.max("floor_lsn").alias("floor_lsn"))


def publish(
    spark: SparkSession,
    root: str,
    run: dict,
    dataset: dict,
    files: DataFrame,
) -> dict:
    """Make the chunks of a dataset visible, all at once.

    Chunk rows are appended first and the COMMITTED row last. A range that was
    committed before keeps its first result. A superseded run may not commit,
    and neither may a dataset with a row above the chunk limit. The test is
    made again after the COMMITTED row: a run that was superseded in between
    takes it back, and readers look at the newest row only.
    """
    if is_superseded(spark, root, run):
        raise LeaseConflict(f"run {run['batch_id']} was superseded")
    earlier = committed_row(spark, root, dataset["dataset_id"])
    if earlier:
        return earlier
    totals = files.agg(
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("row_count"),
        F.count(F.lit(1)).alias("chunk_count"),
        F.coalesce(F.sum("compressed_size"), F.lit(0)).alias("bytes_sent"),
        F.coalesce(F.sum("oversize_rows"), F.lit(0)).alias("oversize_rows"),
    ).first()
    if totals.oversize_rows:
        raise DatasetError("ROW_TOO_LARGE", f"{totals.oversize_rows} rows exceed the chunk limit")
    marked = files.withColumn("dataset_id", F.lit(dataset["dataset_id"])).withColumn(
        "attempt", F.lit(dataset["attempt"])
    )
    append(marked, root, "chunk_manifest")
    row = {
        **dataset,
        "status": "COMMITTED",
        "row_count": totals.row_count,
        "chunk_count": totals.chunk_count,
        "bytes_sent": totals.bytes_sent,
        "version": 2,
    }
    append_rows(spark, root, "dataset_history", [row])
    if is_superseded(spark, root, run):
        taken_back = {**row, "status": "ABORTED", "error_code": "LEASE_CONFLICT", "version": 3}
        append_rows(spark, root, "dataset_history", [taken_back])
        raise LeaseConflict(f"run {run['batch_id']} was superseded")
    return row


def committed_rows(spark: SparkSession, root: str, identities: Sequence[str]) -> dict[str, dict]:
    """The newest row of each of these datasets whose newest row is a COMMITTED one."""
    if not identities:
        return {}
    newest = latest_per_key(
        read_ledger(spark, root, "dataset_history").where(F.col("dataset_id").isin(list(identities))), ["dataset_id"], "version"
    )
    return {row.dataset_id: row.asDict() for row in newest.where("status = 'COMMITTED'").collect()}


def publish_many(spark: SparkSession, root: str, run: dict, datasets: Sequence[dict], files: DataFrame) -> list[dict]:
    """Make the chunks of several datasets visible; ``files`` names them by place in ``datasets``, as ``job``.

    As :func:`publish`, but chunk rows and COMMITTED rows of all are appended
    together, so the cost does not follow the number of datasets. Datasets with
    a row above the chunk limit are left out and come back as ABORTED rows,
    which are not recorded here.
    """
    if is_superseded(spark, root, run):
        raise LeaseConflict(f"run {run['batch_id']} was superseded")
    # One row per dataset.
    totals = {
        row.job: row for row in files.groupBy("job").agg(
            F.sum("row_count").alias("row_count"), F.count(F.lit(1)).alias("chunk_count"),
            F.sum("compressed_size").alias("bytes_sent"), F.sum("oversize_rows").alias("oversize_rows"),
        ).collect()
    }
    rows = []
    for number, dataset in enumerate(datasets):
        found = totals.get(number)
        if found and found.oversize_rows:
            message = f"{found.oversize_rows} rows exceed the chunk limit"
            rows.append({**dataset, "status": "ABORTED", "error_code": "ROW_TOO_LARGE", "error_message": message})
            continue
        rows.append({
            **dataset, "status": "COMMITTED", "row_count": found.row_count if found else 0,
            "chunk_count": found.chunk_count if found else 0, "bytes_sent": found.bytes_sent if found else 0, "version": 2,
        })
    good = [(number, row) for number, row in enumerate(rows) if row["status"] == "COMMITTED"]
    names = rows_frame(
        spark, [{"job": number, "dataset_id": row["dataset_id"], "attempt": row["attempt"]} for number, row in good],
        "job int, dataset_id string, attempt string",
    )
    append(files.join(F.broadcast(names), "job"), root, "chunk_manifest")
    append_rows(spark, root, "dataset_history", [row for _, row in good])
    if is_superseded(spark, root, run):
        taken_back = {"status": "ABORTED", "error_code": "LEASE_CONFLICT", "version": 3}
        append_rows(spark, root, "dataset_history", [{**row, **taken_back} for _, row in good])
        raise LeaseConflict(f"run {run['batch_id']} was superseded")
    return rows


def committed_chunks(spark: SparkSession, root: str, table: str | None = None) -> DataFrame:
    """Chunk rows of committed datasets only."""
    datasets = current_datasets(spark, root).where(F.col("status") == "COMMITTED")
    if table:
        datasets = datasets.where(
            F.lower(F.concat_ws(".", "table_schema", "table_name")) == table.lower()
        )
    chunks = read_ledger(spark, root, "chunk_manifest")
    # A large dataset may own most of the chunks.
    return salted_lookup(chunks, datasets.select("dataset_id", "attempt"), ["dataset_id", "attempt"])


def read_committed(
    spark: SparkSession,
    root: str,
    table: str,
    schema: T.StructType,
    service: bool = False,
    dataset_ids: Iterable[str] | None = None,
) -> DataFrame:
    """Rows of a table's committed datasets, typed by ``schema``.

    Snapshots and deltas read together: columns are found by the name in each
    chunk's header, and what a chunk does not have is NULL (the service columns
    of a snapshot, columns added later). ``_chunk_file`` sorts in chunk order
    within a dataset. An empty field is NULL: the format does not tell it from
    empty text. Tasks open the chunks themselves, so no list of them is made on
    the driver.
    """
    chunks = committed_chunks(spark, root, table)
    if dataset_ids is not None:
        chunks = chunks.where(F.col("dataset_id").isin(list(dataset_ids)))
    names = [*(SERVICE_COLUMNS if service else ()), *(f.name for f in schema.fields)]
    text = T.StructType([T.StructField(name, T.StringType()) for name in [*names, "_chunk_file"]])
    paths = chunks.select("path")
    # Explicit, because sizes of paths say nothing of the sizes of files.
    spread = max(1, min(paths.count(), MOST_READERS))
    rows = paths.repartition(spread, "path").mapInArrow(_chunk_rows(names), text)
    return rows.select(
        *names[: len(names) - len(schema.fields)], *(_typed(f) for f in schema.fields), "_chunk_file"
    )


def _chunk_rows(names: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import csv
        from pyarrow import fs as pafs

        convert = csv.ConvertOptions(
            column_types=dict.fromkeys(names, pa.string()),
            include_columns=list(names),
            include_missing_columns=True,
            null_values=[""],
            strings_can_be_null=True,
        )
        parse = csv.ParseOptions(newlines_in_values=True)

        def parts(path: str, block: int, done: int) -> Iterator[pa.RecordBatch]:
            """Rows after the first ``done`` ones, read in blocks of ``block`` bytes."""
            filesystem, place = pafs.FileSystem.from_uri(path)
            read = csv.ReadOptions(block_size=block)
            with filesystem.open_input_stream(place, compression="gzip") as stream:
                file = pa.scalar(place.rsplit("/", 1)[-1])
                for part in csv.open_csv(stream, read_options=read, parse_options=parse, convert_options=convert):
                    skipped = min(done, part.num_rows)
                    done -= skipped
                    part = part.slice(skipped)
                    if part.num_rows:
                        of = pa.repeat(file, part.num_rows)
                        yield pa.RecordBatch.from_arrays([*part.columns, of], names=[*names, "_chunk_file"])

        for batch in batches:
            for path in batch.column(0).to_pylist():
                block, done = READ_BLOCK, 0
                while True:
                    try:
                        for part in parts(path, block, done):
                            done += part.num_rows
                            yield part
                        break
                    except pa.ArrowInvalid as error:
                        # A row has to fit a block: go on after the rows read so far, in larger blocks.
                        if "straddl" not in str(error) or block == MOST_BLOCK:
                            raise
                        block = min(2 * block, MOST_BLOCK)

    return run


def _typed(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.BinaryType):
        return F.unbase64(column).alias(field.name)
    if isinstance(field.dataType, T.DateType):
        return F.substring(column, 1, 10).cast("date").alias(field.name)
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.from_json(column, field.dataType).alias(field.name)
    return column.cast(field.dataType).alias(field.name)


def upsert_schemas(manifests: DataFrame, root: str, now: Column) -> None:
    """Store manifests whose (table, hash) is new."""
    known = read_ledger(manifests.sparkSession, root, "schema_manifest").select(
        "table_name", "schema_hash"
    )
    new = manifests.join(known, ["table_name", "schema_hash"], "left_anti")
    append(new.withColumn("captured_at", now), root, "schema_manifest")


def ledger_check(runs: DataFrame, datasets: DataFrame) -> DataFrame:
    """Ledger rows that break a rule: ``kind``, ``id`` and ``rule``."""
    closed = F.col("status").isin(*TERMINAL_RUN)
    run_rules = {
        "unknown status": ~closed & (F.col("status") != "RUNNING"),
        "running but finished": (F.col("status") == "RUNNING") & F.col("finished_at").isNotNull(),
        "finished without end": closed & F.col("finished_at").isNull(),
        "ends before it starts": F.col("finished_at") < F.col("started_at"),
    }
    done = F.col("status").isin(*CLOSED_DATASET)
    dataset_rules = {
        "unknown status": ~done & ~F.col("status").isin(*OPEN_DATASET),
        "aborted without code": (F.col("status") == "ABORTED") & F.col("error_code").isNull(),
        "skipped with rows": (F.col("status") == "SKIPPED") & (F.col("row_count") > 0),
        "open in a finished run": F.col("__run_closed") & ~done,
        "no such run": F.col("__run_closed").isNull(),
    }
    # Both sides are plain tables: AQE splits a run with very many datasets.
    owners = runs.select("batch_id", closed.alias("__run_closed"))
    with_run = datasets.select("dataset_id", "batch_id", "status", "error_code", "row_count").join(
        owners, "batch_id", "left"
    )
    return _violations(runs, "run", "batch_id", run_rules).unionByName(
        _violations(with_run, "dataset", "dataset_id", dataset_rules)
    )


def _violations(df: DataFrame, kind: str, key: str, rules: dict[str, Column]) -> DataFrame:
    broken = F.filter(
        F.array(*(F.when(test, F.lit(rule)) for rule, test in rules.items())),
        lambda rule: rule.isNotNull(),
    )
    return df.select(
        F.lit(kind).alias("kind"),
        F.col(key).cast("string").alias("id"),
        F.explode(broken).alias("rule"),
    )


def step_check(history: DataFrame) -> DataFrame:
    """Status changes of a dataset that are not allowed, from its ledger versions.

    Versions are consecutive, so each row meets its successor by an equi-join
    on (dataset, version). Repeated ledger rows collapse first.
    """
    history = history.select("dataset_id", "version", "status").distinct()
    after = history.select(
        "dataset_id",
        (F.col("version") - 1).alias("version"),
        F.col("status").alias("next_status"),
    )
    steps = history.join(after, ["dataset_id", "version"])
    allowed = F.concat_ws(">", "status", "next_status").isin(*(f"{a}>{b}" for a, b in ALLOWED_STEPS))
    return steps.where(~allowed)


