"""Session settings and the shared folder for staged tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings a job should start with. Sizes are per task: AQE merges small
# shuffle partitions, so a high initial number costs little.
RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "20000",
    # State of streams on local disk rather than in memory.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

_LOCAL_FOLDERS: dict[str, str] = {}
_OPEN_STAGES: list[list[str]] = []


def session(app_name: str = "driftline", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; on a
    cluster a missing setting is an error.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="driftline-")
    return _LOCAL_FOLDERS[context.applicationId]


def new_folder(spark: SparkSession, name: str) -> str:
    """Path of a new folder below the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def qualified_uri(spark: SparkSession, path: str) -> str:
    """Path with its scheme, a bare one resolved as Spark itself resolves it."""
    context = spark.sparkContext
    hadoop_path = context._jvm.org.apache.hadoop.fs.Path(path)
    filesystem = hadoop_path.getFileSystem(context._jsc.hadoopConfiguration())
    uri = filesystem.makeQualified(hadoop_path).toString()
    return "file://" + uri.removeprefix("file:") if uri.startswith("file:/") else uri


def delete_folder(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    hadoop_path = context._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(context._jsc.hadoopConfiguration()).delete(hadoop_path, True)


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what is staged inside; results must be written by then.

    Without it staged tables stay for the life of the shared folder, since a
    lazy result may still read them.
    """
    _OPEN_STAGES.append([])
    try:
        yield
    finally:
        for path in _OPEN_STAGES.pop():
            delete_folder(spark, path)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, so values that depend on how rows were partitioned stay
    fixed, and a lost executor costs a re-read rather than a re-computation.
    """
    spark = df.sparkSession
    path = new_folder(spark, f"stage/{name}")
    for opened in _OPEN_STAGES[-1:]:
        opened.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
