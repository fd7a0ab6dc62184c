"""Change tables, ledgers and logs that Spark derives from the given tables.

Every order is inserted; pending ones are filled 30 days later and low
priority ones deleted after 60 days. Every row of a base table contributes, so
each feed grows with the data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "1990-01-01"
ORDERS, CUSTOMER, LINEITEM = "dbo_orders", "dbo_customer", "dbo_lineitem"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lsn(day: Column, number: Column) -> Column:
    """Position made of a day (4 bytes) and a number within it (6 bytes)."""
    return F.concat(
        F.lit("0x"),
        F.lpad(F.hex(day.cast("bigint")), 8, "0"),
        F.lpad(F.hex(number.cast("bigint")), 12, "0"),
    )


def day_of(ts: Column) -> Column:
    return F.datediff(ts, F.lit(EPOCH).cast("date"))


def _day_start(day: Column) -> Column:
    return F.date_add(F.lit(EPOCH).cast("date"), day).cast("timestamp_ntz")


def _events(base: DataFrame, filled: Column, deleted: Column) -> DataFrame:
    """Explode each row into its changes: code, days later, number in the position."""

    def step(code: int, later: int, number: int) -> Column:
        return F.struct(
            F.lit(code).alias("code"), F.lit(later).alias("later"), F.lit(number).alias("number")
        )

    steps = F.array(
        step(2, 0, 1),
        F.when(filled, step(3, 30, 3)),
        F.when(filled, step(4, 30, 3)),
        F.when(deleted, step(1, 60, 5)),
    )
    return base.withColumn("__step", F.explode(F.filter(steps, lambda s: s.isNotNull())))


def _positions(df: DataFrame, instance: Column) -> list[Column]:
    day = F.col("__day") + F.col("__step.later")
    number = F.col("__number") + F.col("__step.number")
    return [
        instance.alias("capture_instance"),
        lsn(day, number).alias("_lsn"),
        lsn(day, number + 1).alias("_seqval"),
        F.col("__step.code").alias("_op_code"),
        _day_start(day).alias("_ts"),
    ]


def lineitem_ct(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as inserts on the day they were shipped."""
    lines = table(spark, sf, "lineitem")
    day, number = day_of(F.col("l_shipdate")), F.col("l_orderkey") * 16 + F.col("l_linenumber")
    return lines.select(
        F.lit(LINEITEM).alias("capture_instance"),
        lsn(day, number).alias("_lsn"),
        lsn(day, number + 1).alias("_seqval"),
        F.lit(2).alias("_op_code"),
        _day_start(day).alias("_ts"),
        *lines.columns,
    )


def orders_ct(spark: SparkSession, sf: str, instance: Column | None = None) -> DataFrame:
    orders = table(spark, sf, "orders")
    pending, low = F.col("o_orderstatus") == "P", F.col("o_orderpriority") == "5-LOW"
    base = orders.withColumn("__day", day_of(F.col("o_orderdate"))).withColumn(
        "__number", F.col("o_orderkey") * 16
    )
    events = _events(base, pending, low)
    code = F.col("__step.code")
    filled = pending & code.isin(4, 1)
    changed = {
        "o_orderstatus": F.when(filled, "F").otherwise(F.col("o_orderstatus")),
        "o_totalprice": F.when(filled, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")),
    }
    return events.select(
        *_positions(events, F.lit(ORDERS) if instance is None else instance),
        *(changed.get(name, F.col(name)).alias(name) for name in orders.columns),
    )


def tenant_ct(spark: SparkSession, sf: str) -> DataFrame:
    """The order changes as one capture instance per customer."""
    return orders_ct(spark, sf, F.concat(F.lit("ci_"), F.col("o_custkey")))


def customer_ct(spark: SparkSession, sf: str) -> DataFrame:
    customer = table(spark, sf, "customer")
    debt, gone = F.col("c_acctbal") < 0, F.col("c_mktsegment") == "MACHINERY"
    base = customer.withColumn("__day", F.col("c_nationkey") + 2000).withColumn(
        "__number", F.col("c_custkey") * 16 + 8
    )
    events = _events(base, debt, gone)
    settled = debt & F.col("__step.code").isin(4, 1)
    balance = F.when(settled, F.lit(0.0)).otherwise(F.col("c_acctbal"))
    return events.select(
        *_positions(events, F.lit(CUSTOMER)),
        *((balance if n == "c_acctbal" else F.col(n)).alias(n) for n in customer.columns),
    )


def feed(spark: SparkSession, sf: str) -> DataFrame:
    """Positions of all changes of both tables."""
    parts = [orders_ct(spark, sf), customer_ct(spark, sf)]
    return reduce(
        DataFrame.unionByName,
        (p.select("capture_instance", "_lsn", "_seqval", "_op_code", "_ts") for p in parts),
    )


def states(spark: SparkSession, sf: str) -> DataFrame:
    """One tracked table per customer."""
    nation, segment = F.col("c_nationkey"), F.col("c_mktsegment")
    day = (
        F.when(nation.between(10, 12), F.lit(1500))
        .when(nation.between(13, 15), F.lit(9999))
        .otherwise(F.lit(3000) + nation * 50)
    )
    pending = nation < 3
    return table(spark, sf, "customer").select(
        F.lit("dbo").alias("table_schema"),
        F.col("c_name").alias("table_name"),
        F.when(segment == "HOUSEHOLD", "SNAP")
        .when((segment == "FURNITURE") & (nation == 20), "BLOCK")
        .otherwise("CDC")
        .alias("extraction_mode"),
        F.when(~pending, lsn(day, F.col("c_custkey"))).alias("last_processed_lsn"),
        F.when(pending, "PENDING")
        .when(nation < 6, "REBOOTSTRAP")
        .otherwise("COMPLETE")
        .alias("bootstrap_status"),
        F.lit(None).cast("string").alias("schema_hash"),
        F.when(
            (segment != "HOUSEHOLD") & ~((segment == "BUILDING") & (nation == 21)),
            F.concat(F.lit("ci_"), F.col("c_custkey")),
        ).alias("capture_instance"),
        F.when(
            ~pending,
            F.timestamp_add(
                "SECOND",
                F.floor(F.abs("c_acctbal") * 100).cast("int"),
                F.lit("2002-01-01").cast("timestamp_ntz"),
            ),
        ).alias("last_sync_time"),
        F.when(nation == 7, "permission denied").alias("error_message"),
        F.lit("2002-01-01").cast("timestamp_ntz").alias("updated_at"),
        F.lit(1).cast("bigint").alias("version"),
        F.lit(False).alias("deleted"),
    )


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """One run per order, one source per customer."""
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    started = F.timestamp_add(
        "SECOND", F.pmod(F.col("o_orderkey"), F.lit(86400)).cast("int"), F.col("o_orderdate")
    )
    return table(spark, sf, "orders").select(
        F.concat(F.lit("run-"), F.col("o_orderkey")).alias("batch_id"),
        F.concat(F.lit("srv-"), F.col("o_custkey")).alias("source"),
        F.when(priority == "1-URGENT", "Snapshot").otherwise("Delta").alias("batch_type"),
        F.when(priority == "2-HIGH", "Manual").otherwise("Scheduled").alias("trigger"),
        F.when(status == "O", "RUNNING")
        .when(status == "F", "SUCCEEDED")
        .when(priority == "5-LOW", "ABORTED")
        .otherwise("FAILED")
        .alias("status"),
        started.alias("started_at"),
        F.when(
            (status != "O") | (priority == "3-MEDIUM"),
            F.timestamp_add("MILLISECOND", F.floor("o_totalprice").cast("int"), started),
        ).alias("finished_at"),
    )


def datasets(spark: SparkSession, sf: str) -> DataFrame:
    """One dataset per line item, in the run of its order."""
    day, number = day_of(F.col("l_shipdate")), F.col("l_orderkey") * 16
    flag = F.concat("l_returnflag", "l_linestatus")
    status = (
        F.when(F.col("l_returnflag") == "R", "ABORTED")
        .when(F.col("l_returnflag") == "A", "COMMITTED")
        .when(flag == "NF", "SKIPPED")
        .otherwise("UPLOADING")
    )
    empty = (flag == "NF") & (F.col("l_quantity") < 50)
    return table(spark, sf, "lineitem").select(
        F.concat_ws(
            "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", day, F.floor("l_extendedprice")
        ).alias("dataset_id"),
        F.concat(F.lit("run-"), F.col("l_orderkey")).alias("batch_id"),
        F.lit("dbo").alias("table_schema"),
        F.concat(F.lit("part_"), F.col("l_partkey")).alias("table_name"),
        lsn(day, number + 1).alias("from_lsn"),
        lsn(day + 1, number).alias("to_lsn"),
        status.alias("status"),
        F.when(empty, F.lit(0)).otherwise(F.col("l_quantity")).cast("bigint").alias("row_count"),
        F.col("l_linenumber").cast("bigint").alias("chunk_count"),
        F.floor("l_extendedprice").cast("bigint").alias("bytes_sent"),
        F.when(
            (F.col("l_returnflag") == "R") & (F.col("l_discount") < 0.095), "DELTA_FAILED"
        ).alias("error_code"),
    )


def run_events(spark: SparkSession, sf: str) -> DataFrame:
    """Error events of the aborted datasets."""
    tax = F.col("l_tax")
    return (
        table(spark, sf, "lineitem")
        .where(F.col("l_returnflag") == "R")
        .select(
            F.concat(F.lit("run-"), F.col("l_orderkey")).alias("batch_id"),
            F.when(tax > 0.075, "LEASE_CONFLICT")
            .when(tax > 0.065, "DOWNSTREAM_UNAVAILABLE")
            .otherwise("DELTA_FAILED")
            .alias("code"),
        )
    )


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """One chunk per line item, one dataset per order."""
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("set-"), F.col("l_orderkey")).alias("dataset_id"),
        F.col("l_linenumber").alias("chunk_no"),
        F.col("l_quantity").cast("bigint").alias("row_count"),
        F.floor("l_extendedprice").cast("bigint").alias("compressed_size"),
    )


def logs(source: DataFrame) -> DataFrame:
    """The event table as a log; works on a stream as well."""
    kind = F.col("event_type")
    return source.select(
        "event_id",
        F.col("ts").alias("timestamp"),
        F.when(kind == "error", "Error")
        .when(kind == "purchase", "Warning")
        .when(kind == "signup", "Debug")
        .otherwise("Information")
        .alias("level"),
        F.concat(
            F.initcap(kind), F.lit(" by user "), F.col("user_id"), F.lit(", properties "), F.col("props")
        ).alias("message"),
        F.concat(
            F.lit('{"BatchId": "'),
            F.col("user_id"),
            F.lit('", "Table": "dbo.'),
            kind,
            F.lit('", '),
            F.substring("props", 2, 1_000_000),
        ).alias("properties_json"),
    )
