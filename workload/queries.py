"""One query per operator. Each reads whole tables and is lazy where the operator is."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions import (
    csv_rows as csv_lines,
    local_time,
    lsn_format,
    lsn_increment,
    lsn_parse,
    row_size,
    value_text,
)
from driftline.operators import chunks as chunk_ops
from driftline.operators import keyed, ledger, logs, reports
from driftline.plans import flows, routing
from driftline.session import new_folder, stage
from driftline.sources import catalog, changes, tables
from driftline.streaming import dedup_stream
from driftline.streaming import log_stream as filter_log_stream
from driftline.streaming import stream_delta as start_stream_delta
from workload import feeds

NOW = datetime(2002, 6, 1)
START = datetime(2002, 1, 1)
KEYS = {"dbo.orders": ["o_orderkey"], "dbo.customer": ["c_custkey"]}
TABLES = ("orders", "customer", "nation", "region", "lineitem")

# Two positions in the order changes: days 3000 (March 1998) and 4000 (December 2000).
LOW_LSN = "0x00000BB8000000000000"
HIGH_LSN = "0x00000FA0000000000000"
SMALL_CHUNK = 65_536
FILE_LIMIT = 1_048_576


def _columns(spark: SparkSession, sf: str, name: str) -> list[str]:
    return feeds.table(spark, sf, name).columns


def _now(value: datetime = NOW):
    return local_time(value)


def _bounds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(feeds.ORDERS, LOW_LSN, HIGH_LSN), (feeds.CUSTOMER, "0x000007D5000000000000", HIGH_LSN)],
        "capture_instance string, last_lsn string, to_lsn string",
    )


def minimum_slice(spark: SparkSession, sf: str) -> DataFrame:
    """Range, label, order, size, chunks and their statistics in one plan."""
    ct = changes.label_changes(changes.lsn_range(feeds.orders_ct(spark, sf), _bounds(spark)))
    sized = ct.withColumn("row_size", row_size(ct, _columns(spark, sf, "orders"), service=True))
    narrow = sized.select("_lsn", "_seqval", "_op_code", "row_size")
    assigned = chunk_ops.chunk_assign_offset(
        narrow, changes.DELIVERY_ORDER, "row_size", SMALL_CHUNK
    )
    return chunk_ops.chunk_stats(assigned)


# Scans


def snapshot_scan(spark, sf):
    return tables.snapshot_scan(spark, f"{sf}/lineitem.parquet")


def snapshot_window_scan(spark, sf):
    return tables.snapshot_window_scan(
        feeds.table(spark, sf, "orders"), "O_OrderDate", "1997-01-01", "1998-07-01"
    )


def change_scan(spark, sf):
    return changes.change_scan(feeds.orders_ct(spark, sf), LOW_LSN, HIGH_LSN)


def lsn_range(spark, sf):
    return changes.lsn_range(feeds.feed(spark, sf), _bounds(spark))


def lsn_range_many(spark, sf):
    """Repeated and overlapping ranges, in other spellings, of every instance of many."""
    ct = feeds.tenant_ct(spark, sf)
    ranges = spark.createDataFrame(
        [(LOW_LSN, HIGH_LSN), (LOW_LSN, HIGH_LSN), (LOW_LSN[2:].lower(), "0x00000ce4000000000000")],
        "last_lsn string, to_lsn string",
    )
    return changes.lsn_range(ct, ct.select("capture_instance").distinct().crossJoin(F.broadcast(ranges)))


def lsn_high(spark, sf):
    return changes.lsn_high(feeds.feed(spark, sf))


def lsn_low(spark, sf):
    return changes.lsn_low(feeds.tenant_ct(spark, sf))


def change_project(spark, sf):
    return changes.change_project(feeds.orders_ct(spark, sf))


def change_order(spark, sf):
    """Delivery order made visible: each change with the number of changes before it."""
    ct = feeds.orders_ct(spark, sf).select("_lsn", "_seqval", "_op_code").withColumn(
        "one", F.lit(1).cast("bigint")
    )
    return chunk_ops.running_total(ct, changes.DELIVERY_ORDER, "one").select(
        "_lsn", "_seqval", "_op_code", F.col("size_before").alias("position")
    )


def change_sort(spark, sf):
    return changes.change_order(feeds.orders_ct(spark, sf))


def commit_time(spark, sf):
    """Commit times come from the orders; changes long after have no entry."""
    ct = feeds.orders_ct(spark, sf).drop("_ts")
    times = feeds.table(spark, sf, "orders").select(
        feeds.lsn(feeds.day_of(F.col("o_orderdate")), F.col("o_orderkey") * 16 + 1).alias("_lsn"),
        F.timestamp_add("HOUR", F.lit(9), F.col("o_orderdate")).alias("commit_ts"),
    )
    return changes.commit_time(ct, times, _now()).select("_lsn", "_seqval", "_op_code", "_ts")


def event_dedup(spark, sf):
    """A range delivered twice, the second time read an hour later."""
    ct = feeds.feed(spark, sf)
    again = changes.change_scan(ct, LOW_LSN, HIGH_LSN).withColumn(
        "_ts", F.timestamp_add("HOUR", F.lit(1), F.col("_ts"))
    )
    return changes.event_dedup(ct.unionByName(again))


def event_dedup_hard(spark, sf):
    """Copies without a time and copies with equal times."""
    ct = feeds.feed(spark, sf)
    late = ct.withColumn("_ts", F.when(F.col("_lsn") <= HIGH_LSN, F.col("_ts")))
    timeless = ct.withColumn("_ts", F.lit(None).cast("timestamp_ntz"))
    return changes.event_dedup(late.unionByName(late).unionByName(timeless))


def op_counts(spark, sf):
    return changes.op_counts(feeds.tenant_ct(spark, sf))


def retention_purge(spark, sf):
    """What is left per capture instance, and its new floor."""
    kept, floor = changes.retention_purge(
        feeds.tenant_ct(spark, sf), 1440, 7 * 365, _now(datetime(2002, 1, 1))
    )
    left = kept.groupBy("capture_instance").agg(F.count(F.lit(1)).alias("kept"))
    return floor.join(left, "capture_instance", "left").select(
        "capture_instance", "floor_lsn", F.coalesce("kept", F.lit(0)).cast("bigint").alias("kept")
    )


# Expressions


def lsn_expr(spark, sf):
    """Text to bytes and back, next position and comparison."""
    ct = feeds.feed(spark, sf)
    bare = F.lower(F.substring("_lsn", 3, 20))
    return ct.select(
        "_lsn",
        lsn_format(lsn_parse(bare)).alias("parsed"),
        lsn_format(lsn_parse(F.substring("_lsn", 1, 11))).alias("too_short"),
        lsn_increment(F.col("_lsn")).alias("next_lsn"),
        (lsn_increment(F.col("_lsn")) > F.col("_seqval")).alias("next_after_seqval"),
        lsn_increment(
            F.concat(F.substring("_lsn", 1, 12), F.lit("FFFFFFFFFF"))
        ).alias("carried"),
    )


def op_label(spark, sf):
    return changes.label_changes(feeds.feed(spark, sf)).select("_lsn", "_op_code", "_op")


def op_label_simple(spark, sf):
    return changes.label_changes(feeds.feed(spark, sf), simple=True).select(
        "_lsn", "_op_code", "_op"
    )


def value_text_query(spark, sf):
    df = feeds.table(spark, sf, "lineitem")
    return df.select(*(value_text(f).alias(f.name) for f in df.schema.fields))


def csv_rows(spark, sf):
    df = feeds.table(spark, sf, "documents")
    return csv_lines(df, ["doc_id", "TEXT", "lang", "missing", "source", "n_chars"])


def csv_rows_delta(spark, sf):
    ct = changes.label_changes(feeds.orders_ct(spark, sf))
    return csv_lines(ct, _columns(spark, sf, "orders"), service=True)


def row_size_query(spark, sf):
    df = feeds.table(spark, sf, "lineitem")
    return df.select("l_orderkey", "l_linenumber", row_size(df, df.columns).alias("row_size"))


def row_size_delta(spark, sf):
    ct = changes.label_changes(feeds.orders_ct(spark, sf))
    size = row_size(ct, _columns(spark, sf, "orders"), service=True)
    return ct.select("_lsn", "_op", size.alias("row_size"))


# Chunks


def _sized_orders(spark, sf):
    df = feeds.table(spark, sf, "orders")
    return df.select("o_orderkey", row_size(df, df.columns).alias("row_size"))


def chunk_assign_offset(spark, sf):
    return chunk_ops.chunk_assign_offset(
        _sized_orders(spark, sf), ["o_orderkey"], "row_size", SMALL_CHUNK
    )


def chunk_assign_greedy(spark, sf):
    return chunk_ops.chunk_assign_greedy(
        _sized_orders(spark, sf),
        ["o_orderkey"],
        "row_size",
        SMALL_CHUNK,
        split=F.floor(F.col("o_orderkey") / 2048),
    )


def chunk_assign_whole(spark, sf):
    """All line items as one split, in an order that tells them apart."""
    df = feeds.table(spark, sf, "lineitem")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    sized = df.select(*keys, "l_shipdate", row_size(df, df.columns).alias("row_size"))
    return chunk_ops.chunk_assign_greedy(sized, keys, "row_size", SMALL_CHUNK)


def _written(files: DataFrame, max_bytes: int, row_limit: int) -> DataFrame:
    """What holds for a set of chunk files however the rows were spread."""
    return files.agg(
        F.sum("row_count").cast("bigint").alias("rows"),
        F.sum("estimated_size").cast("bigint").alias("size"),
        (F.min("chunk_no") == 1).alias("from_one"),
        (F.max("chunk_no") == F.count(F.lit(1))).alias("no_holes"),
        (F.max("estimated_size") < max_bytes + row_limit).alias("within_limit"),
        F.sum("oversize_rows").cast("bigint").alias("oversize_rows"),
    )


def snapshot_chunk_write(spark, sf):
    df = feeds.table(spark, sf, "lineitem")
    files = chunk_ops.write_chunks(df, new_folder(spark, "out"), df.columns, FILE_LIMIT)
    return _written(files, FILE_LIMIT, 256)


def delta_chunk_write(spark, sf):
    ct = changes.label_changes(feeds.orders_ct(spark, sf))
    files = chunk_ops.write_chunks(
        ct,
        new_folder(spark, "out"),
        _columns(spark, sf, "orders"),
        FILE_LIMIT,
        service=True,
        order_by=changes.DELIVERY_ORDER,
    )
    return _written(files, FILE_LIMIT, 256)


# Catalog


def key_check(spark, sf):
    good = catalog.key_check(feeds.table(spark, sf, "orders"), ["o_orderkey"])
    bad = catalog.key_check(feeds.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])
    return good.withColumn("table_name", F.lit("orders")).unionByName(
        bad.withColumn("table_name", F.lit("lineitem"))
    )


def _profile(spark, sf):
    known = {f"dbo.{name}": feeds.table(spark, sf, name) for name in TABLES}
    keys = {**KEYS, "dbo.lineitem": ["l_orderkey", "l_linenumber"]}
    return catalog.table_profile(known, keys, ["dbo.orders"])


def table_profile(spark, sf):
    return _profile(spark, sf)


def extraction_mode(spark, sf):
    return catalog.extraction_mode(_profile(spark, sf))


def _manifests(spark, sf):
    orders = catalog.schema_manifest(
        "dbo.orders",
        feeds.table(spark, sf, "orders"),
        ["o_orderkey"],
        [["o_custkey"], ["o_custkey", "o_orderkey"]],
    )
    lines = catalog.schema_manifest(
        "dbo.lineitem", feeds.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]
    )
    return orders.unionByName(lines)


def schema_manifest(spark, sf):
    return _manifests(spark, sf).select(
        "table_name",
        F.concat_ws(",", "primary_key").alias("primary_key"),
        F.to_json("unique_keys").alias("unique_keys"),
        "watermark_column",
        F.size("columns").cast("bigint").alias("column_count"),
        "manifest_json",
    )


def schema_hash(spark, sf):
    return _manifests(spark, sf).select("table_name", "schema_hash")


def schema_changed(spark, sf):
    """Against hashes on record: an older one, the same in capitals, and none."""
    current = _manifests(spark, sf)
    wide = catalog.schema_manifest("dbo.customer", feeds.table(spark, sf, "customer"), ["c_custkey"])
    known = current.select(
        F.upper("table_name").alias("table_name"),
        F.when(F.col("table_name") == "dbo.orders", F.upper("schema_hash"))
        .otherwise(F.sha2(F.lit("earlier"), 256))
        .alias("schema_hash"),
    )
    return catalog.schema_changed(current.unionByName(wide), known).select("table_name", "changed")


# Keyed tables


def latest_per_key(spark, sf):
    """Newest change of each order."""
    return keyed.latest_per_key(
        feeds.orders_ct(spark, sf).drop("capture_instance", "_ts"),
        ["o_orderkey"],
        ["_lsn", "_seqval", "_op_code"],
    )


def latest_per_key_hard(spark, sf):
    """Newest order change of each customer by a version that is often equal or missing."""
    ct = feeds.orders_ct(spark, sf)
    week = F.nullif(feeds.day_of(F.col("o_orderdate")) % 7, F.lit(0))
    return keyed.latest_per_key(
        ct.select("o_custkey", week.alias("version"), "o_orderkey", "_op_code"), ["o_custkey"], "version"
    )


def keyed_merge_hard(spark, sf):
    """Changes of which some have no version and say nothing, and each comes twice."""
    ct = feeds.orders_ct(spark, sf).where(F.col("_op_code").isin(1, 4))
    later = ct.withColumn("deleted", F.col("_op_code") == 1).withColumn(
        "_lsn", F.when(F.col("o_orderkey") % 3 != 0, F.col("_lsn"))
    )
    return keyed.keyed_merge(feeds.table(spark, sf, "orders"), later.unionByName(later), ["o_orderkey"], "_lsn")


def keyed_merge(spark, sf):
    """Orders as first inserted, brought up to date with all later changes."""
    ct = feeds.orders_ct(spark, sf)
    later = ct.where(F.col("_op_code").isin(1, 4)).withColumn("deleted", F.col("_op_code") == 1)
    return keyed.keyed_merge(feeds.table(spark, sf, "orders"), later, ["o_orderkey"], "_lsn")


def commit_once(spark, sf):
    """Ranges asked for (many times over) that no committed dataset covers."""
    datasets = feeds.datasets(spark, sf)
    wanted = datasets.select("table_name", "from_lsn", "to_lsn")
    done = datasets.where(F.col("status") == "COMMITTED")
    return ledger.commit_once(wanted.unionByName(wanted), done)


# Plans


def _plan(spark, sf, kind: str = "DELTA"):
    ct = feeds.tenant_ct(spark, sf)
    high = changes.lsn_high(ct).first()[0]
    return feeds.states(spark, sf), high, changes.lsn_low(ct), kind


PLAN_COLUMNS = ("table_name", "low_lsn", "from_lsn", "to_lsn", "action", "reason")


def plan_join(spark, sf):
    return routing.plan_tables(*_plan(spark, sf)).select(*PLAN_COLUMNS)


def route_tables(spark, sf):
    plan = routing.plan_tables(*_plan(spark, sf))
    return plan.groupBy("extraction_mode", "bootstrap_status", "action", "reason").agg(
        F.count(F.lit(1)).alias("tables")
    )


def no_change_skip(spark, sf):
    state, high, _, _ = _plan(spark, sf)
    return routing.no_change_skip(state, high).select("table_name", "from_lsn", "to_lsn")


def gap_detect(spark, sf):
    state, high, lows, _ = _plan(spark, sf)
    return routing.gap_detect(state, high, lows).select("table_name", "from_lsn", "low_lsn")


def _outcomes(spark, sf):
    """What happened to each customer's table: decided by its newest order."""
    newest = feeds.table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.max_by(
            F.struct("o_orderkey", "o_orderdate", "o_orderpriority"),
            F.struct("o_orderdate", "o_orderkey"),
        ).alias("o")
    )
    priority = F.col("o.o_orderpriority")
    return newest.select(
        F.lit("dbo").alias("table_schema"),
        F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias(
            "table_name"
        ),
        F.when(priority == "1-URGENT", "SNAPSHOT")
        .when(priority == "2-HIGH", "GAP")
        .when(priority == "3-MEDIUM", "ERROR")
        .otherwise("DELTA")
        .alias("outcome"),
        feeds.lsn(feeds.day_of(F.col("o.o_orderdate")), F.col("o.o_orderkey")).alias("outcome_lsn"),
        F.sha2(F.col("o.o_orderkey").cast("string"), 256).alias("outcome_hash"),
        F.concat(F.lit("order "), F.col("o.o_orderkey")).alias("outcome_message"),
    )


def state_transition(spark, sf):
    accepted, rejected = routing.state_transition(
        feeds.states(spark, sf), _outcomes(spark, sf), _now()
    )
    columns = [
        "table_name",
        "bootstrap_status",
        "last_processed_lsn",
        "schema_hash",
        "last_sync_time",
        "error_message",
        "version",
    ]
    refused = rejected.select("table_name", "bootstrap_status").withColumn("legal", F.lit(False))
    return accepted.select(*columns).withColumn("legal", F.lit(True)).unionByName(
        refused, allowMissingColumns=True
    )


# Reports


def run_summary(spark, sf):
    return reports.run_summary(feeds.runs(spark, sf), feeds.datasets(spark, sf))


def newest_run(spark, sf):
    return reports.newest_run_duration(feeds.runs(spark, sf))


def run_details(spark, sf):
    details = feeds.datasets(spark, sf).drop("table_schema", "chunk_count", "bytes_sent")
    return reports.run_details(feeds.runs(spark, sf).drop("trigger", "source"), details)


def run_details_nested(spark, sf):
    """The pages of each run, small ones so that runs have several, flattened to text."""
    columns = ["dataset_id", "status", "row_count"]
    nested = reports.run_details_nested(
        feeds.runs(spark, sf), feeds.datasets(spark, sf), columns, page_rows=2
    )
    return nested.select(
        "batch_id",
        "page",
        "pages",
        F.size("datasets").cast("bigint").alias("datasets"),
        F.array_join(F.transform("datasets", lambda d: d["dataset_id"]), "|").alias("ids"),
    )


def dataset_totals(spark, sf):
    return reports.dataset_totals(feeds.chunks(spark, sf))


def recent_runs(spark, sf):
    return reports.recent_runs(feeds.runs(spark, sf), reports.RUN_LIST)


def run_status(spark, sf):
    return reports.run_status(
        feeds.runs(spark, sf), feeds.datasets(spark, sf), feeds.run_events(spark, sf)
    )


def lag_report(spark, sf):
    return reports.lag_report(feeds.states(spark, sf), _now(), feeds.tenant_ct(spark, sf))


def superseded_runs(spark, sf):
    return reports.superseded_runs(feeds.runs(spark, sf))


def inactive_runs(spark, sf):
    return reports.inactive_runs(
        feeds.table(spark, sf, "events"), "user_id", "ts", _now(datetime(2024, 1, 31)), 24 * 60
    )


def ledger_check(spark, sf):
    return ledger.ledger_check(feeds.runs(spark, sf), feeds.datasets(spark, sf))


def step_check(spark, sf):
    """Two ledger versions per dataset: as opened, and as found."""
    found = feeds.datasets(spark, sf).select("dataset_id", "status")
    opened = found.select(
        "dataset_id",
        F.when(F.substring("dataset_id", 1, 1) == "1", "UPLOADING").otherwise("CREATED").alias("status"),
        F.lit(1).alias("version"),
    )
    return ledger.step_check(opened.unionByName(found.withColumn("version", F.lit(2))))


# Logs


def _logs(spark, sf):
    return feeds.logs(feeds.table(spark, sf, "events"))


def log_fields(spark, sf):
    fields = logs.log_fields(_logs(spark, sf), "properties_json")
    return fields.withColumn("properties", F.to_json("properties"))


def log_fields_hard(spark, sf):
    """Properties that are no JSON, or missing."""
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("{broken "), F.col("properties_json"))).when(
        F.col("event_id") % 3 == 1, F.col("properties_json")
    )
    broken = _logs(spark, sf).withColumn("properties_json", text)
    return logs.log_fields(broken, "properties_json").select("event_id", "batch_id", "table", "unparsed")


def log_lines_hard(spark, sf):
    """Entries without level or message."""
    some = _logs(spark, sf)
    level = F.when(F.col("event_id") % 2 == 0, F.col("level"))
    message = F.when(F.col("event_id") % 3 == 0, F.col("message"))
    return logs.log_lines(some.withColumn("level", level).withColumn("message", message))


def log_query(spark, sf):
    return logs.log_query(_logs(spark, sf).drop("properties_json"), "warn", "  USER 1 ", 500)


def log_lines(spark, sf):
    return logs.log_lines(_logs(spark, sf))


def log_stream(spark, sf):
    """The event file as a stream, filtered into a Parquet sink."""
    schema = feeds.table(spark, sf, "events").schema
    arriving = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    out = new_folder(spark, "logstream")
    query = (
        filter_log_stream(feeds.logs(arriving), "Warning")
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", new_folder(spark, "streams"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(out)


# Flows


def _changes(spark, sf) -> dict[str, DataFrame]:
    """The change tables, written once as a source keeps them: flows read them many times."""
    cts = {
        "dbo.orders": feeds.orders_ct(spark, sf),
        "dbo.customer": feeds.customer_ct(spark, sf),
        "dbo.lineitem": feeds.lineitem_ct(spark, sf),
    }
    return {name: stage(ct, "changes") for name, ct in cts.items()}


def _source(spark, sf, until: str | None = None, since: str | None = None, floor=None, stored=None):
    """All tables with the order, customer and line changes of a range of positions."""
    cts = stored or {
        "dbo.orders": feeds.orders_ct(spark, sf),
        "dbo.customer": feeds.customer_ct(spark, sf),
        "dbo.lineitem": feeds.lineitem_ct(spark, sf),
    }
    if until:
        cts = {name: ct.where(F.col("_lsn") <= until) for name, ct in cts.items()}
    if since:
        cts = {name: ct.where(F.col("_lsn") >= since) for name, ct in cts.items()}
    return flows.Source(
        "server/sales",
        {f"dbo.{name}": feeds.table(spark, sf, name) for name in TABLES},
        cts,
        KEYS,
        floor,
    )


def _root(spark) -> str:
    return new_folder(spark, "flows")


def _open(spark, root, kind="DELTA"):
    return flows.start_run(spark, "server/sales", root, kind, "MANUAL", NOW)


def _plan_row(table: str, **values) -> dict:
    return {"table_schema": "dbo", "table_name": table, **values}


def snapshot_dataset(spark, sf):
    source, root = _source(spark, sf), _root(spark)
    plan = _plan_row("lineitem", to_lsn=source.high())
    flows.snapshot_dataset(spark, source, plan, _open(spark, root, "SNAPSHOT"), root)
    schema = source.tables["dbo.lineitem"].schema
    return ledger.read_committed(spark, root, "dbo.lineitem", schema).drop("_chunk_file")


def delta_dataset(spark, sf):
    source, root = _source(spark, sf), _root(spark)
    plan = _plan_row(
        "orders", from_lsn=LOW_LSN, to_lsn=HIGH_LSN, capture_instance=feeds.ORDERS
    )
    flows.delta_dataset(spark, source, plan, _open(spark, root), root)
    schema = source.tables["dbo.orders"].schema
    return ledger.read_committed(spark, root, "dbo.orders", schema, service=True).drop("_chunk_file")


def dataset_publish(spark, sf):
    """The same range committed twice counts once; another run may not commit any more."""
    source, root = _source(spark, sf), _root(spark)
    older = _open(spark, root)
    newer = _open(spark, root)
    plan = _plan_row(
        "orders", from_lsn=LOW_LSN, to_lsn=HIGH_LSN, capture_instance=feeds.ORDERS
    )
    flows.delta_dataset(spark, source, plan, newer, root)
    flows.delta_dataset(spark, source, plan, newer, root)
    try:
        flows.delta_dataset(
            spark, source, {**plan, "to_lsn": "0x00000FFF000000000000"}, older, root
        )
    except ledger.LeaseConflict:
        pass
    return ledger.current_datasets(spark, root).select(
        "table_name", "from_lsn", "to_lsn", "status", "row_count"
    )


def committed_dataset_read(spark, sf):
    """One committed and one unfinished dataset: only the first is read."""
    source, root = _source(spark, sf), _root(spark)
    run = _open(spark, root, "SNAPSHOT")
    flows.snapshot_dataset(spark, source, _plan_row("customer", to_lsn=HIGH_LSN), run, root)
    df = source.tables["dbo.customer"]
    open_set = flows.new_dataset(run, _plan_row("customer"), None, None, "unfinished")
    files = chunk_ops.write_chunks(df, flows.data_folder(root, open_set), df.columns)
    ledger.append(
        files.withColumn("dataset_id", F.lit("unfinished")).withColumn(
            "attempt", F.lit(open_set["attempt"])
        ),
        root,
        "chunk_manifest",
    )
    ledger.append_rows(spark, root, "dataset_history", [open_set])
    return ledger.read_committed(spark, root, "dbo.customer", df.schema).drop("_chunk_file")


def _dataset_rows(spark, root):
    runs = ledger.current_runs(spark, root).select(
        "batch_id", "epoch", "batch_type", F.col("status").alias("run_status")
    )
    return ledger.current_datasets(spark, root).join(runs, "batch_id").select(
        "epoch", "batch_type", "run_status", "table_name", "status", "row_count", "error_code"
    )


def _run(spark, source, root, kind):
    return flows.run(spark, source, root, kind, "MANUAL", lambda: NOW, parallel_tables=4)


def snapshot_tables(spark, sf):
    source, root = _source(spark, sf), _root(spark)
    flows.register_tables(spark, source, root, START)
    _run(spark, source, root, "SNAPSHOT")
    return _dataset_rows(spark, root)


def delta_tables(spark, sf):
    """First load at a position, then two delta runs: changes, and nothing new."""
    root, stored = _root(spark), _changes(spark, sf)
    early = _source(spark, sf, until=HIGH_LSN, stored=stored)
    flows.register_tables(spark, early, root, START)
    _run(spark, early, root, "SNAPSHOT")
    late = _source(spark, sf, stored=stored)
    _run(spark, late, root, "DELTA")
    _run(spark, late, root, "DELTA")
    return _dataset_rows(spark, root)


def rebootstrap(spark, sf):
    """Load, lose history, notice the gap, load again, go on with changes.

    The customer changes are all old, so nothing of them is left: without a
    floor it is not known whether any were missed, which is an error.
    """
    root, stored = _root(spark), _changes(spark, sf)
    steps = [
        (_source(spark, sf, until=LOW_LSN, stored=stored), "SNAPSHOT"),
        (_source(spark, sf, since=HIGH_LSN, stored=stored), "DELTA"),
        (_source(spark, sf, since=HIGH_LSN, stored=stored), "DELTA"),
        (_source(spark, sf, since=HIGH_LSN, stored=stored), "DELTA"),
    ]
    for source, kind in steps:
        if kind == "SNAPSHOT":
            flows.register_tables(spark, source, root, START)
        _run(spark, source, root, kind)
    return _dataset_rows(spark, root)


def delta_resume(spark, sf):
    """A run that dies between publication and the move of the state; the next one goes on after it."""
    root, stored = _root(spark), _changes(spark, sf)
    early = _source(spark, sf, until=HIGH_LSN, stored=stored)
    flows.register_tables(spark, early, root, START)
    _run(spark, _source(spark, sf, until=LOW_LSN, stored=stored), root, "SNAPSHOT")
    states = ledger.rows_frame(
        spark, [r.asDict() for r in ledger.current_states(spark, root).collect()], ledger.LEDGERS["table_state"]
    )
    _run(spark, early, root, "DELTA")
    # The states as they were before the second run, as newest version.
    ledger.append(states.withColumn("version", F.lit(99).cast("bigint")), root, "table_state")
    _run(spark, _source(spark, sf, stored=stored), root, "DELTA")
    sets = ledger.current_datasets(spark, root).where("status = 'COMMITTED' AND from_lsn IS NOT NULL")
    return sets.groupBy("table_name").agg(F.sum("row_count").alias("published"))


def delta_named_instance(spark, sf):
    """Changes of a capture instance whose name follows no convention."""
    root = _root(spark)

    def source(until=None):
        found = _source(spark, sf, until)
        named = found.changes["dbo.orders"].withColumn("capture_instance", F.lit("orders_v2"))
        return flows.Source("server/sales", {"DBO.Orders": found.tables["dbo.orders"]}, {"dbo.orders": named}, KEYS)

    flows.register_tables(spark, source(), root, START)
    _run(spark, source(LOW_LSN), root, "SNAPSHOT")
    _run(spark, source(HIGH_LSN), root, "DELTA")
    deltas = ledger.current_datasets(spark, root).where("status = 'COMMITTED' AND from_lsn IS NOT NULL")
    schema = feeds.table(spark, sf, "orders").schema
    ids = [row.dataset_id for row in deltas.collect()]
    return ledger.read_committed(spark, root, "dbo.orders", schema, service=True, dataset_ids=ids).drop("_chunk_file")


def committed_mixed_read(spark, sf):
    """A snapshot and a delta of one table, read together."""
    root = _root(spark)
    flows.snapshot_dataset(
        spark, _source(spark, sf), _plan_row("orders", to_lsn=LOW_LSN), _open(spark, root, "SNAPSHOT"), root
    )
    plan = _plan_row("orders", from_lsn=LOW_LSN, to_lsn=HIGH_LSN, capture_instance=feeds.ORDERS)
    flows.delta_dataset(spark, _source(spark, sf), plan, _open(spark, root), root)
    schema = feeds.table(spark, sf, "orders").schema
    return ledger.read_committed(spark, root, "DBO.ORDERS", schema, service=True).drop("_chunk_file")


def window_snapshot(spark, sf):
    """A first load bounded by a watermark."""
    source, root = _source(spark, sf), _root(spark)
    source.windows = {"dbo.Orders": ("O_OrderDate", datetime(1997, 1, 1), datetime(1998, 7, 1))}
    flows.snapshot_dataset(
        spark, source, _plan_row("orders", to_lsn=LOW_LSN), _open(spark, root, "SNAPSHOT"), root
    )
    schema = source.tables["dbo.orders"].schema
    return ledger.read_committed(spark, root, "dbo.orders", schema).drop("_chunk_file")


def purge_flow(spark, sf):
    """Changes beyond the retention go and leave a floor: what is kept, by instance."""
    source, root = _source(spark, sf), _root(spark)
    kept = flows.purge(spark, source, root, 1440, 7 * 365, datetime(2002, 1, 1))
    floors = ledger.recorded_floors(spark, root)
    counts = [ct.groupBy("capture_instance").agg(F.count(F.lit(1)).alias("kept")) for ct in kept.changes.values()]
    left = counts[0].unionByName(counts[1]).unionByName(counts[2])
    return floors.join(left, "capture_instance", "left").select(
        "capture_instance", "floor_lsn", F.coalesce("kept", F.lit(0)).cast("bigint").alias("kept")
    )


def stream_delta(spark, sf):
    """The order changes as files, taken in by two runs of the stream; the second finds none."""
    root, checkpoint = _root(spark), new_folder(spark, "streams")
    ct = feeds.orders_ct(spark, sf)
    files = new_folder(spark, "changes")
    ct.write.parquet(files)
    for _ in range(2):
        start_stream_delta(
            spark,
            files,
            ct.schema,
            root,
            "dbo.orders",
            _columns(spark, sf, "orders"),
            checkpoint,
            NOW,
        ).awaitTermination()
    schema = feeds.table(spark, sf, "orders").schema
    return ledger.read_committed(spark, root, "dbo.orders", schema, service=True).drop("_chunk_file")


def stream_then_delta(spark, sf):
    """Stream, delta run, and the stream again over files that repeat all that was published."""
    root, checkpoint, files = _root(spark), new_folder(spark, "streams"), new_folder(spark, "changes")
    ct = stage(feeds.orders_ct(spark, sf), "changes")

    def stream():
        start_stream_delta(
            spark, files, ct.schema, root, "dbo.orders", _columns(spark, sf, "orders"), checkpoint, NOW,
            source="server/sales",
        ).awaitTermination()

    ct.where(F.col("_lsn") <= LOW_LSN).write.parquet(files)
    stream()
    orders = feeds.table(spark, sf, "orders")
    until = ct.where(F.col("_lsn") <= HIGH_LSN)
    _run(spark, flows.Source("server/sales", {"dbo.orders": orders}, {"dbo.orders": until}, KEYS), root, "DELTA")
    ct.write.mode("append").parquet(files)
    stream()
    return ledger.read_committed(spark, root, "dbo.orders", orders.schema, service=True).drop("_chunk_file")


def event_dedup_stream(spark, sf):
    """The order changes as files that each come twice, every event once."""
    files, out = new_folder(spark, "changes"), new_folder(spark, "events")
    ct = feeds.orders_ct(spark, sf)
    for _ in range(2):
        ct.write.mode("append").parquet(files)
    arriving = spark.readStream.schema(ct.schema).option("maxFilesPerTrigger", 3).parquet(files)
    dedup_stream(arriving).writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", new_folder(spark, "streams")
    ).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


QUERIES = {
    "snapshot_scan": snapshot_scan,
    "snapshot_window_scan": snapshot_window_scan,
    "change_scan": change_scan,
    "lsn_range": lsn_range,
    "lsn_range_many": lsn_range_many,
    "event_dedup_hard": event_dedup_hard,
    "latest_per_key_hard": latest_per_key_hard,
    "keyed_merge_hard": keyed_merge_hard,
    "log_fields_hard": log_fields_hard,
    "log_lines_hard": log_lines_hard,
    "delta_resume": delta_resume,
    "delta_named_instance": delta_named_instance,
    "committed_mixed_read": committed_mixed_read,
    "window_snapshot": window_snapshot,
    "purge_flow": purge_flow,
    "lsn_high": lsn_high,
    "lsn_low": lsn_low,
    "change_project": change_project,
    "change_order": change_order,
    "change_sort": change_sort,
    "commit_time": commit_time,
    "event_dedup": event_dedup,
    "op_counts": op_counts,
    "retention_purge": retention_purge,
    "lsn_expr": lsn_expr,
    "op_label": op_label,
    "op_label_simple": op_label_simple,
    "value_text": value_text_query,
    "csv_rows": csv_rows,
    "csv_rows_delta": csv_rows_delta,
    "row_size": row_size_query,
    "row_size_delta": row_size_delta,
    "chunk_assign_offset": chunk_assign_offset,
    "chunk_assign_greedy": chunk_assign_greedy,
    "chunk_assign_whole": chunk_assign_whole,
    "chunk_stats": minimum_slice,
    "snapshot_chunk_write": snapshot_chunk_write,
    "delta_chunk_write": delta_chunk_write,
    "key_check": key_check,
    "table_profile": table_profile,
    "extraction_mode": extraction_mode,
    "schema_manifest": schema_manifest,
    "schema_hash": schema_hash,
    "schema_changed": schema_changed,
    "latest_per_key": latest_per_key,
    "keyed_merge": keyed_merge,
    "commit_once": commit_once,
    "plan_join": plan_join,
    "route_tables": route_tables,
    "no_change_skip": no_change_skip,
    "gap_detect": gap_detect,
    "state_transition": state_transition,
    "run_summary": run_summary,
    "newest_run": newest_run,
    "run_details": run_details,
    "run_details_nested": run_details_nested,
    "dataset_totals": dataset_totals,
    "recent_runs": recent_runs,
    "run_status": run_status,
    "lag_report": lag_report,
    "superseded_runs": superseded_runs,
    "inactive_runs": inactive_runs,
    "ledger_check": ledger_check,
    "step_check": step_check,
    "log_fields": log_fields,
    "log_query": log_query,
    "log_lines": log_lines,
    "log_stream": log_stream,
    "snapshot_dataset": snapshot_dataset,
    "delta_dataset": delta_dataset,
    "dataset_publish": dataset_publish,
    "committed_dataset_read": committed_dataset_read,
    "snapshot_tables": snapshot_tables,
    "delta_tables": delta_tables,
    "rebootstrap": rebootstrap,
    "stream_delta": stream_delta,
    "stream_then_delta": stream_then_delta,
    "event_dedup_stream": event_dedup_stream,
}
