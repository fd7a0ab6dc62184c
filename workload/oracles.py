"""The queries as SQL, written independently of the Spark code."""

from __future__ import annotations

from workload.sqlfeeds import (
    DATASETS,
    ALL_FEED,
    FEED,
    LINEITEM_CT,
    LOGS,
    ORDERS_CT,
    RUN_EVENTS,
    RUNS,
    STATES,
    TENANT_CT,
    day_of,
    lsn,
    next_lsn,
    number_text,
    time_text,
)

LOW = "'0x00000BB8000000000000'"
HIGH = "'0x00000FA0000000000000'"
ZERO = "'0x00000000000000000000'"
CHUNK = 65536
FILE_LIMIT = 1048576

_OP = """CASE _op_code WHEN 1 THEN 'D' WHEN 2 THEN 'I' WHEN 3 THEN 'UO' WHEN 4 THEN 'UN'
  ELSE _op_code::VARCHAR END"""
_ORDER_COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"

# Estimated sizes: text lengths, one per separator, two for the line end.
_ORDERS_SIZE = f"""(length(o_orderkey::VARCHAR) + length(o_custkey::VARCHAR) + length(o_orderstatus)
  + length({number_text('o_totalprice')}) + 27 + length(o_orderpriority) + 6 + 2)"""
_DELTA_SIZE = f"({_ORDERS_SIZE} + length({_OP}) + length(_lsn) + length(_seqval) + 30)"
_LINE_SIZE = "(" + " + ".join(
    [f"length({c}::VARCHAR)" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")]
    + [
        f"length({number_text(c)})"
        for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    ]
) + " + length(l_returnflag) + length(l_linestatus) + 27 + 11 + 2)"


def _quoted(text: str) -> str:
    return f"""CASE WHEN regexp_matches({text}, '[",\\n\\r]')
      THEN '"' || replace({text}, '"', '""') || '"' ELSE {text} END"""


def _sha_json(table: str, view: str, primary: str, unique: str) -> str:
    """The canonical schema text, from the catalog of the SQL engine."""
    return f"""
    SELECT '{table}' AS table_name, {primary} AS primary_key, {unique} AS unique_keys,
      min_by(column_name, ordinal) FILTER (WHERE column_type = 'TIMESTAMP') AS watermark_column,
      count(*) AS column_count,
      '[' || string_agg('{{"name":"' || column_name || '","sqlType":"' ||
        CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int'
          WHEN 'DOUBLE' THEN 'float' WHEN 'VARCHAR' THEN 'nvarchar'
          WHEN 'TIMESTAMP' THEN 'datetime2' END
        || '","isNullable":true' ||
        CASE column_type WHEN 'BIGINT' THEN ',"precision":19,"scale":0'
          WHEN 'INTEGER' THEN ',"precision":10,"scale":0'
          WHEN 'DOUBLE' THEN ',"precision":53' ELSE '' END
        || ',"ordinalPosition":' || ordinal || '}}', ',' ORDER BY ordinal) || ']' AS columns_json
    FROM (SELECT column_name, column_type, row_number() OVER () AS ordinal
          FROM (DESCRIBE {view}))"""


_MANIFESTS = f"""
order_keys AS (
  SELECT count(*) = count(DISTINCT o_orderkey) AS by_order,
    count(*) = count(DISTINCT o_custkey) AS by_customer,
    count(*) = count(DISTINCT (o_custkey, o_orderkey)) AS by_both FROM orders),
line_keys AS (
  SELECT count(*) = count(DISTINCT (l_orderkey, l_linenumber)) AS by_line FROM lineitem),
described AS ({_sha_json(
    'dbo.orders', 'orders',
    "(SELECT CASE WHEN by_order THEN 'o_orderkey' ELSE '' END FROM order_keys)",
    '''(SELECT '[' || concat_ws(',', CASE WHEN by_customer THEN '["o_custkey"]' END,
        CASE WHEN by_both THEN '["o_custkey","o_orderkey"]' END) || ']' FROM order_keys)''',
)}
  UNION ALL {_sha_json(
    'dbo.lineitem', 'lineitem',
    "(SELECT CASE WHEN by_line THEN 'l_orderkey,l_linenumber' ELSE '' END FROM line_keys)",
    "'[]'",
)}),
manifests AS (
  SELECT *, '{{"table":"' || table_name || '","columns":' || columns_json || ',"primaryKey":[' ||
    CASE WHEN primary_key = '' THEN '' ELSE '"' || replace(primary_key, ',', '","') || '"' END ||
    '],"uniqueKeys":' || unique_keys || ',"watermarkColumn":"' || watermark_column || '"}}'
    AS manifest_json
  FROM described)"""

_PROFILE = """
profile AS (
  SELECT 'dbo.orders' AS table_name, true AS cdc_enabled,
    count(*) = count(DISTINCT o_orderkey) AS has_unique_key, count(*) AS estimated_rows FROM orders
  UNION ALL SELECT 'dbo.customer', false, count(*) = count(DISTINCT c_custkey), count(*) FROM customer
  UNION ALL SELECT 'dbo.nation', false, false, count(*) FROM nation
  UNION ALL SELECT 'dbo.region', false, false, count(*) FROM region
  UNION ALL SELECT 'dbo.lineitem', false,
    count(*) = count(DISTINCT (l_orderkey, l_linenumber)), count(*) FROM lineitem)"""

_DURATION = """CASE WHEN finished_at IS NULL THEN 'In progress'
  WHEN millis < 60000 THEN ((millis + 50) // 100 // 10) || '.' || ((millis + 50) // 100 % 10) || 's'
  ELSE ((millis + 3000) // 6000 // 10) || '.' || ((millis + 3000) // 6000 % 10) || 'm' END"""
_RUNS_MILLIS = "(SELECT *, epoch_ms(finished_at) - epoch_ms(started_at) AS millis FROM runs)"

_PLAN = f"""
bounds AS (SELECT capture_instance, min(_lsn) AS low_lsn FROM tenant_ct GROUP BY 1),
high AS (SELECT coalesce(max(_lsn), {ZERO}) AS to_lsn FROM tenant_ct),
ranged AS (
  SELECT s.*, b.low_lsn, {next_lsn(f"coalesce(s.last_processed_lsn, {ZERO})")} AS from_lsn,
    (SELECT to_lsn FROM high) AS to_lsn
  FROM states s LEFT JOIN bounds b ON s.capture_instance = b.capture_instance),
plan AS (
  SELECT *,
    CASE WHEN extraction_mode = 'BLOCK' THEN 'BLOCK'
      WHEN bootstrap_status = 'REBOOTSTRAP' OR extraction_mode = 'SNAP'
        OR bootstrap_status = 'PENDING' THEN 'SNAPSHOT'
      WHEN capture_instance IS NULL OR low_lsn IS NULL THEN 'ERROR'
      WHEN from_lsn > to_lsn THEN 'SKIP' WHEN low_lsn > from_lsn THEN 'GAP' ELSE 'DELTA' END
      AS action,
    CASE WHEN extraction_mode = 'BLOCK' THEN 'no unique key'
      WHEN bootstrap_status = 'REBOOTSTRAP' THEN 'history gap'
      WHEN extraction_mode = 'SNAP' THEN 'snapshot on every run'
      WHEN bootstrap_status = 'PENDING' THEN 'first load'
      WHEN capture_instance IS NULL THEN 'no capture instance'
      WHEN low_lsn IS NULL THEN 'unknown capture instance'
      WHEN from_lsn > to_lsn THEN 'no new changes' WHEN low_lsn > from_lsn THEN 'history gap'
      ELSE 'changes' END AS reason
  FROM ranged)"""

_LEVEL_RANK = """CASE level WHEN 'Debug' THEN 0 WHEN 'Information' THEN 1 WHEN 'Warning' THEN 2
  WHEN 'Error' THEN 3 END"""

_DELTA_OUT = f"""{_OP} AS _op, _lsn, _seqval, {time_text('_ts')} || '+00:00' AS _ts, {_ORDER_COLUMNS}"""


def _chunk_files(source: str, size: str) -> str:
    return f"""SELECT count(*) AS rows, sum({size})::BIGINT AS size, true AS from_one,
      true AS no_holes, true AS within_limit, 0::BIGINT AS oversize_rows FROM {source}"""


ORACLES = {
    "chunk_stats": f"""WITH {ORDERS_CT},
      sized AS (SELECT {_DELTA_SIZE} AS size, _lsn, _seqval, _op_code FROM orders_ct
        WHERE _lsn > {LOW} AND _lsn <= {HIGH}),
      placed AS (SELECT size, 1 + (sum(size) OVER (ORDER BY _lsn, _seqval, _op_code) - size)
        // {CHUNK} AS chunk_no FROM sized)
      SELECT chunk_no::INTEGER AS chunk_no, count(*) AS row_count, sum(size)::BIGINT AS size
      FROM placed GROUP BY 1""",
    "snapshot_scan": "SELECT * FROM lineitem",
    "snapshot_window_scan": """SELECT * FROM orders
      WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-07-01'""",
    "change_scan": f"WITH {ORDERS_CT} SELECT * FROM orders_ct WHERE _lsn BETWEEN {LOW} AND {HIGH}",
    "lsn_range": f"""WITH {FEED} SELECT * FROM feed
      WHERE _lsn <= {HIGH} AND _lsn > CASE capture_instance WHEN 'dbo_orders' THEN {LOW}
        ELSE '0x000007D5000000000000' END""",
    "lsn_high": f"WITH {FEED} SELECT max(_lsn) AS high_lsn FROM feed",
    "lsn_low": f"""WITH {TENANT_CT} SELECT capture_instance, min(_lsn) AS low_lsn
      FROM tenant_ct GROUP BY 1""",
    "change_project": f"WITH {ORDERS_CT} SELECT _lsn, _seqval, _ts, {_ORDER_COLUMNS} FROM orders_ct",
    "change_order": f"""WITH {ORDERS_CT} SELECT _lsn, _seqval, _op_code,
      row_number() OVER (ORDER BY _lsn, _seqval, _op_code) - 1 AS position FROM orders_ct""",
    "change_sort": f"WITH {ORDERS_CT} SELECT * FROM orders_ct ORDER BY _lsn, _seqval, _op_code",
    "commit_time": f"""WITH {ORDERS_CT} SELECT _lsn, _seqval, _op_code,
      CASE WHEN _op_code = 2 THEN o_orderdate + INTERVAL 9 HOUR ELSE TIMESTAMP '2002-06-01' END AS _ts
      FROM orders_ct""",
    "event_dedup": f"WITH {FEED} SELECT * FROM feed",
    "op_counts": f"""WITH {TENANT_CT} SELECT capture_instance, {_OP} AS _op, count(*) AS changes
      FROM tenant_ct GROUP BY 1, 2""",
    "retention_purge": f"""WITH {TENANT_CT},
      cut AS (SELECT *, _ts < TIMESTAMP '2002-01-01' - to_days(2555) AS purged FROM tenant_ct),
      parts AS (SELECT capture_instance, max(_lsn) FILTER (WHERE purged) AS last,
        count(*) FILTER (WHERE NOT purged) AS kept FROM cut GROUP BY 1)
      SELECT capture_instance, coalesce({next_lsn('last')}, {ZERO}) AS floor_lsn, kept FROM parts""",
    "lsn_expr": f"""WITH {FEED} SELECT _lsn, _lsn AS parsed, NULL::VARCHAR AS too_short,
      {next_lsn('_lsn')} AS next_lsn, {next_lsn('_lsn')} > _seqval AS next_after_seqval,
      '0x' || printf('%010X', ('0x' || _lsn[3:12])::BIGINT + 1) || '0000000000' AS carried
      FROM feed""",
    "op_label": f"WITH {FEED} SELECT _lsn, _op_code, {_OP} AS _op FROM feed",
    "op_label_simple": f"""WITH {FEED} SELECT _lsn, _op_code,
      CASE _op_code WHEN 1 THEN 'D' WHEN 2 THEN 'I' ELSE 'U' END AS _op
      FROM feed WHERE _op_code <> 3""",
    "value_text": f"""SELECT l_orderkey::VARCHAR AS l_orderkey, l_partkey::VARCHAR AS l_partkey,
      l_suppkey::VARCHAR AS l_suppkey, l_linenumber::VARCHAR AS l_linenumber,
      {number_text('l_quantity')} AS l_quantity, {number_text('l_extendedprice')} AS l_extendedprice,
      {number_text('l_discount')} AS l_discount, {number_text('l_tax')} AS l_tax,
      l_returnflag, l_linestatus, {time_text('l_shipdate')} AS l_shipdate FROM lineitem""",
    "csv_rows": f"""SELECT doc_id || ',' || {_quoted('text')} || ',' || {_quoted('lang')} || ',,' ||
      {_quoted('source')} || ',' || n_chars AS line FROM documents""",
    "csv_rows_delta": f"""WITH {ORDERS_CT} SELECT concat_ws(',', {_OP}, _lsn, _seqval,
      {time_text('_ts')} || '+00:00', o_orderkey, o_custkey, o_orderstatus,
      {number_text('o_totalprice')}, {time_text('o_orderdate')}, o_orderpriority) AS line
      FROM orders_ct""",
    "row_size": f"SELECT l_orderkey, l_linenumber, {_LINE_SIZE}::BIGINT AS row_size FROM lineitem",
    "row_size_delta": f"""WITH {ORDERS_CT} SELECT _lsn, {_OP} AS _op, {_DELTA_SIZE}::BIGINT AS row_size
      FROM orders_ct""",
    "chunk_assign_offset": f"""WITH sized AS (SELECT o_orderkey, {_ORDERS_SIZE}::BIGINT AS row_size
        FROM orders)
      SELECT o_orderkey, row_size,
        (1 + (sum(row_size) OVER (ORDER BY o_orderkey) - row_size) // {CHUNK})::INTEGER AS chunk_no
      FROM sized""",
    "chunk_assign_greedy": f"""WITH RECURSIVE sized AS (
        SELECT o_orderkey // 2048 AS split, o_orderkey, {_ORDERS_SIZE}::BIGINT AS row_size,
          row_number() OVER (PARTITION BY o_orderkey // 2048 ORDER BY o_orderkey) AS place
        FROM orders),
      walk AS (
        SELECT split, place, o_orderkey, row_size, row_size AS running, 1 AS local
        FROM sized WHERE place = 1
        UNION ALL
        SELECT s.split, s.place, s.o_orderkey, s.row_size,
          CASE WHEN w.running >= {CHUNK} THEN 0 ELSE w.running END + s.row_size,
          w.local + CASE WHEN w.running >= {CHUNK} THEN 1 ELSE 0 END
        FROM walk w JOIN sized s ON s.split = w.split AND s.place = w.place + 1),
      parts AS (SELECT split, max(local) AS chunks FROM walk GROUP BY 1),
      offsets AS (SELECT split, sum(chunks) OVER (ORDER BY split) - chunks AS before FROM parts)
      SELECT o_orderkey, row_size, (before + local)::INTEGER AS chunk_no,
        row_size > {CHUNK} AS oversize_row FROM walk JOIN offsets USING (split)""",
    "chunk_assign_whole": f"""WITH RECURSIVE sized AS (
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, {_LINE_SIZE}::BIGINT AS row_size
        FROM lineitem),
      placed AS (
        SELECT *, row_number() OVER w AS place, sum(row_size) OVER w AS reached FROM sized
        WINDOW w AS (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
      following AS MATERIALIZED (
        SELECT a.place, b.place + 1 AS following
        FROM (SELECT place, reached - row_size + {CHUNK} AS wanted FROM placed) a
        ASOF JOIN (SELECT place, reached FROM placed) b ON a.wanted <= b.reached),
      starts AS (
        SELECT 1::BIGINT AS place, 1 AS chunk_no
        UNION ALL SELECT f.following, s.chunk_no + 1 FROM starts s JOIN following f ON f.place = s.place)
      SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, row_size,
        s.chunk_no::INTEGER AS chunk_no, row_size > {CHUNK} AS oversize_row
      FROM placed p ASOF JOIN starts s ON p.place >= s.place""",
    "snapshot_chunk_write": _chunk_files("lineitem", _LINE_SIZE),
    "delta_chunk_write": f"WITH {ORDERS_CT} " + _chunk_files("orders_ct", _DELTA_SIZE),
    "key_check": """
      WITH lines AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber),
      orders_n AS (SELECT count(*) AS n FROM orders GROUP BY o_orderkey)
      SELECT 'orders' AS table_name, count(*) FILTER (WHERE n > 1) = 0 AS is_unique,
        0::BIGINT AS null_keys, count(*) FILTER (WHERE n > 1) AS duplicate_groups FROM orders_n
      UNION ALL SELECT 'lineitem', count(*) FILTER (WHERE n > 1) = 0, 0::BIGINT,
        count(*) FILTER (WHERE n > 1) FROM lines""",
    "table_profile": f"WITH {_PROFILE} SELECT * FROM profile",
    "extraction_mode": f"""WITH {_PROFILE} SELECT *,
      CASE WHEN cdc_enabled OR has_unique_key THEN 'CDC' WHEN estimated_rows <= 1000 THEN 'SNAP'
        ELSE 'BLOCK' END AS mode,
      CASE WHEN cdc_enabled THEN 'change capture is on' WHEN has_unique_key THEN 'unique key'
        WHEN estimated_rows <= 1000 THEN 'no unique key, at most 1000 rows'
        ELSE 'no unique key, more than 1000 rows' END AS reason FROM profile""",
    "schema_manifest": f"""WITH {_MANIFESTS} SELECT table_name, primary_key, unique_keys,
      watermark_column, column_count, manifest_json FROM manifests""",
    "schema_hash": f"""WITH {_MANIFESTS} SELECT table_name, sha256(manifest_json) AS schema_hash
      FROM manifests""",
    "schema_changed": f"""WITH {_MANIFESTS} SELECT table_name, table_name <> 'dbo.orders' AS changed
      FROM manifests UNION ALL SELECT 'dbo.customer', true""",
    "latest_per_key": f"""WITH {ORDERS_CT}, ranked AS (SELECT *, row_number() OVER (
        PARTITION BY o_orderkey ORDER BY _lsn DESC, _seqval DESC, _op_code DESC) AS place
        FROM orders_ct)
      SELECT _lsn, _seqval, _op_code, {_ORDER_COLUMNS} FROM ranked WHERE place = 1""",
    "keyed_merge": """SELECT o_orderkey, o_custkey,
      CASE WHEN o_orderstatus = 'P' THEN 'F' ELSE o_orderstatus END AS o_orderstatus,
      CASE WHEN o_orderstatus = 'P' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
      o_orderdate, o_orderpriority FROM orders WHERE o_orderpriority <> '5-LOW'""",
    "commit_once": f"""WITH {DATASETS} SELECT DISTINCT
        sha256(table_name || '|' || from_lsn || '|' || to_lsn) AS dataset_id,
        table_name, from_lsn, to_lsn FROM datasets d
      WHERE NOT EXISTS (SELECT 1 FROM datasets c WHERE c.status = 'COMMITTED'
        AND c.table_name = d.table_name AND c.from_lsn = d.from_lsn AND c.to_lsn = d.to_lsn)""",
    "plan_join": f"""WITH {TENANT_CT}, {STATES}, {_PLAN}
      SELECT table_name, low_lsn, from_lsn, to_lsn, action, reason FROM plan""",
    "route_tables": f"""WITH {TENANT_CT}, {STATES}, {_PLAN}
      SELECT extraction_mode, bootstrap_status, action, reason, count(*) AS tables
      FROM plan GROUP BY ALL""",
    "no_change_skip": f"""WITH {TENANT_CT}, {STATES}, {_PLAN}
      SELECT table_name, from_lsn, to_lsn FROM ranged WHERE from_lsn > to_lsn""",
    "gap_detect": f"""WITH {TENANT_CT}, {STATES}, {_PLAN}
      SELECT table_name, from_lsn, low_lsn FROM ranged WHERE from_lsn <= to_lsn
        AND low_lsn > from_lsn""",
    "state_transition": f"""WITH {STATES},
      newest AS (SELECT *, row_number() OVER (PARTITION BY o_custkey
        ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders),
      outcomes AS (SELECT 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0') AS table_name,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'SNAPSHOT' WHEN '2-HIGH' THEN 'GAP'
          WHEN '3-MEDIUM' THEN 'ERROR' ELSE 'DELTA' END AS outcome,
        {lsn(day_of('o_orderdate'), 'o_orderkey')} AS outcome_lsn,
        sha256(o_orderkey::VARCHAR) AS outcome_hash, 'order ' || o_orderkey AS outcome_message
        FROM newest WHERE place = 1),
      met AS (SELECT *, CASE outcome WHEN 'SNAPSHOT' THEN true WHEN 'ERROR' THEN true
        ELSE bootstrap_status = 'COMPLETE' END AS legal FROM states JOIN outcomes USING (table_name))
      SELECT table_name,
        CASE WHEN NOT legal THEN bootstrap_status WHEN outcome = 'SNAPSHOT' THEN 'COMPLETE'
          WHEN outcome = 'GAP' THEN 'REBOOTSTRAP' ELSE bootstrap_status END AS bootstrap_status,
        CASE WHEN NOT legal THEN NULL WHEN outcome IN ('SNAPSHOT', 'DELTA') THEN outcome_lsn
          ELSE last_processed_lsn END AS last_processed_lsn,
        CASE WHEN legal AND outcome = 'SNAPSHOT' THEN outcome_hash END AS schema_hash,
        CASE WHEN NOT legal THEN NULL WHEN outcome IN ('SNAPSHOT', 'DELTA')
          THEN TIMESTAMP '2002-06-01' ELSE last_sync_time END AS last_sync_time,
        CASE WHEN legal AND outcome IN ('GAP', 'ERROR') THEN outcome_message END AS error_message,
        CASE WHEN legal THEN version + 1 END AS version, legal FROM met""",
    "run_summary": f"""WITH {RUNS}, {DATASETS},
      sums AS (SELECT batch_id, count(*) AS datasets,
        count(*) FILTER (WHERE status = 'COMMITTED') AS committed,
        sum(row_count)::BIGINT AS rows, sum(bytes_sent)::BIGINT AS bytes FROM datasets GROUP BY 1)
      SELECT r.batch_id, upper(batch_type) AS batch_type, upper(trigger) AS trigger,
        upper(status) AS status, started_at, finished_at, coalesce(datasets, 0) AS datasets,
        coalesce(committed, 0) AS committed, coalesce(rows, 0) AS rows,
        coalesce(bytes, 0) AS bytes, {_DURATION} AS duration
      FROM {_RUNS_MILLIS} r LEFT JOIN sums s ON r.batch_id = s.batch_id""",
    "newest_run": f"""WITH {RUNS} SELECT batch_id, {_DURATION} AS duration
      FROM {_RUNS_MILLIS} ORDER BY started_at DESC, batch_id DESC LIMIT 1""",
    "run_details": f"""WITH {RUNS}, {DATASETS}
      SELECT r.batch_id, r.batch_type, r.status, r.started_at, r.finished_at, d.dataset_id,
        d.table_name, d.from_lsn, d.to_lsn, d.status AS dataset_status, d.row_count, d.error_code
      FROM runs r LEFT JOIN datasets d ON r.batch_id = d.batch_id""",
    "run_details_nested": f"""WITH {RUNS}, {DATASETS}
      , placed AS (SELECT r.batch_id, d.dataset_id,
          (row_number() OVER (PARTITION BY r.batch_id ORDER BY d.dataset_id) - 1) // 2 AS page,
          greatest(1, (count(d.dataset_id) OVER (PARTITION BY r.batch_id) + 1) // 2) AS pages
        FROM runs r LEFT JOIN datasets d ON r.batch_id = d.batch_id)
      SELECT batch_id, page::BIGINT AS page, pages::BIGINT AS pages, count(dataset_id) AS datasets,
        coalesce(string_agg(dataset_id, '|' ORDER BY dataset_id), '') AS ids
      FROM placed GROUP BY 1, 2, 3""",
    "dataset_totals": """SELECT 'set-' || l_orderkey AS dataset_id,
      sum(l_quantity::BIGINT)::BIGINT AS row_count, count(*) AS chunk_count,
      sum(floor(l_extendedprice)::BIGINT)::BIGINT AS bytes_sent FROM lineitem GROUP BY 1""",
    "recent_runs": f"""WITH {RUNS} SELECT * FROM runs
      ORDER BY started_at DESC, batch_id DESC LIMIT 50""",
    "run_status": f"""WITH {RUNS}, {DATASETS}, {RUN_EVENTS},
      d AS (SELECT batch_id, bool_or(status = 'ABORTED') AS failed FROM datasets GROUP BY 1),
      e AS (SELECT batch_id, bool_or(code = 'LEASE_CONFLICT') AS conflict,
        bool_or(code = 'DOWNSTREAM_UNAVAILABLE') AS unavailable FROM run_events GROUP BY 1)
      SELECT batch_id, CASE WHEN conflict THEN 'ABORTED' WHEN unavailable OR failed THEN 'FAILED'
        ELSE 'SUCCEEDED' END AS status
      FROM runs LEFT JOIN d USING (batch_id) LEFT JOIN e USING (batch_id)""",
    "lag_report": f"""WITH {TENANT_CT}, {STATES}
      SELECT table_schema || '.' || table_name AS "table", extraction_mode AS mode,
        capture_instance IS NOT NULL AS cdc_enabled, last_processed_lsn AS last_lsn,
        bootstrap_status AS status, last_sync_time,
        CASE WHEN last_sync_time IS NULL THEN 0
          ELSE floor((epoch_ms(TIMESTAMP '2002-06-01') - epoch_ms(last_sync_time)) / 60000)::BIGINT
        END AS lag_minutes, error_message,
        (SELECT count(*) FROM tenant_ct c WHERE c.capture_instance = s.capture_instance
          AND c._lsn > coalesce(s.last_processed_lsn, '')) AS changes_behind
      FROM states s""",
    "superseded_runs": f"""WITH {RUNS},
      newest AS (SELECT *, row_number() OVER (PARTITION BY source
        ORDER BY started_at DESC, batch_id DESC) AS place FROM runs)
      SELECT r.batch_id, r.source, r.started_at, n.batch_id AS superseded_by
      FROM runs r JOIN newest n ON n.source = r.source AND n.place = 1
      WHERE r.status = 'RUNNING' AND r.batch_id <> n.batch_id""",
    "inactive_runs": """SELECT user_id, max(ts) AS last_activity FROM events GROUP BY 1
      HAVING max(ts) < TIMESTAMP '2024-01-31' - INTERVAL 1 DAY""",
    "ledger_check": f"""WITH {RUNS}, {DATASETS},
      joined AS (SELECT d.*, r.batch_id AS owner, r.status AS run_status
        FROM datasets d LEFT JOIN runs r ON r.batch_id = d.batch_id)
      SELECT 'run' AS kind, batch_id AS id, 'running but finished' AS rule FROM runs
        WHERE status = 'RUNNING' AND finished_at IS NOT NULL
      UNION ALL SELECT 'run', batch_id, 'finished without end' FROM runs
        WHERE status <> 'RUNNING' AND finished_at IS NULL
      UNION ALL SELECT 'run', batch_id, 'ends before it starts' FROM runs
        WHERE finished_at < started_at
      UNION ALL SELECT 'dataset', dataset_id, 'aborted without code' FROM joined
        WHERE status = 'ABORTED' AND error_code IS NULL
      UNION ALL SELECT 'dataset', dataset_id, 'skipped with rows' FROM joined
        WHERE status = 'SKIPPED' AND row_count > 0
      UNION ALL SELECT 'dataset', dataset_id, 'open in a finished run' FROM joined
        WHERE status = 'UPLOADING' AND run_status <> 'RUNNING'
      UNION ALL SELECT 'dataset', dataset_id, 'no such run' FROM joined WHERE owner IS NULL""",
    "step_check": f"""WITH {DATASETS}, opened AS (SELECT dataset_id, 1 AS version,
        CASE WHEN dataset_id[1:1] = '1' THEN 'UPLOADING' ELSE 'CREATED' END AS status,
        status AS next_status FROM datasets)
      SELECT dataset_id, version, status, next_status FROM opened
      WHERE NOT (status = 'CREATED' AND next_status IN ('UPLOADING', 'SKIPPED', 'ABORTED'))
        AND NOT (status = 'UPLOADING' AND next_status IN ('COMMITTED', 'ABORTED'))""",
    "log_fields": f"""WITH {LOGS} SELECT event_id, timestamp, level, message,
      NULL::VARCHAR AS correlation_id, json_extract_string(properties_json, '$.BatchId') AS batch_id,
      json_extract_string(properties_json, '$.Table') AS "table", NULL::VARCHAR AS dataset_id,
      '{{"k":"' || json_extract_string(properties_json, '$.k') || '"}}' AS properties,
      NULL::VARCHAR AS unparsed FROM logs""",
    "log_query": f"""WITH {LOGS} SELECT event_id, timestamp, level, message FROM logs
      WHERE {_LEVEL_RANK} >= 2 AND contains(lower(message), 'user 1')
      ORDER BY timestamp DESC, event_id DESC LIMIT 500""",
    "log_lines": f"""WITH {LOGS} SELECT strftime(timestamp, '%Y-%m-%d %H:%M:%S.%g') || ' [' || level
      || '] ' || message AS line FROM logs""",
    "log_stream": f"WITH {LOGS} SELECT * FROM logs WHERE {_LEVEL_RANK} >= 2",
    "snapshot_dataset": "SELECT * FROM lineitem",
    "delta_dataset": f"""WITH {ORDERS_CT} SELECT {_DELTA_OUT} FROM orders_ct
      WHERE _lsn BETWEEN {LOW} AND {HIGH}""",
    "dataset_publish": f"""WITH {ORDERS_CT} SELECT 'orders' AS table_name, {LOW} AS from_lsn,
      {HIGH} AS to_lsn, 'COMMITTED' AS status, count(*) AS row_count FROM orders_ct
      WHERE _lsn BETWEEN {LOW} AND {HIGH}""",
    "committed_dataset_read": "SELECT * FROM customer",
    "stream_delta": f"WITH {ORDERS_CT} SELECT {_DELTA_OUT} FROM orders_ct",
    "stream_then_delta": f"WITH {ORDERS_CT} SELECT {_DELTA_OUT} FROM orders_ct",
    "event_dedup_stream": f"WITH {ORDERS_CT} SELECT * FROM orders_ct",
}

_DATASET_ROW = """{epoch}::BIGINT AS epoch, '{kind}' AS batch_type, '{run}' AS run_status,
  '{table}' AS table_name, '{status}' AS status, {rows} AS row_count, {code} AS error_code"""


def _dataset(epoch, kind, run, table, status, source=None, code="NULL::VARCHAR", where="true"):
    rows = "count(*)" if source else "0::BIGINT"
    row = _DATASET_ROW.format(
        epoch=epoch, kind=kind, run=run, table=table, status=status, rows=rows, code=code
    )
    return f"SELECT {row}" + (f" FROM {source} WHERE {where}" if source else "")


_TRACKED = ("orders", "customer", "nation", "region", "lineitem")
_CAPTURED = ("orders", "customer", "lineitem")
ORACLES["snapshot_tables"] = " UNION ALL ".join(
    _dataset(1, "SNAPSHOT", "SUCCEEDED", t, "COMMITTED", t) for t in _TRACKED
)
_SEEN = f"(SELECT max(_lsn) FROM all_feed WHERE _lsn <= {HIGH})"
ORACLES["delta_tables"] = f"WITH {ALL_FEED} " + " UNION ALL ".join(
    [_dataset(1, "SNAPSHOT", "SUCCEEDED", t, "COMMITTED", t) for t in _TRACKED]
    + [
        _dataset(2, "DELTA", "SUCCEEDED", t, "COMMITTED", "all_feed",
                 where=f"capture_instance = 'dbo_{t}' AND _lsn > {_SEEN}")
        for t in _CAPTURED
    ]
    + [_dataset(e, "DELTA", "SUCCEEDED", t, "COMMITTED", t)
       for e in (2, 3) for t in ("nation", "region")]
    + [_dataset(3, "DELTA", "SUCCEEDED", t, "SKIPPED") for t in _CAPTURED]
)
ORACLES["rebootstrap"] = " UNION ALL ".join(
    [_dataset(1, "SNAPSHOT", "SUCCEEDED", t, "COMMITTED", t) for t in _TRACKED]
    + [_dataset(2, "DELTA", "FAILED", t, "ABORTED", code="'CDC_GAP_DETECTED'") for t in ("orders", "lineitem")]
    + [_dataset(3, "DELTA", "FAILED", t, "COMMITTED", t) for t in ("orders", "lineitem")]
    + [_dataset(4, "DELTA", "FAILED", t, "SKIPPED") for t in ("orders", "lineitem")]
    + [_dataset(e, "DELTA", "FAILED", "customer", "ABORTED", code="'DELTA_FAILED'") for e in (2, 3, 4)]
    + [_dataset(e, "DELTA", "FAILED", t, "COMMITTED", t) for e in (2, 3, 4) for t in ("nation", "region")]
)
_LOADED = f"(SELECT max(_lsn) FROM all_feed WHERE _lsn <= {LOW})"
ORACLES["delta_resume"] = f"""WITH {ALL_FEED} SELECT substr(capture_instance, 5) AS table_name,
  count(*) FILTER (WHERE _lsn > {_LOADED})::BIGINT AS published FROM all_feed GROUP BY 1"""
ORACLES["delta_named_instance"] = f"""WITH {ORDERS_CT} SELECT {_DELTA_OUT} FROM orders_ct
  WHERE _lsn > (SELECT max(_lsn) FROM orders_ct WHERE _lsn <= {LOW}) AND _lsn <= {HIGH}"""
ORACLES["committed_mixed_read"] = f"""WITH {ORDERS_CT} SELECT {_DELTA_OUT} FROM orders_ct
  WHERE _lsn BETWEEN {LOW} AND {HIGH}
  UNION ALL SELECT NULL, NULL, NULL, NULL, {_ORDER_COLUMNS} FROM orders"""
ORACLES["window_snapshot"] = ORACLES["snapshot_window_scan"]
ORACLES["purge_flow"] = f"""WITH {FEED}, {LINEITEM_CT},
  timed AS (SELECT capture_instance, _lsn, _ts FROM feed
    UNION ALL SELECT capture_instance, _lsn,
      TIMESTAMP '1990-01-01' + to_days(('0x' || _lsn[3:10])::INTEGER) FROM lineitem_ct),
  cut AS (SELECT *, _ts < TIMESTAMP '2002-01-01' - to_days(2555) AS purged FROM timed),
  parts AS (SELECT capture_instance, max(_lsn) FILTER (WHERE purged) AS last,
    count(*) FILTER (WHERE NOT purged) AS kept FROM cut GROUP BY 1)
  SELECT capture_instance, coalesce({next_lsn('last')}, {ZERO}) AS floor_lsn, kept FROM parts"""
ORACLES["lsn_range_many"] = f"""WITH {TENANT_CT} SELECT * FROM tenant_ct
  WHERE _lsn > {LOW} AND _lsn <= {HIGH}"""
ORACLES["event_dedup_hard"] = f"""WITH {FEED} SELECT capture_instance, _lsn, _seqval, _op_code,
  CASE WHEN _lsn <= {HIGH} THEN _ts END AS _ts FROM feed"""
ORACLES["latest_per_key_hard"] = f"""WITH {ORDERS_CT}, ranked AS (SELECT o_custkey,
    nullif(date_diff('day', DATE '1990-01-01', o_orderdate::DATE) % 7, 0)::INTEGER AS version,
    o_orderkey, _op_code FROM orders_ct)
  SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY o_custkey
    ORDER BY version DESC NULLS LAST, o_orderkey DESC, _op_code DESC) = 1"""
ORACLES["keyed_merge_hard"] = """SELECT o_orderkey, o_custkey,
    CASE WHEN o_orderstatus = 'P' AND o_orderkey % 3 <> 0 THEN 'F' ELSE o_orderstatus END AS o_orderstatus,
    CASE WHEN o_orderstatus = 'P' AND o_orderkey % 3 <> 0 THEN o_totalprice + 1 ELSE o_totalprice END
      AS o_totalprice, o_orderdate, o_orderpriority
  FROM orders WHERE o_orderpriority <> '5-LOW' OR o_orderkey % 3 = 0"""
ORACLES["log_fields_hard"] = f"""WITH {LOGS} SELECT event_id,
    CASE WHEN event_id % 3 = 1 THEN json_extract_string(properties_json, '$.BatchId') END AS batch_id,
    CASE WHEN event_id % 3 = 1 THEN json_extract_string(properties_json, '$.Table') END AS "table",
    CASE WHEN event_id % 3 = 0 THEN '{{broken ' || properties_json END AS unparsed FROM logs"""
ORACLES["log_lines_hard"] = f"""WITH {LOGS} SELECT strftime(timestamp, '%Y-%m-%d %H:%M:%S.%g') || ' ['
  || CASE WHEN event_id % 2 = 0 THEN level ELSE '' END || '] '
  || CASE WHEN event_id % 3 = 0 THEN message ELSE '' END AS line FROM logs"""
