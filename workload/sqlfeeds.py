"""The same feeds as SQL, as common table expressions."""

DAY = "date_diff('day', DATE '1990-01-01', {ts}::DATE)"


def lsn(day: str, number: str) -> str:
    return f"printf('0x%08X%012X', ({day})::BIGINT, ({number})::BIGINT)"


def day_of(ts: str) -> str:
    return DAY.format(ts=ts)


def _ct(name: str, table: str, instance: str, day: str, number: str, filled: str, deleted: str,
        columns: str) -> str:
    steps = f"""
    SELECT 2 AS code, 0 AS later, 1 AS num, b.* FROM {name}_base b
    UNION ALL SELECT 3, 30, 3, b.* FROM {name}_base b WHERE {filled}
    UNION ALL SELECT 4, 30, 3, b.* FROM {name}_base b WHERE {filled}
    UNION ALL SELECT 1, 60, 5, b.* FROM {name}_base b WHERE {deleted}"""
    return f"""
{name}_base AS (SELECT *, {day} AS dayno, {number} AS numb FROM {table}),
{name}_steps AS ({steps}),
{name} AS (
  SELECT {instance} AS capture_instance,
    {lsn('dayno + later', 'numb + num')} AS _lsn,
    {lsn('dayno + later', 'numb + num + 1')} AS _seqval,
    code AS _op_code,
    TIMESTAMP '1990-01-01' + to_days((dayno + later)::INTEGER) AS _ts,
    {columns}
  FROM {name}_steps)"""


_ORDER_COLUMNS = """o_orderkey, o_custkey,
    CASE WHEN o_orderstatus = 'P' AND code IN (4, 1) THEN 'F' ELSE o_orderstatus END AS o_orderstatus,
    CASE WHEN o_orderstatus = 'P' AND code IN (4, 1) THEN o_totalprice + 1 ELSE o_totalprice END
      AS o_totalprice,
    o_orderdate, o_orderpriority"""


def orders_ct(name: str = "orders_ct", instance: str = "'dbo_orders'") -> str:
    return _ct(
        name, "orders", instance, day_of("o_orderdate"), "o_orderkey * 16",
        "o_orderstatus = 'P'", "o_orderpriority = '5-LOW'", _ORDER_COLUMNS,
    )


ORDERS_CT = orders_ct()
TENANT_CT = orders_ct("tenant_ct", "'ci_' || o_custkey")
CUSTOMER_CT = _ct(
    "customer_ct", "customer", "'dbo_customer'", "c_nationkey + 2000", "c_custkey * 16 + 8",
    "c_acctbal < 0", "c_mktsegment = 'MACHINERY'",
    """c_custkey, c_name, c_nationkey,
    CASE WHEN c_acctbal < 0 AND code IN (4, 1) THEN 0.0::DOUBLE ELSE c_acctbal END AS c_acctbal,
    c_mktsegment""",
)
FEED = f"""{ORDERS_CT}, {CUSTOMER_CT},
feed AS (
  SELECT capture_instance, _lsn, _seqval, _op_code, _ts FROM orders_ct
  UNION ALL SELECT capture_instance, _lsn, _seqval, _op_code, _ts FROM customer_ct)"""

_STATE_DAY = """CASE WHEN c_nationkey BETWEEN 10 AND 12 THEN 1500
      WHEN c_nationkey BETWEEN 13 AND 15 THEN 9999 ELSE 3000 + c_nationkey * 50 END"""
STATES = f"""
states AS (
  SELECT 'dbo' AS table_schema, c_name AS table_name,
    CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'SNAP'
      WHEN c_mktsegment = 'FURNITURE' AND c_nationkey = 20 THEN 'BLOCK' ELSE 'CDC' END
      AS extraction_mode,
    CASE WHEN c_nationkey >= 3 THEN {lsn(_STATE_DAY, 'c_custkey')} END AS last_processed_lsn,
    CASE WHEN c_nationkey < 3 THEN 'PENDING' WHEN c_nationkey < 6 THEN 'REBOOTSTRAP'
      ELSE 'COMPLETE' END AS bootstrap_status,
    CASE WHEN c_mktsegment <> 'HOUSEHOLD'
      AND NOT (c_mktsegment = 'BUILDING' AND c_nationkey = 21) THEN 'ci_' || c_custkey END
      AS capture_instance,
    CASE WHEN c_nationkey >= 3 THEN TIMESTAMP '2002-01-01'
      + to_seconds(floor(abs(c_acctbal) * 100)::BIGINT) END AS last_sync_time,
    CASE WHEN c_nationkey = 7 THEN 'permission denied' END AS error_message,
    1::BIGINT AS version
  FROM customer)"""

RUNS = """
runs AS (
  SELECT 'run-' || o_orderkey AS batch_id, 'srv-' || o_custkey AS source,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'Snapshot' ELSE 'Delta' END AS batch_type,
    CASE WHEN o_orderpriority = '2-HIGH' THEN 'Manual' ELSE 'Scheduled' END AS trigger,
    CASE WHEN o_orderstatus = 'O' THEN 'RUNNING' WHEN o_orderstatus = 'F' THEN 'SUCCEEDED'
      WHEN o_orderpriority = '5-LOW' THEN 'ABORTED' ELSE 'FAILED' END AS status,
    o_orderdate + to_seconds(o_orderkey % 86400) AS started_at,
    CASE WHEN o_orderstatus <> 'O' OR o_orderpriority = '3-MEDIUM' THEN o_orderdate
      + to_seconds(o_orderkey % 86400) + to_milliseconds(floor(o_totalprice)::BIGINT) END
      AS finished_at
  FROM orders)"""

DATASETS = f"""
datasets AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, {day_of('l_shipdate')},
      floor(l_extendedprice)::BIGINT) AS dataset_id,
    'run-' || l_orderkey AS batch_id, 'dbo' AS table_schema,
    'part_' || l_partkey AS table_name,
    {lsn(day_of('l_shipdate'), 'l_orderkey * 16 + 1')} AS from_lsn,
    {lsn(day_of('l_shipdate') + ' + 1', 'l_orderkey * 16')} AS to_lsn,
    CASE WHEN l_returnflag = 'R' THEN 'ABORTED' WHEN l_returnflag = 'A' THEN 'COMMITTED'
      WHEN l_linestatus = 'F' THEN 'SKIPPED' ELSE 'UPLOADING' END AS status,
    CASE WHEN l_returnflag = 'N' AND l_linestatus = 'F' AND l_quantity < 50 THEN 0
      ELSE l_quantity END::BIGINT AS row_count,
    l_linenumber::BIGINT AS chunk_count, floor(l_extendedprice)::BIGINT AS bytes_sent,
    CASE WHEN l_returnflag = 'R' AND l_discount < 0.095 THEN 'DELTA_FAILED' END AS error_code
  FROM lineitem)"""

RUN_EVENTS = """
run_events AS (
  SELECT 'run-' || l_orderkey AS batch_id,
    CASE WHEN l_tax > 0.075 THEN 'LEASE_CONFLICT' WHEN l_tax > 0.065
      THEN 'DOWNSTREAM_UNAVAILABLE' ELSE 'DELTA_FAILED' END AS code
  FROM lineitem WHERE l_returnflag = 'R')"""

LOGS = """
logs AS (
  SELECT event_id, ts AS timestamp,
    CASE event_type WHEN 'error' THEN 'Error' WHEN 'purchase' THEN 'Warning'
      WHEN 'signup' THEN 'Debug' ELSE 'Information' END AS level,
    upper(event_type[1]) || event_type[2:] || ' by user ' || user_id || ', properties ' || props
      AS message,
    '{"BatchId": "' || user_id || '", "Table": "dbo.' || event_type || '", ' || props[2:]
      AS properties_json
  FROM events)"""


def number_text(column: str) -> str:
    """Shortest text of a double in the ordinary range, without ``.0``."""
    return f"regexp_replace(CAST({column} AS VARCHAR), '\\.0$', '')"


def time_text(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%dT%H:%M:%S.%f') || '0'"


def next_lsn(text: str) -> str:
    """The following position, carried over two halves of 40 bits."""
    high = f"('0x' || substr({text}, 3, 10))::BIGINT"
    low = f"('0x' || substr({text}, 13, 10))::BIGINT"
    full = "1099511627775"
    return (
        f"CASE WHEN {text} < '0xFFFFFFFFFFFFFFFFFFFF' THEN printf('0x%010X%010X', "
        f"{high} + CASE WHEN {low} = {full} THEN 1 ELSE 0 END, "
        f"CASE WHEN {low} = {full} THEN 0 ELSE {low} + 1 END) END"
    )

LINEITEM_CT = f"""lineitem_ct AS (
  SELECT 'dbo_lineitem' AS capture_instance,
    {lsn(day_of("l_shipdate"), "l_orderkey * 16 + l_linenumber")} AS _lsn FROM lineitem)"""
ALL_FEED = f"""{FEED}, {LINEITEM_CT},
all_feed AS (
  SELECT capture_instance, _lsn FROM feed UNION ALL SELECT capture_instance, _lsn FROM lineitem_ct)"""
