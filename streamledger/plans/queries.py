"""Registered queries over the driver's tables and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamledger.functions import scalars
from streamledger.functions.types import charsets, column_bytes
from streamledger.operators import cdc, filters, index, merge, windows
from streamledger.plans import catalog
from streamledger.sources import changelog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The change log over orders, as in ``changelog.log_of_orders``.
_LOG = """
    o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, o_totalprice AS p, o_orderdate AS ts, o_orderkey // 10 AS txn_id FROM orders),
    log AS (
        SELECT k * 8 + 1 AS record_id, txn_id, k * 800 + 100 AS log_offset, ts, 'INSERT' AS op, k, c, s, p, NULL AS os, NULL AS oc, FALSE AS changed FROM o
        UNION ALL SELECT k * 8 + 2, txn_id, k * 800 + 200, ts, 'UPDATE', k, c, 'U', p, s, c, TRUE FROM o WHERE k % 3 = 0
        UNION ALL SELECT k * 8 + 3, txn_id, k * 800 + 300, ts, 'DELETE', k, NULL, NULL, NULL, CASE WHEN k % 3 = 0 THEN 'U' ELSE s END, c, FALSE FROM o WHERE k % 7 = 0
        UNION ALL SELECT k * 8 + 4, txn_id, k * 800 + 400, ts, 'HEARTBEAT', NULL, NULL, NULL, NULL, NULL, NULL, FALSE FROM o WHERE k % 50 = 25
        UNION ALL SELECT k * 8, txn_id, k * 800, ts, 'BEGIN', NULL, NULL, NULL, NULL, NULL, NULL, FALSE FROM o WHERE k % 10 = 0
        UNION ALL SELECT k * 8 + 7, txn_id, k * 800 + 700, ts, CASE WHEN txn_id % 5 = 0 THEN 'ROLLBACK' ELSE 'COMMIT' END, NULL, NULL, NULL, NULL, NULL, NULL, FALSE FROM o WHERE k % 10 = 9)"""
_EVENTS = """
    log AS (
        SELECT event_id AS record_id, event_id // 10 AS txn_id, ts, user_id AS key, event_type, value,
               CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'purchase' THEN 'REPLACE' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS op
        FROM events)"""


def _query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.log_of_orders(_read(spark, sf_dir, "orders"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.log_of_events(_read(spark, sf_dir, "events"))


# ---- streams, in their batch form ---------------------------------------------------


@_query("""
    SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(event_id) AS n, round(sum(value), 2) AS total
    FROM events GROUP BY 1, 2""")
def stream_tumbling_1h(spark, sf_dir):
    return windows.time_windows(_read(spark, sf_dir, "events"), "1 hour", "event_type", aggregates=[F.count("event_id").alias("n"), F.round(F.sum("value"), 2).alias("total")])


@_query("""
    SELECT time_bucket(INTERVAL '7 days', ts, TIMESTAMP '1970-01-01') AS window_start, count(*) AS n, count(DISTINCT user_id) AS users
    FROM events GROUP BY 1""")
def stream_tumbling_7d(spark, sf_dir):
    return windows.time_windows(_read(spark, sf_dir, "events"), "7 days", aggregates=[F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users")])


@_query("""
    SELECT window_no, count(*) AS n, min(event_id) AS first_event, round(sum(value), 2) AS total
    FROM (SELECT (row_number() OVER (ORDER BY event_id) - 1) // 256 AS window_no, event_id, value FROM events) GROUP BY 1""")
def stream_row_window_256(spark, sf_dir):
    events = _read(spark, sf_dir, "events")
    return windows.row_windows(events, "event_id", 256, F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"), F.round(F.sum("value"), 2).alias("total"))


@_query("SELECT event_id, user_id, event_type, value FROM events WHERE ts >= (SELECT min(ts) FROM events) + INTERVAL '10 days'")
def start_from_timestamp(spark, sf_dir):
    events = _read(spark, sf_dir, "events")
    start = events.agg(F.min("ts").alias("t")).first()["t"]
    later = spark.range(1).select((F.lit(start) + F.expr("INTERVAL 10 DAYS")).alias("t")).first()["t"]
    return filters.start_from(events, timestamp=later).select("event_id", "user_id", "event_type", "value")


@_query(f"WITH {_LOG} SELECT record_id, op FROM log WHERE log_offset >= 4000000")
def start_from_offset(spark, sf_dir):
    return filters.start_from(_orders(spark, sf_dir), offset=4_000_000).select("record_id", "op")


@_query(f"WITH {_LOG} SELECT record_id, op FROM log WHERE record_id >= 60000")
def start_from_id(spark, sf_dir):
    return filters.start_from(_orders(spark, sf_dir), record_id=60_000).select("record_id", "op")


@_query(f"WITH {_LOG} SELECT ts, 'orders' AS source, record_id AS id FROM log WHERE op = 'INSERT' UNION ALL SELECT ts, 'events', event_id FROM events")
def multi_source_union(spark, sf_dir):
    orders = _orders(spark, sf_dir).where("op = 'INSERT'").select("ts", F.lit("orders").alias("source"), F.col("record_id").alias("id"))
    events = _read(spark, sf_dir, "events").select("ts", F.lit("events").alias("source"), F.col("event_id").alias("id"))
    return merge.union_of(orders, events)


@_query("""
    SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, round(sum(value * value) / count(*), 1) AS mean_square
    FROM events GROUP BY 1""")
def window_function_mean_square(spark, sf_dir):
    return windows.time_windows(_read(spark, sf_dir, "events"), "1 hour", aggregates=[F.round(F.sum(F.col("value") * F.col("value")) / F.count(F.lit(1)), 1).alias("mean_square")])


# ---- projection and filters ---------------------------------------------------------


@_query("SELECT * FROM orders")
def select_star(spark, sf_dir):
    return _read(spark, sf_dir, "orders")


@_query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def select_distinct(spark, sf_dir):
    return _read(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@_query("SELECT count(o_orderkey) AS n, round(sum(o_totalprice), 2) AS total FROM orders")
def count_sum(spark, sf_dir):
    return _read(spark, sf_dir, "orders").agg(F.count("o_orderkey").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@_query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def where_conjunctive_eq(spark, sf_dir):
    found = filters.where_equal(_read(spark, sf_dir, "orders"), o_orderstatus="F", o_orderpriority="1-URGENT")
    return found.select("o_orderkey", "o_totalprice")


@_query(f"WITH {_LOG} SELECT record_id, op FROM log WHERE txn_id % 2 = 0")
def table_allow_list(spark, sf_dir):
    log = _orders(spark, sf_dir).withColumn("tbl", F.when(F.col("txn_id") % 2 == 0, "orders").otherwise("returns"))
    return filters.allowed_tables(log, ["SHOP.Orders", "shop.lineitem"]).select("record_id", "op")


@_query(f"WITH {_LOG} SELECT record_id, txn_id, CAST(1 AS INTEGER) AS log_id, log_offset, ts, op FROM log")
def decode_header(spark, sf_dir):
    return changelog.header(_orders(spark, sf_dir))


@_query(f"WITH {_LOG} SELECT record_id, op, k AS new_key, s AS new_status, os AS old_status FROM log WHERE op IN ('INSERT', 'UPDATE')")
def decode_dml(spark, sf_dir):
    rows = changelog.dml(_orders(spark, sf_dir)).where("op <> 'DELETE'")
    return rows.select("record_id", "op", F.col("new.k").alias("new_key"), F.col("new.s").alias("new_status"), F.col("old.s").alias("old_status"))


@_query(f"WITH {_LOG} SELECT txn_id, count(*) FILTER (op IN ('INSERT', 'UPDATE', 'DELETE')) AS changes, count(*) FILTER (op IN ('BEGIN', 'COMMIT', 'ROLLBACK')) AS markers FROM log GROUP BY 1")
def transaction_view(spark, sf_dir):
    return _orders(spark, sf_dir).groupBy("txn_id").agg(F.count_if(F.col("op").isin(*changelog.DML)).alias("changes"), F.count_if(F.col("op").isin(*changelog.MARKERS)).alias("markers"))


@_query(f"WITH {_LOG} SELECT record_id, os AS old_status, oc AS old_customer FROM log WHERE op = 'UPDATE'")
def update_old_image(spark, sf_dir):
    rows = _orders(spark, sf_dir).where("op = 'UPDATE'")
    return rows.select("record_id", filters.old_value("s", 2).alias("old_status"), filters.old_value("c", 1).alias("old_customer"))


@_query(f"WITH {_LOG} SELECT record_id, k % 2 = 0 AS primary_changed, k % 4 < 3 AS status_changed, CAST(CASE k % 4 WHEN 3 THEN 2 WHEN 1 THEN 4 ELSE 5 END AS BIGINT) AS bits FROM log WHERE op = 'UPDATE'")
def key_updated(spark, sf_dir):
    key = F.col("new.k") % 4
    changed = F.when(key == 3, F.array(F.lit(1))).when(key == 1, F.array(F.lit(2))).otherwise(F.array(F.lit(0), F.lit(2)))
    rows = _orders(spark, sf_dir).where("op = 'UPDATE'").withColumn("changed", changed)
    return rows.select("record_id", filters.key_updated([0]).alias("primary_changed"), filters.key_updated([0, 2]).alias("status_changed"), filters.changed_bits().alias("bits"))


@_query(f"WITH {_LOG} SELECT record_id, op FROM log WHERE op <> 'HEARTBEAT'")
def drop_heartbeats(spark, sf_dir):
    return filters.without_heartbeats(_orders(spark, sf_dir)).select("record_id", "op")


@_query(f"""
    WITH {_LOG} SELECT record_id, txn_id, op FROM log
    WHERE op IN ('INSERT', 'UPDATE', 'DELETE') AND txn_id IN (SELECT txn_id FROM log WHERE op = 'COMMIT')""")
def committed_only(spark, sf_dir):
    return filters.committed(_orders(spark, sf_dir)).select("record_id", "txn_id", "op")


# ---- indexes ------------------------------------------------------------------------


@_query("SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS record_ids FROM events GROUP BY 1")
def index_postings(spark, sf_dir):
    entries = _read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("record_id"))
    return index.postings(entries, "user_id").select("user_id", F.array_join(F.col("record_ids").cast("array<string>"), ",").alias("record_ids"))


@_query(f"""
    WITH {_LOG} SELECT record_id, s AS key FROM log WHERE op IN ('INSERT', 'UPDATE')
    UNION ALL SELECT record_id, os FROM log WHERE op = 'DELETE' OR op = 'UPDATE' AND os <> s""")
def index_images(spark, sf_dir):
    return index.entries(_orders(spark, sf_dir).where("op IN ('INSERT', 'UPDATE', 'DELETE')"), F.col("new.s"), F.col("old.s")).select("record_id", "key")


@_query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, min(o_orderkey) AS first_record, max(o_orderkey) AS last_record FROM orders GROUP BY 1, 2")
def index_composite(spark, sf_dir):
    entries = _read(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", F.col("o_orderkey").alias("record_id"))
    return index.summary(entries, "o_orderstatus", "o_orderpriority")


@_query("SELECT o_custkey, o_orderkey AS record_id FROM orders WHERE o_custkey = 10")
def index_seek(spark, sf_dir):
    return index.seek(_read(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("record_id")), o_custkey=10)


@_query("SELECT DISTINCT o_custkey FROM orders ORDER BY 1")
def index_key_scan(spark, sf_dir):
    return index.keys_in_order(_read(spark, sf_dir, "orders"), "o_custkey")


@_query("SELECT count(DISTINCT o_custkey) AS keys FROM orders")
def index_distinct_keys(spark, sf_dir):
    return _read(spark, sf_dir, "orders").agg(F.countDistinct("o_custkey").alias("keys"))


@_query("SELECT max(o_totalprice) AS o_totalprice FROM orders WHERE o_totalprice <= 100000.5 HAVING count(*) > 0")
def index_floor(spark, sf_dir):
    return index.floor_of(_read(spark, sf_dir, "orders"), "o_totalprice", 100000.5)


@_query("SELECT min(c_name) AS c_name FROM customer WHERE c_name >= 'Customer#000000500x' HAVING count(*) > 0")
def index_ceiling(spark, sf_dir):
    return index.ceiling_of(_read(spark, sf_dir, "customer"), "c_name", "Customer#000000500x")


@_query("SELECT min(o_orderdate) AS first_key, max(o_orderdate) AS last_key FROM orders")
def index_first_last(spark, sf_dir):
    return index.ends(_read(spark, sf_dir, "orders"), "o_orderdate")


@_query(f"WITH {_LOG} SELECT record_id, op FROM log WHERE s = 'U'")
def index_back_reference(spark, sf_dir):
    log = _orders(spark, sf_dir)
    listed = index.seek(log.select(F.col("new.s").alias("key"), "record_id"), key="U")
    return index.records_of(log, listed).select("record_id", "op")


@_query("SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE abs(l_discount - 0.05) <= 1e-9")
def index_nearly_equal(spark, sf_dir):
    return _read(spark, sf_dir, "lineitem").where(scalars.nearly(F.col("l_discount"), F.lit(0.05), 1e-9)).select("l_orderkey", "l_linenumber", "l_discount")


# ---- merges -------------------------------------------------------------------------


@_query("""
    SELECT ts, source, id FROM (
        SELECT o_orderdate AS ts, 'orders' AS source, o_orderkey AS id FROM orders
        UNION ALL SELECT ts, 'events', event_id FROM events) ORDER BY ts, source, id""")
def kway_merge(spark, sf_dir):
    orders = _read(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("ts"), F.lit("orders").alias("source"), F.col("o_orderkey").alias("id"))
    events = _read(spark, sf_dir, "events").select("ts", F.lit("events").alias("source"), F.col("event_id").alias("id"))
    return merge.merged(orders, events, by=["ts", "source", "id"])


# ---- applying changes ---------------------------------------------------------------


@_query(f"""
    WITH {_EVENTS} SELECT key, record_id, op, value FROM log
    QUALIFY row_number() OVER (PARTITION BY key ORDER BY record_id DESC) = 1 AND op <> 'DELETE'""")
def cdc_last_write_wins(spark, sf_dir):
    return cdc.last_writes(_events(spark, sf_dir)).select("key", "record_id", "op", "value")


@_query(f"""
    WITH {_LOG}, touched AS (
        SELECT txn_id, record_id, s AS key FROM log WHERE op IN ('INSERT', 'UPDATE')
        UNION SELECT txn_id, record_id, os FROM log WHERE op IN ('UPDATE', 'DELETE'))
    SELECT txn_id, count(*) AS touched, count(DISTINCT key) AS keys FROM touched GROUP BY 1""")
def cdc_key_hashes(spark, sf_dir):
    changes = changelog.dml(_orders(spark, sf_dir))
    hashes = cdc.key_hashes(changes, F.col("new.s"), F.col("old.s"), "status")
    return hashes.groupBy("txn_id").agg(F.count(F.lit(1)).alias("touched"), F.countDistinct("key_hash").alias("keys"))


@_query(f"""
    WITH {_EVENTS}, b AS (SELECT txn_id, record_id, CAST(first(txn_id) OVER (PARTITION BY key ORDER BY record_id) <> txn_id AS BIGINT) AS is_blocked FROM log)
    SELECT txn_id, CAST(sum(is_blocked) AS BIGINT) AS blocking FROM b GROUP BY 1""")
def txn_blocking_count(spark, sf_dir):
    return cdc.blocking_counts(cdc.touched(_events(spark, sf_dir), F.col("key")))


@_query(f"""
    WITH {_EVENTS}, b AS (SELECT record_id, CAST(first(txn_id) OVER (ORDER BY record_id) <> txn_id AS INTEGER) AS is_blocked FROM log WHERE event_type = 'signup')
    SELECT record_id, is_blocked FROM b""")
def cdc_no_key_queue(spark, sf_dir):
    signups = _events(spark, sf_dir).where("event_type = 'signup'")
    return cdc.blocked(cdc.touched(signups, F.lit(None))).select("record_id", "is_blocked")


@_query(f"""
    WITH {_EVENTS}, d AS (SELECT record_id, event_type, CASE WHEN record_id % 997 = 0 THEN 'DDL' ELSE op END AS op FROM log)
    SELECT record_id, event_type, count(*) FILTER (op = 'DDL') OVER (PARTITION BY event_type ORDER BY record_id) AS epoch FROM d""")
def ddl_epochs(spark, sf_dir):
    log = _events(spark, sf_dir).withColumns({"op": F.when(F.col("record_id") % 997 == 0, "DDL").otherwise(F.col("op")), "tbl": F.upper("event_type")})
    return cdc.ddl_epochs(log).select("record_id", "event_type", "epoch")


@_query(f"""
    WITH RECURSIVE {_EVENTS.strip()}, t AS (SELECT record_id // 1000 AS txn_id, record_id, key FROM log),
    w AS (SELECT DISTINCT txn_id, waits_for FROM (SELECT txn_id, lag(txn_id) OVER (PARTITION BY key ORDER BY record_id) AS waits_for FROM t) WHERE waits_for <> txn_id),
    l(txn_id, level) AS (SELECT DISTINCT txn_id, 1 FROM t UNION SELECT w.txn_id, l.level + 1 FROM l JOIN w ON w.waits_for = l.txn_id)
    SELECT txn_id, CAST(max(level) AS INTEGER) AS level FROM l GROUP BY 1""")
def txn_levels(spark, sf_dir):
    log = _events(spark, sf_dir).withColumn("txn_id", F.call_function("div", F.col("record_id"), F.lit(1000)))
    touches = cdc.touched(log, F.col("key"))
    return cdc.levels(touches.select("txn_id").distinct(), cdc.dependencies(touches))


@_query("SELECT lower(event_type) AS tbl, count(*) AS records, max(event_id) AS last_record FROM events GROUP BY 1")
def table_state(spark, sf_dir):
    log = _read(spark, sf_dir, "events").withColumn("tbl", F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")))
    return log.groupBy(F.lower("tbl").alias("tbl")).agg(F.count(F.lit(1)).alias("records"), F.max("event_id").alias("last_record"))


# ---- catalog ------------------------------------------------------------------------

#: Schema changes of two tables: checkpoint, place within it, action, column, new name, type, the column before it.
_CHANGES = [
    ("shop", "orders", 0, 0, "create", "k", None, "bigint", None),
    ("shop", "orders", 0, 1, "create", "c", None, "bigint", None),
    ("shop", "orders", 0, 2, "create", "s", None, "string", None),
    ("shop", "orders", 2000000, 0, "add", "note", None, "string", "c"),
    ("shop", "orders", 4000000, 0, "change", "s", "status", "string", None),
    ("shop", "orders", 4000000, 1, "add", "id", None, "int", ""),
    ("shop", "orders", 6000000, 0, "modify", "c", None, "decimal(20,0)", None),
    ("shop", "orders", 8000000, 0, "drop", "note", None, None, None),
    ("shop", "orders", 9000000, 0, "add", "last", None, "double", None),
    ("shop", "parts", 1000000, 0, "create", "p", None, "int", None),
    ("shop", "parts", 3000000, 0, "drop_table", None, None, None, None),
]
_VERSIONS = """
    v(db, tbl, version, begin_cp, columns) AS (VALUES
        ('shop', 'orders', 1, 0, 'k bigint, c bigint, s string'),
        ('shop', 'orders', 2, 2000000, 'k bigint, c bigint, note string, s string'),
        ('shop', 'orders', 3, 4000000, 'id int, k bigint, c bigint, note string, status string'),
        ('shop', 'orders', 4, 6000000, 'id int, k bigint, c decimal(20,0), note string, status string'),
        ('shop', 'orders', 5, 8000000, 'id int, k bigint, c decimal(20,0), status string'),
        ('shop', 'orders', 6, 9000000, 'id int, k bigint, c decimal(20,0), status string, last double'),
        ('shop', 'parts', 1, 1000000, 'p int'),
        ('shop', 'parts', 2, 3000000, NULL)),
    t AS (SELECT db, tbl, version, CAST(begin_cp AS BIGINT) AS begin_cp, columns,
                 coalesce(lead(begin_cp) OVER (PARTITION BY db, tbl ORDER BY begin_cp), 9223372036854775807) AS end_cp FROM v)"""


def _catalog(spark: SparkSession) -> DataFrame:
    names = ("db", "tbl", "cp", "seq", "action", "name", "new_name", "type", "after")
    rows = F.explode(F.array(*[F.struct(*[F.lit(v).cast("bigint" if n in ("cp", "seq") else "string").alias(n) for n, v in zip(names, row, strict=True)]) for row in _CHANGES]))
    found = catalog.timeline(catalog.versions(spark.range(1).select(rows.alias("c")).select("c.*")), "db", "tbl")
    return found.withColumn("columns", F.array_join(F.transform("columns", lambda c: F.concat_ws(" ", c["name"], c["type"])), ", "))


@_query(f"WITH {_VERSIONS} SELECT db, tbl, version, columns, begin_cp, end_cp FROM t")
def catalog_timeline(spark, sf_dir):
    return _catalog(spark).select("db", "tbl", "version", "columns", "begin_cp", "end_cp")


#: Changes of keys and their columns, and the keys after each.
_KEY_CHANGES = [
    ("create", "a", None, "int", None), ("create", "b", None, "int", None), ("create", "c", None, "string", None),
    ("add_key", "PRIMARY", None, "a, b", None), ("add_key", "by_c", None, "c", None), ("rename", "B", "z", None, None),
    ("drop", "a", None, None, None), ("modify", "C", None, "bigint", ""), ("drop", "c", None, None, None), ("drop_key", "primary", None, None, None),
]


@_query("""
    SELECT * FROM (VALUES (0, 'a int', ''), (1, 'a int, b int', ''), (2, 'a int, b int, c string', ''), (3, 'a int, b int, c string', 'PRIMARY(a,b)'),
        (4, 'a int, b int, c string', 'PRIMARY(a,b) by_c(c)'), (5, 'a int, z int, c string', 'PRIMARY(a,z) by_c(c)'), (6, 'z int, c string', 'PRIMARY(z) by_c(c)'),
        (7, 'c bigint, z int', 'PRIMARY(z) by_c(c)'), (8, 'z int', 'PRIMARY(z)'), (9, 'z int', '')) v(cp, columns, keys)""")
def catalog_keys(spark, sf_dir):
    text = lambda v: "NULL" if v is None else f"'{v}'"
    rows = ", ".join(f"('d', 't', {cp}L, 0L, {', '.join(map(text, change))})" for cp, change in enumerate(_KEY_CHANGES))
    changes = spark.sql(f"SELECT * FROM VALUES {rows} AS v(db, tbl, cp, seq, action, name, new_name, type, after)")
    named = lambda k: F.concat(k["name"], F.lit("("), F.array_join(k["parts"], ","), F.lit(")"))
    return catalog.versions(changes).select(
        F.col("begin_cp").cast("int").alias("cp"), F.array_join(F.transform("columns", lambda c: F.concat_ws(" ", c["name"], c["type"])), ", ").alias("columns"), F.array_join(F.transform("keys", named), " ").alias("keys")
    )


#: Charsets of three databases over the ids of orders; tables are made by every order, and every fifth names its own.
_DATABASES = "('db0', 0, 0, 'utf8'), ('db1', 2000, 0, 'gbk'), ('DB0', 3000, 1, 'utf8mb4'), ('db0', 3000, 0, 'ascii'), ('db1', 9000, 0, NULL)"


@_query(f"""
    WITH d(db, cp, seq, charset) AS (VALUES {_DATABASES}),
    t AS (SELECT 'db' || CAST(o_orderkey % 3 AS VARCHAR) AS db, o_orderkey AS cp, CASE WHEN o_orderkey % 5 = 0 THEN 'binary' END AS charset FROM orders),
    c AS (SELECT t.*, d.charset AS inherited, row_number() OVER (PARTITION BY t.cp ORDER BY d.cp DESC, d.seq DESC) AS r
          FROM t LEFT JOIN d ON lower(d.db) = t.db AND d.cp <= t.cp)
    SELECT db, coalesce(charset, inherited, 'latin1') AS charset, count(*) AS n, min(cp) AS first_cp FROM c WHERE r = 1 GROUP BY ALL""")
def catalog_charset(spark, sf_dir):
    db = F.concat(F.lit("db"), F.pmod("o_orderkey", F.lit(3)).cast("string"))
    own = F.when(F.pmod("o_orderkey", F.lit(5)) == 0, "binary")
    tables = spark.read.parquet(f"{sf_dir}/orders.parquet").select(db.alias("db"), F.col("o_orderkey").alias("cp"), own.alias("charset"))
    databases = spark.sql(f"SELECT db, CAST(cp AS BIGINT) AS cp, seq, charset FROM VALUES {_DATABASES} AS v(db, cp, seq, charset)")
    return catalog.with_charsets(tables, databases, "latin1").groupBy("db", "charset").agg(F.count(F.lit(1)).alias("n"), F.min("cp").alias("first_cp"))


@_query(f"WITH {_VERSIONS} SELECT tbl, version, columns FROM t WHERE begin_cp <= 5000000 AND end_cp > 5000000")
def catalog_valid_at(spark, sf_dir):
    return catalog.valid_at(_catalog(spark), 5_000_000).select("tbl", "version", "columns")


@_query(f"WITH {_VERSIONS} SELECT tbl, version FROM t WHERE end_cp > 4000000")
def catalog_purge(spark, sf_dir):
    return catalog.purged(_catalog(spark), 4_000_000).select("tbl", "version")


@_query(f"WITH {_VERSIONS} SELECT tbl, version, CAST((CASE tbl WHEN 'orders' THEN 1 ELSE 2 END) * 65536 + version AS BIGINT) AS table_id FROM t WHERE tbl = 'orders' AND version = 3")
def catalog_by_id(spark, sf_dir):
    numbered = _catalog(spark).withColumn("table_id", scalars.table_id(F.when(F.col("tbl") == "orders", 1).otherwise(2), F.col("version")))
    return numbered.where(F.col("table_id") == 65536 + 3).select("tbl", "version", "table_id")


@_query(f"""
    WITH {_LOG}, {_VERSIONS.strip()} SELECT l.record_id, t.version, t.columns FROM log l
    LEFT JOIN t ON t.tbl = 'orders' AND t.begin_cp <= l.log_offset AND l.log_offset < t.end_cp""")
def asof_schema_version(spark, sf_dir):
    log = _orders(spark, sf_dir).withColumn("tbl", F.upper("tbl"))
    return catalog.with_schema(log, _catalog(spark), F.col("log_offset"), ["db", "tbl"]).select("record_id", "version", "columns")


@_query("SELECT o_orderkey, CAST(1 + o_orderkey % 3 AS BIGINT) AS tbl, CAST(o_orderkey % 100 AS INTEGER) AS version FROM orders")
def table_id_split(spark, sf_dir):
    made = _read(spark, sf_dir, "orders").select("o_orderkey", scalars.table_id(1 + F.col("o_orderkey") % 3, F.col("o_orderkey") % 100).alias("id"))
    return made.select("o_orderkey", scalars.table_of(F.col("id")).alias("tbl"), scalars.version_of(F.col("id")).alias("version"))


@_query("""
    SELECT n_name, CAST(n_nationkey * CASE n_nationkey % 3 WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE 1 END AS INTEGER) AS max_bytes FROM nation""")
def charset_bytes(spark, sf_dir):
    own = F.when(F.col("n_nationkey") % 3 == 0, "UTF8MB4")
    table = F.when(F.col("n_nationkey") % 3 == 1, "utf8")
    return _read(spark, sf_dir, "nation").select("n_name", column_bytes(F.col("n_nationkey"), own, table, F.lit("latin1")).alias("max_bytes"))


@_query("SELECT max_bytes, count(*) AS n FROM (VALUES (1, 26), (2, 7), (3, 3), (4, 5)) v(max_bytes, k), range(k) GROUP BY 1")
def charset_table(spark, sf_dir):
    return charsets(spark).groupBy("max_bytes").agg(F.count(F.lit(1)).alias("n"))


@_query("""
    SELECT tbl, 'CREATE TABLE `' || tbl || '` (' || cols || ', PRIMARY KEY (`id`))' AS ddl FROM (VALUES
        ('a', '`id` BIGINT(20) UNSIGNED NOT NULL, `name` VARCHAR(64) CHARACTER SET utf8, `price` DECIMAL(10,2)'),
        ('b', '`id` INT NOT NULL, `at` DATETIME(6)')) v(tbl, cols)""")
def schema_to_ddl(spark, sf_dir):
    names = "tbl string, ordinal int, name string, source_type string, size int, decimals int, unsigned boolean, not_null boolean, charset string, is_primary boolean"
    rows = """VALUES ('a', 0, 'id', 'BIGINT', 20, null, true, true, null, true), ('a', 1, 'name', 'VARCHAR', 64, null, false, false, 'utf8', false),
        ('a', 2, 'price', 'DECIMAL', 10, 2, false, false, null, false), ('b', 0, 'id', 'INT', null, null, false, true, null, true),
        ('b', 1, 'at', 'DATETIME', 6, null, false, false, null, false)"""
    columns = spark.sql(f"SELECT * FROM {rows} AS v({', '.join(n.split()[0] for n in names.split(', '))})")
    return scalars.table_ddl(columns)


@_query("""
    SELECT n_nationkey, 'create table t (a int ' || CASE WHEN n_nationkey * 10000 <= 80000 THEN 'default 1 ' ELSE '' END || ', b text default ''/* not  one */'')' AS statement FROM nation""")
def version_comments(spark, sf_dir):
    text = F.concat(F.lit("create /* plain */ table t\n (a int /*!"), F.lpad((F.col("n_nationkey") * 10000).cast("string"), 6, "0"), F.lit(" default 1 */ , b  text default '/* not  one */')"))
    return _read(spark, sf_dir, "nation").select("n_nationkey", scalars.without_comments(text, 80000).alias("statement"))


@_query("SELECT n_nationkey, n_name, n_nationkey % 2 = 0 AS same, hex(n_name) AS code, 'name_é' AS decoded FROM nation")
def name_helpers(spark, sf_dir):
    nation = _read(spark, sf_dir, "nation")
    return nation.select("n_nationkey", "n_name", scalars.same_name(F.col("n_name"), F.when(F.col("n_nationkey") % 2 == 0, F.upper("n_name")).otherwise(F.concat("n_name", F.lit("_")))).alias("same"), F.hex("n_name").alias("code"), F.decode(F.unhex(F.lit("6e616d655fc3a9")), "UTF-8").alias("decoded"))


# ---- storage ------------------------------------------------------------------------


@_query(f"WITH {_LOG} SELECT record_id // 4096 AS block_id, count(*) AS records, min(record_id) AS first_record, max(record_id) AS last_record, min(ts) AS min_ts, max(ts) AS max_ts FROM log GROUP BY 1")
def block_stats(spark, sf_dir):
    return changelog.block_stats(_orders(spark, sf_dir), 4096)


@_query(f"WITH {_LOG} SELECT record_id, op FROM log WHERE record_id // 4096 BETWEEN 2 AND 5")
def block_prune(spark, sf_dir):
    blocks = changelog.in_blocks(_orders(spark, sf_dir), 4096)
    return blocks.where(F.col("block_id").between(2, 5)).select("record_id", "op")


@_query("SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL '86400 seconds'")
def retention_purge(spark, sf_dir):
    events = _read(spark, sf_dir, "events")
    now = events.agg(F.max("ts").alias("t")).first()["t"]
    return changelog.retained(events, F.lit(now), 86_400).select("event_id", "ts")


# ---- extras over the driver's tables, no part of the reference ----------------------


@_query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_scalar(spark, sf_dir):
    return _read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@_query("""
    SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark, sf_dir):
    rows = _read(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"),
    )
