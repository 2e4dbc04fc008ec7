"""Change logs as DataFrames: the canonical columns, logs over the driver's tables, storage in blocks.

Canonical columns: ``record_id, txn_id, log_id, log_offset, ts, op, db, tbl, table_id, new,
old, changed, ddl``. ``op`` is one of INSERT UPDATE DELETE REPLACE BEGIN COMMIT ROLLBACK
DDL HEARTBEAT. ``changed`` holds the ordinals of the columns that an UPDATE changed.
Order is always by ``record_id``; nothing relies on file order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DML = ("INSERT", "UPDATE", "DELETE", "REPLACE")
MARKERS = ("BEGIN", "COMMIT", "ROLLBACK")
#: Records in one block, as many as a block's slots.
BLOCK_RECORDS = 131_072


def log_of_events(events: DataFrame) -> DataFrame:
    """A log over ``events``: the key is the user, the order the event."""
    op = (
        F.when(F.col("event_type") == "signup", "INSERT")
        .when(F.col("event_type") == "purchase", "REPLACE")
        .when(F.col("event_type") == "error", "DELETE")
        .otherwise("UPDATE")
    )
    return events.select(
        F.col("event_id").alias("record_id"), F.call_function("div", F.col("event_id"), F.lit(10)).alias("txn_id"), F.col("ts"), op.alias("op"), F.lit("events").alias("tbl"),
        F.col("user_id").alias("key"), "event_type", "value",
    )


def log_of_orders(orders: DataFrame) -> DataFrame:
    """A log over ``orders``: every order is inserted, each third updated, each seventh deleted, ten to a transaction.

    One transaction in five is rolled back; heartbeats stand between the records.
    """
    key = F.col("o_orderkey")
    image = lambda status: F.struct(key.alias("k"), F.col("o_custkey").alias("c"), status.alias("s"), F.col("o_totalprice").alias("p"))
    nothing = F.lit(None).cast("struct<k:bigint,c:bigint,s:string,p:double>")
    given, updated = image(F.col("o_orderstatus")), image(F.lit("U"))
    last = F.when(key % 3 == 0, updated).otherwise(given)
    unchanged = F.array().cast("array<int>")
    txn = F.call_function("div", key, F.lit(10))

    def step(number: int, op: Column, new: Column, old: Column, changed: Column) -> Column:
        return F.struct(F.lit(number).alias("step"), op.alias("op"), new.alias("new"), old.alias("old"), changed.alias("changed"))

    none = F.lit(None).cast(f"struct<step:int,op:string,new:{nothing_type()},old:{nothing_type()},changed:array<int>>")
    steps = F.array(
        step(1, F.lit("INSERT"), given, nothing, unchanged),
        F.when(key % 3 == 0, step(2, F.lit("UPDATE"), updated, given, F.array(F.lit(2)))).otherwise(none),
        F.when(key % 7 == 0, step(3, F.lit("DELETE"), nothing, last, unchanged)).otherwise(none),
        F.when(key % 50 == 25, step(4, F.lit("HEARTBEAT"), nothing, nothing, unchanged)).otherwise(none),
        F.when(key % 10 == 0, step(0, F.lit("BEGIN"), nothing, nothing, unchanged)).otherwise(none),
        F.when(key % 10 == 9, step(7, F.when(txn % 5 == 0, "ROLLBACK").otherwise("COMMIT"), nothing, nothing, unchanged)).otherwise(none),
    )
    rows = orders.select(key.alias("k"), "o_orderdate", txn.alias("txn_id"), F.explode(F.filter(steps, lambda s: s.isNotNull())).alias("s"))
    return rows.select(
        (F.col("k") * 8 + F.col("s.step")).alias("record_id"), "txn_id", F.lit(1).alias("log_id"), (F.col("k") * 800 + F.col("s.step") * 100).alias("log_offset"),
        F.col("o_orderdate").alias("ts"), F.col("s.op").alias("op"), F.lit("shop").alias("db"), F.lit("orders").alias("tbl"), F.lit(65537).cast("long").alias("table_id"),
        F.col("s.new").alias("new"), F.col("s.old").alias("old"), F.col("s.changed").alias("changed"), F.lit(None).cast("string").alias("ddl"),
    )


def nothing_type() -> str:
    return "struct<k:bigint,c:bigint,s:string,p:double>"


def header(log: DataFrame) -> DataFrame:
    """The columns that every record has, whatever its kind."""
    return log.select("record_id", "txn_id", "log_id", "log_offset", "ts", "op")


def dml(log: DataFrame) -> DataFrame:
    """Row changes with their images side by side."""
    return log.where(F.col("op").isin(*DML)).select("record_id", "txn_id", "op", "tbl", "new", "old", "changed")


def ddl(log: DataFrame) -> DataFrame:
    """Schema changes."""
    return log.where("op = 'DDL'").select("record_id", "db", "ddl")


def in_blocks(log: DataFrame, records: int = BLOCK_RECORDS) -> DataFrame:
    """The log with ``block_id``; a block spans ``records`` consecutive ids."""
    return log.withColumn("block_id", F.call_function("div", F.col("record_id"), F.lit(records)))


def append(log: DataFrame, folder: str, records: int = BLOCK_RECORDS) -> None:
    """Append to a stored log, dealt by block, so that a block's records lie together and files stay bounded."""
    in_blocks(log, records).repartition("block_id").sortWithinPartitions("record_id").write.mode("append").option("maxRecordsPerFile", records).partitionBy("block_id").parquet(folder)


def stored(spark: SparkSession, folder: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """A stored log, or the blocks from ``first`` to ``last`` of it; others are not read."""
    log = spark.read.parquet(folder)
    if first is not None:
        log = log.where(F.col("block_id") >= first)
    if last is not None:
        log = log.where(F.col("block_id") <= last)
    return log


def scanned(spark: SparkSession, folder: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """``stored``, in order of record id across blocks, by range partitions."""
    return stored(spark, folder, first, last).orderBy("record_id")


def block_stats(log: DataFrame, records: int = BLOCK_RECORDS) -> DataFrame:
    """The block directory: records, ids and times of each block."""
    return in_blocks(log, records).groupBy("block_id").agg(
        F.count(F.lit(1)).alias("records"), F.min("record_id").alias("first_record"), F.max("record_id").alias("last_record"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"),
    )


def retained(log: DataFrame, now: Column, seconds: int = 86_400) -> DataFrame:
    """Records not older than ``seconds`` before ``now``."""
    return log.where(F.col("ts") >= now - F.make_dt_interval(secs=F.lit(seconds)))
