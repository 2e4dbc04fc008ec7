"""Applying change logs: last writes, key conflicts between transactions, and their levels."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Record ids in one range, within which a table's schema changes are counted one by one.
RANGE = 1 << 16
#: Waits and transactions in one block, within which levels are found in one go.
BLOCK = 1 << 18


def last_writes(log: DataFrame, key: str = "key", order: str = "record_id") -> DataFrame:
    """The state after the log: each key's last record, unless it is a DELETE.

    One aggregation with partial results on the map side, so a key with many records weighs little.
    """
    last = log.groupBy(key).agg(F.max_by(F.struct(*[c for c in log.columns if c != key]), order).alias("r"))
    return last.select(key, "r.*").where("op <> 'DELETE'")


def key_hashes(changes: DataFrame, new_key: Column, old_key: Column, name: str = "primary") -> DataFrame:
    """``txn_id, record_id, key_name, key_hash``: one row for each key that a change touches, from both images, equal ones once."""
    hashes = F.array_distinct(F.filter(F.array(F.when(new_key.isNotNull(), F.xxhash64(new_key)), F.when(old_key.isNotNull(), F.xxhash64(old_key))), lambda h: h.isNotNull()))
    return changes.select("txn_id", "record_id", F.lit(name).alias("key_name"), F.explode(hashes).alias("key_hash"))


def touched(changes: DataFrame, key: Column) -> DataFrame:
    """``txn_id, record_id, key``: what each change waits on; without a key, all changes of a table wait on one another."""
    return changes.select("txn_id", "record_id", F.coalesce(key.cast("string"), F.concat(F.lit("no key of "), F.col("tbl"))).alias("key"))


def blocked(touches: DataFrame) -> DataFrame:
    """With ``is_blocked``: whether another transaction touches the key before."""
    # the transaction at the head of a key's queue runs, with all its records; found by an aggregation,
    # so a key that most records touch is not gathered in one task
    heads = touches.groupBy("key").agg(F.min_by("txn_id", "record_id").alias("head"))
    return touches.join(heads, "key").withColumn("is_blocked", (F.col("head") != F.col("txn_id")).cast("int")).drop("head")


def blocking_counts(touches: DataFrame) -> DataFrame:
    """``txn_id, blocking``: how many of a transaction's records wait; it is runnable at 0."""
    return blocked(touches).groupBy("txn_id").agg(F.sum("is_blocked").cast("long").alias("blocking"))


def ddl_epochs(log: DataFrame) -> DataFrame:
    """With ``epoch``: how many schema changes of its table stand at or before a record."""
    # counted by range of ids first, so that no window spans all of a table's records
    ranged = log.withColumns({"_tbl": F.lower("tbl"), "_range": F.call_function("div", F.col("record_id"), F.lit(RANGE))})
    counts = ranged.groupBy("_tbl", "_range").agg(F.count_if(F.col("op") == "DDL").alias("_n"))
    before = Window.partitionBy("_tbl").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("_tbl").alias("_of"), F.col("_range").alias("_in"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("_tbl", "_range").orderBy("record_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = ranged.withColumn("_epoch", F.count_if(F.col("op") == "DDL").over(own))
    found = found.join(counts, F.col("_tbl").eqNullSafe(F.col("_of")) & (F.col("_range") == F.col("_in")))
    return found.select(*log.columns, (F.col("_epoch") + F.col("_before")).alias("epoch"))


def dependencies(touches: DataFrame) -> DataFrame:
    """``txn_id, waits_for``: each transaction and the one that touched a key of it last before."""
    order = Window.partitionBy("key").orderBy("record_id")
    pairs = touches.withColumn("waits_for", F.lag("txn_id").over(order))
    return pairs.where("waits_for is not null and waits_for <> txn_id").select("txn_id", "waits_for").distinct()


def levels(transactions: DataFrame, waits: DataFrame) -> DataFrame:
    """``txn_id, level``: transactions of one level can run together, after those of all levels below.

    A level is the longest chain of waits. Transactions are dealt by ranges of ids over
    blocks of about ``BLOCK`` waits. Each round raises all that follows within a block at
    once, and hands what rose to the blocks that wait for it; so there are as many rounds
    as the longest chain changes blocks: where later ids wait for earlier ones, at most one
    for each block. The rounds' tables are written to the shared folder, so a lost executor
    costs no more than its tasks. Transactions that wait for one another are an error.
    """
    spark = transactions.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)

    def kept(df: DataFrame) -> DataFrame:
        if folder is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            return df.cache()
        path = f"{folder.rstrip('/')}/levels-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    own = transactions.select("txn_id", F.lit(None).cast(waits.schema["waits_for"].dataType).alias("waits_for")).distinct()
    rows = kept(own.unionByName(waits.select("txn_id", "waits_for").where("waits_for is not null")))
    count, parts = rows.where("waits_for is null").count(), -(-rows.count() // BLOCK)
    # ranges keep all rows of a transaction together; neighbours make a block, however many parts there are
    dealt = kept(rows.repartitionByRange(max(1, parts), "txn_id").withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    blocks = blocks.select("part", F.call_function("div", F.col("before"), F.lit(BLOCK)).cast("int").alias("block"))
    dealt = dealt.join(F.broadcast(blocks), "part").drop("part")
    own = dealt.where("waits_for is null").select("txn_id", "block")
    sides = dealt.where("waits_for is not null").join(own.select(F.col("txn_id").alias("waits_for"), F.col("block").alias("of")), "waits_for")
    inner = kept(sides.where("block = of").groupBy("txn_id").agg(F.collect_list("waits_for").alias("waits")))
    across = kept(sides.where("block <> of").select("txn_id", "waits_for"))
    schema = f"block int, txn_id {own.schema['txn_id'].dataType.simpleString()}, level int, rose boolean"
    given, still = own.withColumns({"level": F.lit(0), "reached": F.lit(1)}), None
    while True:
        # one block is one group, and of bounded size
        level = given.join(inner, "txn_id", "left").select("block", "txn_id", "level", "reached", "waits").groupBy("block").applyInArrow(_raised, schema)
        level = kept(level if still is None else level.unionByName(still))
        rose = level.where("rose").select(F.col("txn_id").alias("waits_for"), F.col("level").alias("before"))
        least = across.join(rose, "waits_for").groupBy("txn_id").agg((F.max("before") + 1).alias("reached"))
        more = kept(level.join(least, "txn_id").where("reached > level").select("block", "txn_id", "reached"))
        top = more.agg(F.max("reached")).first()[0]
        if top is None:
            return level.select("txn_id", "level")
        if top > count:
            raise ValueError("transactions wait for one another")
        changed = F.broadcast(more.select("block").distinct())
        still = level.join(changed, "block", "left_anti").withColumn("rose", F.lit(False))
        given = level.join(changed, "block", "left_semi").join(more.select("txn_id", "reached"), "txn_id", "left")
        given = given.select("block", "txn_id", "level", F.coalesce("reached", "level").alias("reached"))


def _raised(block: pa.Table) -> pa.Table:
    """``block, txn_id, level, rose``: the levels of one block, from those ``reached``, along the waits within it."""
    txns, before, level = (block[c].to_pylist() for c in ("txn_id", "level", "reached"))
    waits = [w or () for w in block["waits"].to_pylist()]
    place, left, after = {t: k for k, t in enumerate(txns)}, [len(w) for w in waits], [[] for _ in txns]
    for k, w in enumerate(waits):
        for t in w:
            after[place[t]].append(k)
    ready = [k for k, n in enumerate(left) if n == 0]
    for k in ready:
        for follower in after[k]:
            level[follower], left[follower] = max(level[follower], level[k] + 1), left[follower] - 1
            if left[follower] == 0:
                ready.append(follower)
    if len(ready) < len(txns):
        raise ValueError("transactions wait for one another")
    rose = [now > old for now, old in zip(level, before, strict=True)]
    return pa.table({"block": block["block"], "txn_id": block["txn_id"], "level": pa.array(level, pa.int32()), "rose": rose})
