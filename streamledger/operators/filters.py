"""Projection, filters and images over change logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def where_equal(df: DataFrame, **values) -> DataFrame:
    """Rows in which every named column equals its value."""
    return df.where(reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in values.items()], F.lit(True)))


def allowed_tables(log: DataFrame, tables: list[str]) -> DataFrame:
    """Records of the listed ``db.table`` names, without regard to case."""
    return log.where(F.lower(F.concat_ws(".", "db", "tbl")).isin(*[t.lower() for t in tables]))


def start_from(log: DataFrame, timestamp=None, offset: int | None = None, record_id: int | None = None) -> DataFrame:
    """Records from a time, a log offset or a record id on; over a stored log the bound reaches the scan."""
    if timestamp is not None:
        log = log.where(F.col("ts") >= F.lit(timestamp).cast(log.schema["ts"].dataType))
    if offset is not None:
        log = log.where(F.col("log_offset") >= offset)
    if record_id is not None:
        log = log.where(F.col("record_id") >= record_id)
    return log


def old_value(field: str, ordinal: int) -> Column:
    """A column's value before an UPDATE: from the old image if it changed, else from the new one."""
    return F.when(F.array_contains("changed", F.lit(ordinal)), F.col(f"old.{field}")).otherwise(F.col(f"new.{field}"))


def key_updated(ordinals: list[int]) -> Column:
    """Whether an UPDATE changed any of a key's columns."""
    return F.arrays_overlap("changed", F.array(*[F.lit(i) for i in ordinals]))


def changed_bits(width: int = 64) -> Column:
    """The changed ordinals as a bitmap."""
    return F.aggregate("changed", F.lit(0).cast("long"), lambda a, i: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))


def without_heartbeats(log: DataFrame) -> DataFrame:
    return log.where("op <> 'HEARTBEAT'")


def committed(log: DataFrame) -> DataFrame:
    """Row changes of transactions that were committed."""
    done = log.where("op = 'COMMIT'").select("txn_id").distinct()
    return log.where(F.col("op").isin("INSERT", "UPDATE", "DELETE", "REPLACE")).join(done, "txn_id", "left_semi")
