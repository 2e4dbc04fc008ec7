"""Key indexes over change logs: postings, lookups and ordered scans.

An index is a table ``key..., record_id``; sorting and file statistics do what a tree
would. Posting lists are gathered only where they are the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entries(changes: DataFrame, new_key: Column, old_key: Column) -> DataFrame:
    """``key, record_id``: an INSERT indexes its new key, a DELETE its old one, others both if they differ."""
    keys = (
        F.when(F.col("op") == "INSERT", F.array(new_key))
        .when(F.col("op") == "DELETE", F.array(old_key))
        .otherwise(F.array_distinct(F.array(new_key, F.coalesce(old_key, new_key))))
    )
    return changes.select(F.explode(keys).alias("key"), "record_id")


def postings(index: DataFrame, *key: str) -> DataFrame:
    """Each key with its record ids in order, as an array."""
    return index.groupBy(*key).agg(F.array_sort(F.collect_list("record_id")).alias("record_ids"))


def summary(index: DataFrame, *key: str) -> DataFrame:
    """Each key with how many records it has, and its first and last one; no list is gathered."""
    return index.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("record_id").alias("first_record"), F.max("record_id").alias("last_record"))


def seek(index: DataFrame, **key) -> DataFrame:
    """The entries of one key."""
    for name, value in key.items():
        index = index.where(F.col(name) == F.lit(value))
    return index


def keys_in_order(index: DataFrame, *key: str) -> DataFrame:
    return index.select(*key).distinct().orderBy(*key)


def floor_of(index: DataFrame, key: str, value) -> DataFrame:
    """The largest key not above ``value``; one row, from one pass with partial maxima."""
    return index.where(F.col(key) <= F.lit(value)).agg(F.max(key).alias(key)).where(F.col(key).isNotNull())


def ceiling_of(index: DataFrame, key: str, value) -> DataFrame:
    """The smallest key not below ``value``."""
    return index.where(F.col(key) >= F.lit(value)).agg(F.min(key).alias(key)).where(F.col(key).isNotNull())


def ends(index: DataFrame, key: str) -> DataFrame:
    """The first and the last key."""
    return index.agg(F.min(key).alias("first_key"), F.max(key).alias("last_key"))


def records_of(log: DataFrame, index: DataFrame) -> DataFrame:
    """The records that an index lists."""
    return log.join(index.select("record_id").distinct(), "record_id", "left_semi")
