"""Ordered merges and unions of several logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def union_of(*logs: DataFrame) -> DataFrame:
    """All records of several sources with the same columns."""
    return reduce(lambda a, b: a.unionByName(b), logs)


def merged(*logs: DataFrame, by: list[str]) -> DataFrame:
    """All records of several sources in one order, by range partitions."""
    return union_of(*logs).orderBy(*by)
