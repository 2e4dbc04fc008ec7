"""Tumbling windows by time and by rows, and row numbers without a single task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Width, in key values, of the ranges whose rows are numbered together.
RANGE = 1 << 16


def time_windows(df: DataFrame, size: str, *groups: str, aggregates: list[Column], time: str = "ts") -> DataFrame:
    """Aggregates by tumbling window; batch and stream alike."""
    grouped = df.groupBy(F.window(time, size).alias("w"), *groups).agg(*aggregates)
    return grouped.withColumn("window_start", F.col("w.start")).drop("w")


def numbered(df: DataFrame, key: str, name: str = "row_no", width: int = RANGE) -> DataFrame:
    """Rows numbered from 0 by an integral ``key``.

    Ranges of the key are counted first; their offsets are summed in ranges of ranges,
    so no window spans all rows. Rows with equal keys get consecutive numbers in no
    particular order.
    """
    ranged = df.withColumn("_range", F.call_function("div", F.col(key), F.lit(width)))
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_outer", F.call_function("div", F.col("_range"), F.lit(width)))
    outer = counts.groupBy("_outer").agg(F.sum("_n").alias("_m"))
    before = Window.orderBy("_outer").rowsBetween(Window.unboundedPreceding, -1)
    outer = outer.select("_outer", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_outer").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.join(outer, "_outer").select("_range", (F.col("_base") + F.coalesce(F.sum("_n").over(inside), F.lit(0))).alias("_offset"))
    own = Window.partitionBy("_range").orderBy(key)
    return ranged.join(offsets, "_range").withColumn(name, F.col("_offset") + F.row_number().over(own) - 1).drop("_range", "_offset")


def row_windows(df: DataFrame, key: str, rows: int, *aggregates: Column) -> DataFrame:
    """Aggregates by tumbling window of ``rows`` rows in key order."""
    return numbered(df, key).groupBy(F.call_function("div", F.col("row_no"), F.lit(rows)).alias("window_no")).agg(*aggregates)


def create_function(spark: SparkSession, name: str, function: Callable, returns: str = "double") -> None:
    """Make ``function(values: pd.Series) -> value`` an aggregate that windows and SQL call by ``name``."""
    spark.udf.register(name, F.pandas_udf(function, returns))


def drop_function(spark: SparkSession, name: str) -> None:
    """Drop an aggregate made by ``create_function``; without one of the name, nothing happens."""
    spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS `{name}`")
