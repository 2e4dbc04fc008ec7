"""Scalar helpers with observable meaning: table ids, names, key hashes, comments, DDL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def table_of(table_id: Column) -> Column:
    """The table number: the upper 48 bits of a table id."""
    return F.shiftright(table_id, 16)


def version_of(table_id: Column) -> Column:
    """The schema version: the lower 16 bits of a table id."""
    return table_id.bitwiseAND(65535).cast("int")


def table_id(table: Column, version: Column) -> Column:
    return F.shiftleft(table.cast("long"), 16).bitwiseOR(version.cast("long"))


def same_name(a: Column, b: Column) -> Column:
    """Equality of database and table names, without regard to case."""
    return F.lower(a) == F.lower(b)


def key_hash(*columns: str | Column) -> Column:
    """One 64-bit hash for a key of one or more columns, chained in order."""
    return F.xxhash64(*columns)


def nearly(a: Column, b: Column, epsilon: float) -> Column:
    """Equality of floating-point keys within a tolerance."""
    return F.abs(a - b) <= epsilon


def without_comments(sql: Column, version: int) -> Column:
    """Statement text with the body of ``/*!NNNNN ... */`` kept if NNNNN is at most ``version``, without other comments, blanks joined."""
    quoted = r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`"
    pieces = F.regexp_extract_all(sql, F.lit(rf"(?s){quoted}|/\*.*?\*/|[^'\"`/]+|."), F.lit(0))
    number = lambda p: F.regexp_extract(p, r"^/\*!(\d{5,6})", 1)
    body = lambda p: F.regexp_extract(p, r"(?s)^/\*!\d{5,6}(.*)\*/$", 1)
    kept = F.transform(
        pieces,
        lambda p: F.when(number(p) != "", F.when(F.try_to_number(F.lpad(number(p), 6, "0"), F.lit("000000")) <= version, F.concat(F.lit(" "), body(p), F.lit(" "))).otherwise(F.lit(" ")))
        .when(p.startswith("/*"), F.lit(" "))
        .otherwise(p),
    )
    # blanks are joined outside quotes only
    parts = F.regexp_extract_all(F.array_join(kept, ""), F.lit(rf"(?s){quoted}|\s+|[^'\"`\s]+|."), F.lit(0))
    return F.trim(F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\s"), F.lit(" ")).otherwise(p)), ""))


def column_ddl(columns: DataFrame) -> DataFrame:
    """``columns(tbl, ordinal, name, source_type, size, decimals, unsigned, not_null, charset, is_primary)`` with ``ddl``, the column's definition."""
    size = F.when(F.col("size").isNotNull(), F.concat(F.lit("("), F.col("size").cast("string"), F.when(F.col("decimals").isNotNull(), F.concat(F.lit(","), F.col("decimals").cast("string"))).otherwise(""), F.lit(")"))).otherwise("")
    parts = F.concat(
        F.lit("`"), F.col("name"), F.lit("` "), F.col("source_type"), size,
        F.when(F.col("unsigned"), " UNSIGNED").otherwise(""),
        F.when(F.col("charset").isNotNull(), F.concat(F.lit(" CHARACTER SET "), F.col("charset"))).otherwise(""),
        F.when(F.col("not_null"), " NOT NULL").otherwise(""),
    )
    return columns.withColumn("ddl", parts)


def table_ddl(columns: DataFrame) -> DataFrame:
    """``tbl, ddl``: one CREATE TABLE statement for each table, columns in order, then its primary key."""
    own = column_ddl(columns).groupBy("tbl").agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "ddl"))).alias("c"),
        F.array_sort(F.collect_list(F.when(F.col("is_primary"), F.struct("ordinal", "name")))).alias("k"),
    )
    key = F.when(F.size("k") > 0, F.concat(F.lit(", PRIMARY KEY ("), F.array_join(F.transform("k", lambda x: F.concat(F.lit("`"), x["name"], F.lit("`"))), ", "), F.lit(")"))).otherwise("")
    return own.select("tbl", F.concat(F.lit("CREATE TABLE `"), F.col("tbl"), F.lit("` ("), F.array_join(F.col("c.ddl"), ", "), key, F.lit(")")).alias("ddl"))
