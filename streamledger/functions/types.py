"""Column types and character sets of change-log sources, as tables and column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: source column types, whether they can be unsigned, and the Spark types of either sign
SOURCE_TYPES = {
    "BIT": ("binary", None),
    "TINYINT": ("tinyint", "smallint"),
    "BOOLEAN": ("tinyint", None),
    "SMALLINT": ("smallint", "int"),
    "MEDIUMINT": ("int", "int"),
    "INT": ("int", "bigint"),
    "BIGINT": ("bigint", "decimal(20,0)"),
    "FLOAT": ("float", "float"),
    "DOUBLE": ("double", "double"),
    "DATE": ("date", None),
    "DATETIME": ("timestamp_ntz", None),
    "TIMESTAMP": ("timestamp", None),
    "TIME": ("interval day to second", None),
    "YEAR": ("smallint", None),
    "CHAR": ("string", None),
    "VARCHAR": ("string", None),
    "BINARY": ("binary", None),
    "VARBINARY": ("binary", None),
    "TINYBLOB": ("binary", None),
    "BLOB": ("binary", None),
    "MEDIUMBLOB": ("binary", None),
    "LONGBLOB": ("binary", None),
    "TINYTEXT": ("string", None),
    "TEXT": ("string", None),
    "MEDIUMTEXT": ("string", None),
    "LONGTEXT": ("string", None),
    "ENUM": ("string", None),
    "SET": ("array<string>", None),
    "GEOMETRY": ("binary", None),
    "JSON": ("string", None),
}

# fixed values: character sets and the bytes of their longest character
CHARSETS = {
    "big5": 2, "dec8": 1, "cp850": 1, "hp8": 1, "koi8r": 1, "latin1": 1, "latin2": 1, "swe7": 1, "ascii": 1, "ujis": 3,
    "sjis": 2, "hebrew": 1, "tis620": 1, "euckr": 2, "koi8u": 1, "gb2312": 2, "greek": 1, "cp1250": 1, "gbk": 2, "latin5": 1,
    "armscii8": 1, "utf8": 3, "ucs2": 2, "cp866": 1, "keybcs2": 1, "macce": 1, "macroman": 1, "cp852": 1, "latin7": 1,
    "utf8mb4": 4, "cp1251": 1, "utf16": 4, "utf16le": 4, "cp1256": 1, "cp1257": 1, "utf32": 4, "binary": 1, "geostd8": 1,
    "cp932": 2, "eucjpms": 3, "gb18030": 4,
}


def spark_type(source_type: str, unsigned: bool = False, precision: int = 10, scale: int = 0) -> str:
    """The Spark type for a source column; decimals beyond 38 digits become strings."""
    if source_type.upper() in ("DECIMAL", "NUMERIC"):
        return f"decimal({precision},{scale})" if precision <= 38 else "string"
    signed, other = SOURCE_TYPES[source_type.upper()]
    return other if unsigned and other else signed


def charsets(spark: SparkSession) -> DataFrame:
    """``charset, max_bytes``; one row for each of a fixed list."""
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("charset"), F.lit(v).alias("max_bytes")) for k, v in CHARSETS.items()]))
    return spark.range(1).select(rows.alias("c")).select("c.*")


def column_bytes(size: Column, charset: Column, table_charset: Column, database_charset: Column) -> Column:
    """Bytes that a text column may take: its characters by its charset, else its table's, else its database's."""
    known = F.create_map(*[F.lit(x) for kv in CHARSETS.items() for x in kv])
    return size * known[F.lower(F.coalesce(charset, table_charset, database_charset))]
