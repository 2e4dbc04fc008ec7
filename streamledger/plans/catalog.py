"""The schema catalog: schema changes as rows, folded to versions, with their times of validity.

A change is a row ``db, tbl, cp, seq, action, name, new_name, type, after``: at checkpoint ``cp`` the
``action`` applies to the table. A ``create`` row stands for each column; ``add``, ``drop``, ``modify``,
``change`` and ``rename`` are for columns; ``after`` is null to append (of ``modify`` and ``change``: to
stay), ``''`` to put first, else the name of the column before. ``add_key`` adds the key ``name`` over the
columns listed in ``type``, with commas; ``drop_key`` drops it; ``drop_table`` ends the table. Names are
compared without regard to case, and a change of a column that is absent is an error. Statement text
is not read here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = 9_223_372_036_854_775_807
COLUMN = "struct<name:string,type:string>"
KEY = "struct<name:string,parts:array<string>>"


def _put(columns: str, column: str) -> str:
    """SQL for ``columns`` with ``column`` at the place that ``a.after`` tells."""
    at = f"array_position(transform({columns}, c -> lower(c.name)), lower(a.after))"
    found = f"if({at} > 0, cast({at} as int), cast(raise_error(concat('no column ', a.after)) as int))"
    return f"case when a.after is null then array_append({columns}, {column}) when a.after = '' then array_prepend({columns}, {column}) else array_insert({columns}, {found} + 1, {column}) end"


def versions(changes: DataFrame) -> DataFrame:
    """``db, tbl, version, begin_cp, columns, keys``: columns and keys after each checkpoint at which a table changed.

    A table's changes are folded in order of checkpoint and of ``seq`` within it. Null
    ``columns`` mean that the table is gone. A dropped column leaves its keys, and a key
    without columns goes; a renamed one keeps its place in them.
    """
    action = F.struct("cp", "seq", "action", "name", "new_name", "type", "after")
    tables = changes.groupBy("db", "tbl").agg(F.array_sort(F.collect_list(action)).alias("actions"))
    is_it, own = "lower(c.name) = lower(a.name)", "named_struct('name', coalesce(a.new_name, a.name), 'type', a.type)"
    others, kept = "filter(s.columns, c -> lower(c.name) <> lower(a.name))", f"named_struct('name', element_at(filter(s.columns, c -> {is_it}), 1).name, 'type', a.type)"
    present = f"if(exists(s.columns, c -> {is_it}), s.columns, cast(raise_error(concat('no column ', a.name)) as array<{COLUMN}>))"
    columns = f"""
        case a.action
          when 'create' then array_append(coalesce(s.columns, array()), {own})
          when 'add' then {_put("s.columns", own)}
          when 'drop' then filter({present}, c -> not {is_it})
          when 'rename' then transform({present}, c -> if({is_it}, named_struct('name', a.new_name, 'type', c.type), c))
          when 'modify' then if(a.after is null, transform({present}, c -> if({is_it}, named_struct('name', c.name, 'type', a.type), c)), {_put(others, kept)})
          when 'change' then if(a.after is null, transform({present}, c -> if({is_it}, {own}, c)), {_put(others, own)})
          when 'drop_table' then cast(null as array<{COLUMN}>)
          when 'add_key' then s.columns
          when 'drop_key' then s.columns
          else cast(raise_error(concat('no action ', a.action)) as array<{COLUMN}>) end"""
    parts = lambda part: f"filter(transform(s.keys, k -> named_struct('name', k.name, 'parts', {part})), k -> size(k.parts) > 0)"
    keys = f"""
        case a.action
          when 'add_key' then array_append(s.keys, named_struct('name', a.name, 'parts', transform(split(a.type, ','), p -> trim(p))))
          when 'drop_key' then filter(s.keys, k -> lower(k.name) <> lower(a.name))
          when 'drop' then {parts("filter(k.parts, p -> lower(p) <> lower(a.name))")}
          when 'rename' then {parts("transform(k.parts, p -> if(lower(p) = lower(a.name), a.new_name, p))")}
          when 'change' then {parts("transform(k.parts, p -> if(lower(p) = lower(a.name), coalesce(a.new_name, p), p))")}
          when 'drop_table' then cast(array() as array<{KEY}>)
          else s.keys end"""
    folded = F.expr(f"""
        aggregate(actions,
          named_struct('columns', cast(null as array<{COLUMN}>), 'keys', cast(array() as array<{KEY}>), 'seen', cast(array() as array<struct<cp:bigint,columns:array<{COLUMN}>,keys:array<{KEY}>>>)),
          (s, a) -> transform(array(named_struct('columns', {columns}, 'keys', {keys})),
            now -> named_struct('columns', now.columns, 'keys', now.keys, 'seen', array_append(s.seen, named_struct('cp', a.cp, 'columns', now.columns, 'keys', now.keys))))[0],
          s -> s.seen)
    """)
    steps = tables.select("db", "tbl", F.posexplode(folded).alias("at", "v")).select("db", "tbl", "at", F.col("v.cp").alias("begin_cp"), F.col("v.columns").alias("columns"), F.col("v.keys").alias("keys"))
    # what stands after the last change at a checkpoint is the version
    last = steps.groupBy("db", "tbl", "begin_cp").agg(F.max_by("columns", "at").alias("columns"), F.max_by("keys", "at").alias("keys"))
    order = Window.partitionBy("db", "tbl").orderBy("begin_cp")
    return last.withColumn("version", F.row_number().over(order))


def timeline(changed: DataFrame, *table: str) -> DataFrame:
    """With ``end_cp``: a version ends where the next one of its table begins."""
    order = Window.partitionBy(*table).orderBy("begin_cp")
    return changed.withColumn("end_cp", F.coalesce(F.lead("begin_cp").over(order), F.lit(END)))


def valid_at(catalog: DataFrame, cp: int) -> DataFrame:
    """The versions valid at a checkpoint."""
    return catalog.where((F.col("begin_cp") <= cp) & (F.col("end_cp") > cp))


def purged(catalog: DataFrame, cp: int) -> DataFrame:
    """The versions that have not ended at or before a checkpoint."""
    return catalog.where(F.col("end_cp") > cp)


def with_charsets(tables: DataFrame, databases: DataFrame, default: str) -> DataFrame:
    """``tables(db, tbl, cp, charset, ...)``: where ``charset`` is null, that of the table's database when the table was made.

    ``databases(db, cp, seq, charset)`` holds a row for each time that a database was made, altered
    or dropped; without a charset in it, or before the first, ``default`` holds. Later changes of a
    database leave its tables as they are. Names are compared without regard to case.
    """
    last = databases.groupBy(F.lower("db").alias("db"), F.col("cp").alias("begin_cp")).agg(F.max_by("charset", "seq").alias("_charset"))
    found = with_schema(tables, timeline(last, "db"), F.col("cp"), ["db"])
    return found.withColumn("charset", F.coalesce("charset", "_charset", F.lit(default))).select(*tables.columns)


def with_schema(log: DataFrame, catalog: DataFrame, cp: Column, keys: list[str]) -> DataFrame:
    """Each record with the version of its table that is valid at its checkpoint; without one, nulls.

    The join is on the table's keys; the range narrows it to one version.
    """
    right = catalog.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in catalog.columns if c not in keys])
    on = [F.lower(k) == F.lower(f"_{k}") for k in keys] + [F.col("begin_cp") <= cp, cp < F.col("end_cp")]
    condition = on[0]
    for c in on[1:]:
        condition &= c
    return log.join(right, condition, "left").drop(*[f"_{k}" for k in keys])
