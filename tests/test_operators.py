import re
from datetime import datetime
from pathlib import Path

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from streamledger.functions import scalars
from streamledger.functions.types import CHARSETS, SOURCE_TYPES, spark_type
from streamledger.operators import cdc, filters, index, windows
from streamledger.plans import catalog
from streamledger.sources import changelog

CHANGE = "db string, tbl string, cp long, seq long, action string, name string, new_name string, type string, after string"


def _columns(spark, *changes):
    rows = [("d", "t", 0, 0, "create", "a", None, "int", None), ("d", "t", 0, 1, "create", "b", None, "string", None)]
    rows += [("d", "t", 10, k, *c) for k, c in enumerate(changes)]
    last = catalog.versions(spark.createDataFrame(rows, CHANGE)).orderBy(F.col("version").desc()).first()
    return None if last["columns"] is None else [(c["name"], c["type"]) for c in last["columns"]]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(keys=st.lists(st.integers(-5, 5), max_size=40))
def test_postings_equal_a_dict_of_lists(spark, keys):
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key int, record_id int")
    expected = {}
    for i, k in enumerate(keys):
        expected.setdefault(k, []).append(i)
    assert {r["key"]: r["record_ids"] for r in index.postings(rows, "key").collect()} == expected
    assert [r["key"] for r in index.keys_in_order(rows, "key").collect()] == sorted(expected)
    for value in (-6, 0, 6):
        below = [k for k in expected if k <= value]
        above = [k for k in expected if k >= value]
        assert [r["key"] for r in index.floor_of(rows, "key", value).collect()] == ([max(below)] if below else [])
        assert [r["key"] for r in index.ceiling_of(rows, "key", value).collect()] == ([min(above)] if above else [])


def test_schema_changes(spark):
    base = [("a", "int"), ("b", "string")]
    assert _columns(spark) == base
    assert _columns(spark, ("add", "c", None, "date", None)) == [*base, ("c", "date")]
    assert _columns(spark, ("add", "c", None, "date", "")) == [("c", "date"), *base]
    assert _columns(spark, ("add", "c", None, "date", "a")) == [base[0], ("c", "date"), base[1]]
    assert _columns(spark, ("modify", "A", None, "bigint", None)) == [("a", "bigint"), base[1]]
    assert _columns(spark, ("change", "a", "z", "bigint", None)) == [("z", "bigint"), base[1]]
    assert _columns(spark, ("drop", "B", None, None, None)) == [base[0]]
    assert _columns(spark, ("drop_table", None, None, None, None)) is None
    assert _columns(spark, ("drop_table", None, None, None, None), ("create", "n", None, "int", None)) == [("n", "int")]


def test_schema_changes_that_move_rename_or_miss(spark):
    assert _columns(spark, ("add", "c", None, "date", "A")) == [("a", "int"), ("c", "date"), ("b", "string")]
    assert _columns(spark, ("rename", "A", "z", None, None)) == [("z", "int"), ("b", "string")]
    assert _columns(spark, ("modify", "A", None, "bigint", "b")) == [("b", "string"), ("a", "bigint")]
    assert _columns(spark, ("change", "b", "y", "date", "")) == [("y", "date"), ("a", "int")]
    for change in (("add", "c", None, "date", "x"), ("drop", "x", None, None, None), ("rename", "x", "y", None, None), ("no such", "a", None, None, None)):
        with pytest.raises(Exception, match="no (column|action)"):
            _columns(spark, change)


def test_functions_by_name(spark):
    def spread(values: pd.Series) -> float:
        return float(values.max() - values.min())

    windows.create_function(spark, "spread", spread)
    spark.range(10).createOrReplaceTempView("tens")
    assert [r[0] for r in spark.sql("SELECT spread(id) FROM tens GROUP BY id % 2 ORDER BY id % 2").collect()] == [8.0, 8.0]
    windows.drop_function(spark, "spread")
    windows.drop_function(spark, "spread")
    assert not spark.catalog.functionExists("spread")


def test_epochs_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(cdc, "RANGE", 4)
    rows = [(i, "T" if i % 3 else "t", "DDL" if i % 5 == 0 else "INSERT") for i in range(40)] + [(50, None, "DDL")]
    found = cdc.ddl_epochs(spark.createDataFrame(rows, "record_id long, tbl string, op string")).collect()
    assert {r["record_id"]: r["epoch"] for r in found} == {i: 1 if t is None else sum(o == "DDL" and u is not None for j, u, o in rows if j <= i) for i, t, o in rows}


def test_ddl_records(spark):
    log = spark.createDataFrame([(1, "d", "DDL", "drop table t"), (2, "d", "INSERT", None)], "record_id long, db string, op string, ddl string")
    assert [tuple(r) for r in changelog.ddl(log).collect()] == [(1, "d", "drop table t")]


def test_timeline_is_half_open(spark):
    rows = spark.createDataFrame([("t", 1, 10), ("t", 2, 20), ("u", 1, 5)], "tbl string, version int, begin_cp long")
    found = catalog.timeline(rows, "tbl")
    at = lambda cp: sorted((r["tbl"], r["version"]) for r in catalog.valid_at(found, cp).collect())
    assert (at(4), at(10), at(19), at(20)) == ([], [("t", 1), ("u", 1)], [("t", 1), ("u", 1)], [("t", 2), ("u", 1)])
    assert sorted((r["tbl"], r["version"]) for r in catalog.purged(found, 20).collect()) == [("t", 2), ("u", 1)]


def test_charsets_of_databases(spark):
    tables = "db string, tbl string, cp long, charset string"
    databases = spark.createDataFrame([("D", 10, 0, "utf8"), ("d", 10, 1, "gbk"), ("d", 20, 0, None)], "db string, cp long, seq long, charset string")
    rows = [("d", "a", 9, None), ("d", "b", 10, None), ("D", "c", 19, None), ("d", "d", 20, None), ("d", "e", 15, "ascii"), (None, "f", 15, None), ("other", "g", 15, None)]
    found = catalog.with_charsets(spark.createDataFrame(rows, tables), databases, "latin1")
    assert found.columns == ["db", "tbl", "cp", "charset"]
    assert "".join(r["charset"][0] for r in found.orderBy("tbl").collect()) == "lgglall"
    assert catalog.with_charsets(spark.createDataFrame([], tables), databases, "latin1").count() == 0
    assert {r["charset"] for r in catalog.with_charsets(spark.createDataFrame(rows[:2], tables), databases.limit(0), "latin1").collect()} == {"latin1"}


def test_start_positions_and_images(spark, sf_dir):
    log = changelog.log_of_orders(spark.read.parquet(f"{sf_dir}/orders.parquet"))
    assert filters.start_from(log, record_id=100).agg(F.min("record_id")).first()[0] >= 100
    assert filters.start_from(log, timestamp=datetime(2100, 1, 1)).count() == 0
    update = log.where("op = 'UPDATE'").select(filters.old_value("s", 2).alias("old"), F.col("new.s").alias("new"), filters.changed_bits().alias("bits")).first()
    assert update["new"] == "U" and update["old"] != "U" and update["bits"] == 4


def test_stored_log_round_trip(spark, sf_dir, tmp_path):
    log = changelog.log_of_orders(spark.read.parquet(f"{sf_dir}/orders.parquet"))
    changelog.append(log, str(tmp_path / "log"), records=1024)
    assert changelog.stored(spark, str(tmp_path / "log")).count() == log.count()
    part = changelog.stored(spark, str(tmp_path / "log"), first=1, last=2)
    assert {r["block_id"] for r in part.select("block_id").distinct().collect()} == {1, 2}
    assert part.agg(F.min("record_id")).first()[0] >= 1024
    ordered = [r["record_id"] for r in changelog.scanned(spark, str(tmp_path / "log")).collect()]
    assert ordered == sorted(ordered)
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(block_id" in plan


def test_numbering_across_ranges(spark):
    rows = spark.range(0, 1000, 7).withColumnRenamed("id", "k")
    found = windows.numbered(rows, "k", width=16).orderBy("k").collect()
    assert [r["row_no"] for r in found] == list(range(len(found)))


def test_levels_follow_the_longest_chain(spark):
    waits = spark.createDataFrame([(2, 1), (3, 2), (4, 1), (4, 3)], "txn_id long, waits_for long")
    got = {r["txn_id"]: r["level"] for r in cdc.levels(spark.createDataFrame([(i,) for i in range(1, 6)], "txn_id long"), waits).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


@pytest.mark.parametrize("block", [1 << 18, 60])
def test_levels_of_long_chains_take_few_rounds(spark, monkeypatch, block):
    monkeypatch.setattr(cdc, "BLOCK", block)
    kept, cache = [], type(spark.range(1)).cache
    monkeypatch.setattr(type(spark.range(1)), "cache", lambda df: kept.append(df) or cache(df))
    # a chain, every third also waits for 1, some far back, one in no chain, one without an id
    waits = [(k, k - 1) for k in range(2, 121)] + [(k, 1) for k in range(3, 121, 3)] + [(k, k - 40) for k in range(41, 121, 7)] + [(500, 999), (77, None)]
    found = cdc.levels(spark.createDataFrame([(k,) for k in [*range(1, 121), 500, None]], "txn_id long"), spark.createDataFrame(waits, "txn_id long, waits_for long"))
    assert dict(found.collect()) == {k: k for k in range(1, 121)} | {500: 1, None: 1}
    # two tables for each round; a round for each link of the chain kept 240
    assert len(kept) < 30


def test_levels_take_no_round_for_each_part(spark, monkeypatch):
    frame, group = type(spark.range(1)), type(spark.range(1).groupBy("id"))
    rounds, dealt, each = [], frame.repartitionByRange, group.applyInArrow
    monkeypatch.setattr(frame, "repartitionByRange", lambda df, n, *by: dealt(df, max(n, 12), *by))
    monkeypatch.setattr(group, "applyInArrow", lambda of, *how: rounds.append(of) or each(of, *how))
    waits = spark.createDataFrame([(k, k - 1) for k in range(2, 61)], "txn_id long, waits_for long")
    assert dict(cdc.levels(spark.createDataFrame([(k,) for k in range(1, 61)], "txn_id long"), waits).collect()) == {k: k for k in range(1, 61)}
    # all of it fits one block; a block for each part took a round each
    assert len(rounds) == 1


@pytest.mark.parametrize("block", [1 << 18, 1])
def test_levels_refuse_a_circle_of_waits(spark, monkeypatch, block):
    monkeypatch.setattr(cdc, "BLOCK", block)
    waits = spark.createDataFrame([(1, 2), (2, 1)], "txn_id long, waits_for long")
    with pytest.raises(Exception, match="wait for one another"):
        cdc.levels(spark.createDataFrame([(1,), (2,)], "txn_id long"), waits).collect()


def test_last_writes_on_an_empty_log(spark):
    assert cdc.last_writes(spark.createDataFrame([], "key int, record_id int, op string")).count() == 0


def test_types_and_charsets():
    assert spark_type("bigint", unsigned=True) == "decimal(20,0)"
    assert spark_type("decimal", precision=40) == "string"
    assert spark_type("decimal", precision=12, scale=3) == "decimal(12,3)"
    assert spark_type("double") == "double"
    assert len(CHARSETS) == 41 and CHARSETS["utf8mb4"] == 4
    assert all(spark_type(t) for t in SOURCE_TYPES)


def test_version_comments(spark):
    text = "a /* x */ b /*!50100 c */ d /*!90000 e */\n\t f"
    row = spark.createDataFrame([(text,)], "s string").select(scalars.without_comments(F.col("s"), 80000).alias("s")).first()
    assert row["s"] == "a b c d f"
    quoted = spark.createDataFrame([("x  '/* it\\'s  */' /* gone */ `a  b`",)], "s string").select(scalars.without_comments(F.col("s"), 80000).alias("s")).first()
    assert quoted["s"] == "x '/* it\\'s  */' `a  b`"


def test_nothing_else_imports_the_training_data_operators():
    root = Path(__file__).resolve().parent.parent / "streamledger"
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"streamledger\.llm|import llm", path.read_text()), path
