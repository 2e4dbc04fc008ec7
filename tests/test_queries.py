"""Every query of the library against DuckDB on the same tables."""

import duckdb
import pytest

from streamledger.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _plain(value):
    return round(value, 4) if isinstance(value, float) else str(value)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(_plain(r[c]) for c in columns) for r in df.collect())
    found = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(_plain(r[names.index(c)]) for c in columns) for r in found.fetchall())


def test_levels_count_every_change(spark, tmp_path):
    # views and purchases chain transactions as well as errors do, and transactions without errors have a level
    rows = [(5, 1, "view"), (1005, 1, "purchase"), (2005, 1, "error"), (2006, 2, "error"), (3005, 2, "signup"), (4005, 3, "click"), (5005, None, "view"), (6005, None, "view"), (-5, 4, "view")]
    path = str(tmp_path / "events.parquet")
    rows = ", ".join(f"({i}, TIMESTAMP '2024-01-01', {'NULL' if user is None else user}, '{kind}', 1.0, '{{}}')" for i, user, kind in rows)
    connection = duckdb.connect()
    connection.execute(f"COPY (SELECT event_id::BIGINT AS event_id, ts, user_id::BIGINT AS user_id, event_type, value::DOUBLE AS value, props FROM (VALUES {rows}) t(event_id, ts, user_id, event_type, value, props)) TO '{path}'")
    connection.execute(f"CREATE VIEW events AS SELECT * FROM '{path}'")
    got = {r["txn_id"]: r["level"] for r in QUERIES["txn_levels"](spark, str(tmp_path)).collect()}
    assert got == {0: 1, 1: 2, 2: 3, 3: 4, 4: 1, 5: 1, 6: 2}
    assert got == dict(connection.execute(ORACLE_SQL["txn_levels"]).fetchall())
