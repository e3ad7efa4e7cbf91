"""One session for all tests, the small tables, and a comparison of a query with its oracle."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb
import pytest

from quern.session import get_session
from quern.sources.tables import TABLES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = get_session("tests", "local[4]", spark__driver__memory="4g", spark__sql__shuffle__partitions="4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return DATA


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        at = Path(DATA) / f"{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}{'/*.parquet' if at.is_dir() else ''}'")
    return con


def rows_of(names, rows) -> list:
    order = sorted(range(len(names)), key=lambda i: names[i])
    tidy = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(tidy(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="session")
def against_oracle(spark, sf_dir, duck):
    def compare(name: str, query, sql: str) -> None:
        df = query(spark, sf_dir)
        cursor = duck.execute(sql)
        names = [x[0] for x in cursor.description]
        assert sorted(df.columns) == sorted(names)
        assert rows_of(df.columns, df.collect()) == rows_of(names, cursor.fetchall())

    return compare
