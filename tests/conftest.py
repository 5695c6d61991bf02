"""One local session for all tests."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from corpusloom.session import let_workers_import, local_session

    session = local_session(4, memory="6g", partitions=4)
    let_workers_import(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf() -> str:
    if not os.path.isdir(DATA):
        pytest.skip(f"no test tables in {DATA}")
    return DATA


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf}/{name}'")
    return con


def plain(value):
    """Nested values as comparable ones, floats to nine digits."""
    if isinstance(value, float):
        return "nan" if value != value else round(value, 9) + 0.0
    if hasattr(value, "asDict"):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return float(value) if type(value).__name__ == "Decimal" else value


def same_rows(df, con, sql: str) -> None:
    """Spark's rows are DuckDB's, whatever their order, columns by name."""
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    found = con.execute(sql)
    there = [d[0] for d in found.description]
    assert sorted(there) == names
    want = sorted((tuple(plain(row[there.index(c)]) for c in names) for row in found.fetchall()), key=repr)
    assert got == want
