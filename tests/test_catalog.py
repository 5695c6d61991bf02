"""Every query runs, and equals its SQL."""

import pytest

from corpusloom import catalog
from tests.conftest import same_rows


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    if name in catalog.ORACLES:
        same_rows(df, duck, catalog.ORACLES[name])
    else:
        rows = df.collect()
        assert rows and len(set(map(tuple, rows))) == len(rows) and all(v is not None for r in rows for v in r)


def test_entry_points(spark, sf):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())
