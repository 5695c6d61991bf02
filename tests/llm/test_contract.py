"""The pN_ queries over the smallest tables: columns, SQL, and the shape of the package."""

import pytest

from corpusloom import llm
from tests.conftest import same_rows

COLUMNS = {
    "p1_found": ["image_id", "group_id"],
    "p2_found": ["image_id", "cluster_id"],
    "p3_found": ["label_id", "breed_id"],
    "p4_found": ["id_a", "id_b"],
    "p5_found": ["dedup_group"],
    "p6_found": ["md5", "rec_id"],
    "p7_ids": ["doc_id", "ids"],
    "p9_found": ["doc_a", "doc_b"],
}


# Rows of p5_splits repeat with the rows of the manifest, and a scan's record may have no breed.
REPEATS, NULLS = {"p5_splits"}, set()


@pytest.mark.parametrize("name", list(llm.queries()))
def test_query(spark, sf, duck, name):
    df = llm.queries()[name](spark, sf)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
    if name in llm.oracles():
        same_rows(df, duck, llm.oracles()[name])
    else:
        rows = df.collect()
        assert rows and len(set(map(repr, rows))) == len(rows) or name in REPEATS
        assert all(any(r[c] is not None for r in rows) for c in df.columns if c not in NULLS)


def test_every_problem_has_a_query():
    assert {n.split("_")[0] for n in llm.queries()} == {f"p{i}" for i in range(1, 10)}
