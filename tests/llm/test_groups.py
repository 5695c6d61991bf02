import random

import numpy as np
import pytest

from corpusloom.llm.groups import consolidate
from corpusloom.operators import components
from corpusloom.operators.components import connected, union_find
from tests.llm.conftest import linked


def test_union_find():
    rng = np.random.default_rng(1)
    for n in (1, 5, 200):
        u, v = rng.integers(0, n, n), rng.integers(0, n, n)
        got = dict(zip(*(x.tolist() for x in union_find(u, v))))
        assert got == {**{x: x for x in got}, **linked(list(zip(u.tolist(), v.tolist())))}


@pytest.mark.parametrize("shape", ["random", "chain", "hub", "empty"])
def test_connected(spark, scratch, monkeypatch, shape):
    monkeypatch.setattr(components, "CELL_EDGES", 40)  # many cells, several rounds
    rng = random.Random(2)
    edges = {
        "random": [(rng.randrange(400), rng.randrange(400)) for _ in range(300)],
        "chain": [(i, i + 1) for i in range(200)],
        "hub": [(0, i) for i in range(300)] * 2,
        "empty": [],
    }[shape]
    df = spark.createDataFrame([*edges, (7, 7), (None, 3), (4, None)], "u bigint, v bigint")
    assert dict(map(tuple, connected(df, scratch).collect())) == linked([e for e in edges if e[0] != e[1]])


def test_consolidate(spark, scratch):
    manifest = [(i, "x") for i in ("s/A/1.jpg", "s/A/2.jpg", "t/b/3.jpg", "t/b/4.jpeg", "o/5.jpg", "o/6.jpg", "o/6.jpg", None)]
    pairs = [
        (r".\S\a\1.JPG", "s/A/2.jpg\n", 3, 1), ("s/A/2.jpg", "data/raw/t//b/3.jpg", 10, 1), ("t/b/3.jpg", "T/B/4.jpeg", 11, 1), ("t/b/4.jpeg", "gone", 0, 1), ("gone", "o/5.jpg", 0, 1),
        ("o/5.jpg", "O/5.JPG", 0, 1), ("o/5.jpg", "o/6.jpg", None, 1), ("o/5.jpg", "o/6.jpg", -1, 1), (None, "o/6.jpg", 0, 1), ("s/A/2.jpg", "s/A/1.jpg", 3, 1),
    ]
    known = spark.createDataFrame(manifest, "image_id string, hamming string")  # a clashing extra column
    found = consolidate(spark.createDataFrame(pairs, "id_a string, id_b string, hamming int, image_id int"), known, scratch)
    assert dict(map(tuple, found.collect())) == {"s/A/1.jpg": "s/A/1.jpg", "s/A/2.jpg": "s/A/1.jpg", "t/b/3.jpg": "s/A/1.jpg"}
    for p, k in ((pairs[:0], manifest), (pairs, manifest[:0])):
        df = consolidate(spark.createDataFrame(p, "id_a string, id_b string, hamming int, image_id int"), spark.createDataFrame(k, "image_id string, hamming string"), scratch)
        assert df.count() == 0 and df.columns == ["image_id", "group_id"]
