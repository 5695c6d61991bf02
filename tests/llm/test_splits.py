import random

import pandas as pd
import pytest

from corpusloom.llm.splits import allocate, assign, leaking, propagate, regroup
from tests.llm.conftest import linked

TARGETS = [("train", 0.7), ("val", 0.15), ("test", 0.15)]
COLUMNS = "rec_id bigint, image_id string, dedup_group string, split string, canonical_breed string, label int"


def test_allocate():
    got = allocate(pd.DataFrame({"size": [1, 50, 3], "sets": [100, 1, 10]}), [126, 27, 27])
    assert list(got["size"]) == [50, 3, 1] and (got[["s0", "s1", "s2"]].sum(axis=1) == got["sets"]).all()
    rows = [(got[f"s{j}"] * got["size"]).sum() for j in range(3)]
    assert rows == [126, 27, 27]
    assert allocate(pd.DataFrame({"size": [10], "sets": [1]}), [1.0, 5.0, 2.0])[["s0", "s1", "s2"]].to_numpy().tolist() == [[0, 1, 0]]


@pytest.mark.parametrize("shape", ["random", "chain", "empty"])
def test_propagate(spark, scratch, shape):
    rng = random.Random(1)
    links = {"random": [(f"r{rng.randrange(80)}", f"e{rng.randrange(120):03}") for _ in range(150)], "chain": [(f"r{i // 2}", f"e{(i + 1) // 2:03}") for i in range(80)], "empty": []}[shape]
    df = spark.createDataFrame([*links, (None, "e000"), ("r0", None)], "record string, entity string")
    got = dict(map(tuple, propagate(df, scratch).collect()))
    want = linked([(e, "z" + r) for r, e in links])
    assert got == {e: want[e] for _, e in links}


def test_leaking(spark, scratch):
    rows = [
        (1, "a", "DG_0000ab12", "train", None), (2, "b", "dg-0000AB12 ", "Validation", None), (3, "c", "SG_7", "train", None), (4, "d", "sg 007", "training", None), (5, "e", "SG_8", "test", None), (6, "f", "SG_8", "none", None),
        (7, "g", "SG_8", None, None), (8, "h", None, "val", None), (9, "h", None, "test", None), (10, "i", "-", "val", None), (11, "j", " ", "train", None), (12, "k", "SG_9", "TEST\t", None), (12, "k", "SG_9", "TEST\t", None), (13, "l", "SG 9", "valid", None),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], COLUMNS)
    assert sorted(r[0] for r in leaking(df, scratch).collect()) == ["DG_0000ab12", "SG_9"]
    assert leaking(df.limit(0), scratch).count() == 0


def test_regroup(spark, scratch):
    rng = random.Random(2)
    rows = [(i, f"i{i % 900}", f"SG_{rng.choice([1, 1, 1, rng.randrange(500)])}" if i % 3 else None, None, rng.choice(["pug", "pug", "husky", None, "n/a", "Pug "])) for i in range(1200)]
    rows += [(None, None, None, None, None), (5, "i5", rows[5][2], None, rows[5][4])]
    got = regroup(spark.createDataFrame([(*r, 1) for r in rows], COLUMNS), TARGETS, scratch).collect()
    assert len(got) == len(rows)
    split = {r.rec_id: r.split for r in got}
    for key in (1, 2):  # by image, by group
        by = {}
        for r in rows:
            if r[key] is not None:
                by.setdefault(r[key], set()).add(split[r[0]])
        assert all(len(v) == 1 for v in by.values())
    assert set(split.values()) == {"train", "val", "test"}
    with pytest.raises(ValueError):
        regroup(spark.createDataFrame([(*r, 1) for r in rows], COLUMNS), [("train", 0.0), (None, 1.0)], scratch)


def test_assign_shares(spark, scratch):
    rng = random.Random(3)
    counts = []
    for i in range(3000):
        for breed in rng.sample(["a", "b", "c", None], rng.choice([1, 1, 1, 2, 3])):
            counts.append((f"s{i}", breed, rng.choice([1, 1, 2, 4])))
    counts.append(("giant", "a", 400))
    got = dict(map(tuple, assign(spark.createDataFrame(counts, "label string, stratum string, n bigint"), TARGETS, scratch).collect()))
    assert len(got) == 3001
    for breed in ("a", "b", "c", "all"):
        own = [(s, n) for s, b, n in counts if breed in (b, "all")]
        total = sum(n for _, n in own)
        for name, share in TARGETS:
            assert abs(sum(n for s, n in own if got[s] == name) / total - share) < 0.01
    assert assign(spark.createDataFrame([], "label string, stratum string, n bigint"), TARGETS, scratch).count() == 0


def test_propagate_a_shuffled_chain(spark, scratch):
    order = [f"e{i:04}" for i in random.Random(4).sample(range(2000), 2000)]
    links = [(f"r{i}", e) for i in range(1999) for e in order[i : i + 2]]
    got = propagate(spark.createDataFrame(links, "record string, entity string"), scratch).collect()
    assert {tuple(r) for r in got} == {(e, "e0000") for e in order}


def test_leaking_without_rec_id(spark, scratch):
    rows = [(None, "a", "SG_1", "train", None, 1), (None, "b", "SG_1", "val", None, 1), (None, "c", "SG_2", "val", None, 1), (1, "d", "SG_3", "val", None, 1), (None, "e", "SG_3", "test", None, 1)]
    assert sorted(r[0] for r in leaking(spark.createDataFrame(rows, COLUMNS), scratch).collect()) == ["SG_1", "SG_3"]
