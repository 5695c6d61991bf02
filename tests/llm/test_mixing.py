import random

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import mixing, splits
from corpusloom.llm.mixing import budgets, mix
from corpusloom.session import Scratch

TARGETS = {"a": (0.5, 1), "b": (0.3, 3), "c": (0.2, 4), "absent": (0.1, 2), "none": (0.0, 5), "never": (0.2, 0)}


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint, copies string")


def shares(df):
    rows = df.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("t")).collect()
    total = sum(r.t for r in rows)
    return {r.source: r.t / total for r in rows}


def test_shares_and_caps(spark, scratch):
    rng = random.Random(1)
    rows = [(i, rng.choice("aaaaabbcz") if i % 50 else None, rng.choice([0, 5, 30, 31, 200, 4000]), "x") for i in range(3000)]
    got = mix(docs(spark, rows), TARGETS, scratch)
    assert got.columns == ["doc_id", "source", "n_tokens", "copies"]
    for source, want in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert abs(shares(got)[source] - want) < 0.01
        most = got.filter(F.col("source") == source).agg(F.max("copies"), F.min("copies")).first()
        assert 1 <= most[1] and most[0] <= TARGETS[source][1]
    assert got.filter("source NOT IN ('a', 'b', 'c') OR n_tokens = 0").count() == 0
    again = mix(docs(spark, rows), TARGETS, Scratch(spark, "again"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))


def test_total_and_one_hot_length(spark, scratch):
    rows = [(i, "a", 100, "x") for i in range(1000)] + [(2000 + i, "b", 7, "x") for i in range(500)]
    got = mix(docs(spark, rows), {"a": (0.8, 1), "b": (0.2, 2)}, scratch, total=10_000)
    by = {r.source: r.t for r in got.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("t")).collect()}
    assert abs(by["a"] - 8000) <= 100 and abs(by["b"] - 2000) <= 7


def test_budgets():
    assert budgets({"a": 100.0}, {"a": (0.5, 2), "b": (0.5, 9)}, None) == {"a": 200.0}
    assert budgets({"a": 100.0, "b": 10.0}, {"a": (0.5, 1), "b": (0.5, 2)}, None) == {"a": 20.0, "b": 20.0}
    assert budgets({"a": 100.0, "b": 10.0}, {"a": (0.5, 1), "b": (0.5, 2)}, 100.0) == {"a": 50.0, "b": 20.0}
    assert budgets({}, TARGETS, None) == {}


def test_nothing_to_mix(spark, scratch):
    assert mix(docs(spark, []), TARGETS, scratch).count() == 0
    assert mix(docs(spark, [(1, "z", 5, "x"), (2, None, 5, "x"), (3, "a", 0, "x")]), TARGETS, Scratch(spark, "z")).count() == 0
    assert mix(docs(spark, [(1, "a", 5, "x")]), {}, Scratch(spark, "e")).count() == 0


def test_too_many_targets(spark, sf, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 2)
    monkeypatch.setattr(splits, "MAX_SPLITS", 2)
    for query in (mixing.p8_mix, splits.p5_splits):
        with pytest.raises(ValueError, match="more than 2"):
            query(spark, sf)
