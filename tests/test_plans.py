"""Prototypes, scoring, evaluation and streaming."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.plans import evaluation, scoring
from corpusloom.plans.prototype import build, capped


def vectors(spark, rows):
    return spark.createDataFrame(rows, "key int, label string, embedding array<float>")


def plain_prototypes(by_class, cap=50, trim=0.05):
    unit = lambda v: v / max(np.linalg.norm(v), 1e-12)
    normed = {k: np.array([unit(np.array(v, np.float32).astype(float)) for v in vs[:cap]]) for k, vs in by_class.items()}
    mean, out = np.concatenate(list(normed.values())).mean(0), {}
    for k, x in normed.items():
        c = unit(x.mean(0))
        drop = int(len(x) * trim)
        if drop:
            x = x[np.argsort(x @ c, kind="stable")[drop:]]
            c = unit(x.mean(0))
        out[k] = unit(c - mean)
    return out, mean


def test_prototypes_by_class_size(spark):
    rng = np.random.default_rng(1)
    by = {f"c{n}": rng.normal(size=(n, 6)).tolist() for n in (1, 19, 20, 50, 51)}
    by["zero"] = [[0.0] * 6]
    rows = [(i, k, v) for k, vs in by.items() for i, v in enumerate(vs)] + [(0, None, [1.0] * 6), (9, "c1", None)]
    made = build(vectors(spark, rows))
    want, mean = plain_prototypes(by)
    got = {r.label: np.array(r.prototype) for r in made.classes.collect()}
    assert set(got) == set(want)
    for k in want:
        assert np.allclose(got[k], want[k], atol=1e-9)
    assert np.allclose(made.global_mean.first()[0], mean)
    for bad in ({"cap": 0}, {"trim": 1.0}, {"trim": -0.1}):
        with pytest.raises(ValueError):
            build(vectors(spark, rows), **bad)


def test_caps(spark):
    df = vectors(spark, [(i, "a", [1.0]) for i in range(9)] + [(1, None, [1.0])])
    assert sorted(r.key for r in capped(df, "label", "key", 3).collect()) == [0, 1, 1, 2]
    assert capped(df, "label", "key", None).count() == 10 and capped(df, "label", "key", 0).count() == 0


def scorer():
    return scoring.Scorer(["a", "b", "c"], np.array([[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0]]), np.zeros(2))


def test_predict(spark):
    df = vectors(spark, [(0, "a", [2.0, 0.0]), (1, "b", [1.0, 1.0]), (2, "x", [0.0, -1.0]), (3, "c", None)])
    got = {r.key: r for r in scoring.predict(df, scorer(), 0.5, 2).withColumn("other", scoring.other_share()).collect()}
    assert not got[0].unknown and [t.label for t in got[0].topk] == ["a", "b"]
    assert [t.label for t in got[1].topk] == ["a", "b"] and abs(got[1].topk[0].pct - got[1].topk[1].pct) < 1e-9
    assert got[2].unknown and got[2].topk == [] and got[2].other is None
    assert got[3].max_sim is None
    whole = scoring.predict(df, scorer(), -2.0, 9).filter("max_sim IS NOT NULL").collect()
    assert all(abs(sum(t.pct for t in r.topk) - 100) < 1e-6 and len(r.topk) == 3 for r in whole)
    exact = scoring.predict(df.filter("key = 0"), scorer(), 1.0).first()
    assert not exact.unknown
    for bad in ({"top_k": 0}, {"temperature": 0.0}):
        with pytest.raises(ValueError):
            scoring.predict(df, scorer(), **bad)


def test_no_classes(spark):
    none = scoring.Scorer([], np.zeros((0, 2)), np.zeros(2))
    row = scoring.predict(vectors(spark, [(0, "a", [1.0, 0.0])]), none).first()
    assert row.unknown and row.max_sim == float("-inf") and row.topk == []


def test_ranks_break_ties_downwards(spark):
    df = scoring.with_scores(vectors(spark, [(0, "a", [1.0, 1.0]), (1, "b", [1.0, 1.0]), (2, "zz", [1.0, 1.0])]), scorer())
    ranks = {r.key: r["rank"] for r in df.select("key", scoring.rank_of(F.col("label"), scorer()).alias("rank")).collect()}
    assert ranks == {0: 2, 1: 1, 2: None}
    rates = evaluation.hit_rates(df.select(scoring.rank_of(F.col("label"), scorer()).alias("rank"))).first()
    assert (rates.n, rates.top1_hit, rates.top3_hit) == (3, 1, 2) and rates.purebred_sanity == rates.top1


@pytest.mark.parametrize(("pos", "neg", "want"), [([1.0, 1.0], [1.0], 0.5), ([2.0, 3.0], [0.0, 1.0], 1.0), ([0.0], [1.0, 2.0], 0.0), ([1.0, 2.0, 3.0], [2.0, 0.0], 0.75), ([1.0], [], None)])
def test_auroc(spark, pos, neg, want):
    side = lambda xs: spark.createDataFrame([(x,) for x in [*xs, None]], "score double")
    got = evaluation.auroc(side(pos), side(neg)).first()
    assert (got.n_pos, got.n_neg) == (len(pos), len(neg))
    assert got.auroc == want if want is None else abs(got.auroc - want) < 1e-12
    if neg:
        other = evaluation.auroc(side(neg), side(pos)).first()
        assert abs(got.auroc + other.auroc - 1) < 1e-12


def test_streaming(spark, tmp_path):
    from corpusloom.streaming.scoring import ARRIVING, arriving, outcome_counts, predictions

    import datetime as dt

    rows = [(f"k{i}", dt.datetime(2024, 1, 1, 0, i), [1.0, 0.0] if i % 2 else [0.0, -1.0]) for i in range(10)]
    spark.createDataFrame(rows, ARRIVING).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = predictions(arriving(spark, str(tmp_path / "in")), scorer())
    query = stream.writeStream.format("memory").queryName("scored").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("scored").groupBy("unknown").count().count() == 2
    counts = outcome_counts(predictions(arriving(spark, str(tmp_path / "in")), scorer())).writeStream.format("memory").queryName("counted").outputMode("complete").start()
    counts.processAllAvailable()
    counts.stop()
    assert spark.table("counted").agg(F.sum("n")).first()[0] == 10


def test_empty_tables(spark):
    none = vectors(spark, [])
    made = build(none)
    assert made.classes.count() == 0 and made.global_mean.count() == 0
    empty = scoring.Scorer.of(made)
    assert scoring.predict(vectors(spark, [(1, "a", [1.0])]), empty).first().unknown
    assert evaluation.average_ranks(spark.createDataFrame([], "score double")).count() == 0
    assert evaluation.hit_rates(spark.createDataFrame([], "rank int")).first().n == 0


def test_infinite_scores(spark):
    df = spark.createDataFrame([(float("-inf"),), (float("inf"),), (1.0,), (1.0,), (float("nan"),), (None,)], "score double")
    got = {r.score: (r.n, r["rank"]) for r in evaluation.average_ranks(df).collect()}
    assert got == {float("-inf"): (1, 1.0), 1.0: (2, 2.5), float("inf"): (1, 4.0)}


def test_thousands_of_classes(spark):
    n = 3000
    labels = [f"c{i:04}" for i in range(n)]
    angles = np.linspace(0, np.pi, n)
    many = scoring.Scorer(labels, np.stack([np.cos(angles), np.sin(angles)], 1), np.zeros(2))
    df = spark.createDataFrame([(i, [float(np.cos(a)), float(np.sin(a))], labels[i]) for i, a in enumerate(angles) if i % 100 == 7], "key int, embedding array<double>, label string")
    out = scoring.predict(df, many, threshold=0.1).collect()
    assert all(r.topk[0].label == r.label and not r.unknown for r in out)
    x = np.exp((np.cos(angles[7] - angles) - 1) / scoring.TEMPERATURE)
    first = next(r for r in out if r.key == 7)
    assert first.topk[0].pct == pytest.approx(100 / x.sum())
    scored = scoring.with_scores(df, many)
    assert {r[0] for r in scored.select(scoring.rank_of(F.col("label"), many)).collect()} == {1}


def test_average_ranks_of_scores_with_an_outlier(spark):
    scores = [1e300, float("inf"), float("-inf"), -1e300] + [i / 7 for i in range(5000)] + [1.0] * 9
    got = {r.score: r["rank"] for r in evaluation.average_ranks(spark.createDataFrame([(s,) for s in scores], "score double")).collect()}
    ordered = np.sort(scores)
    for s in (1e300, float("inf"), float("-inf"), 1.0, 3 / 7, 4999 / 7):
        low, high = np.searchsorted(ordered, s, "left"), np.searchsorted(ordered, s, "right")
        assert got[s] == (low + 1 + high) / 2
