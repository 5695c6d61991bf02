"""Rank-based evaluation: hit rates, average ranks, AUROC."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

#: Buckets of about equally many different scores, within which ranks are counted in parallel; and the accuracy of their bounds.
BUCKETS, ACCURACY = 1024, 20_000


def hit_rates(ranked: DataFrame) -> DataFrame:
    """n, top1, top3, hits of either and purebred_sanity of ``ranked`` (rank, null for a label that is no class); rates of no rows are null."""
    first, three = (F.count(F.when(F.col("rank") <= k, True)) for k in (1, 3))
    n = F.count(F.lit(1))
    return ranked.agg(
        n.alias("n"),
        F.try_divide(first, n).alias("top1"),
        F.try_divide(three, n).alias("top3"),
        first.alias("top1_hit"),
        three.alias("top3_hit"),
        F.try_divide(first, n).alias("purebred_sanity"),
    )


def average_ranks(scores: DataFrame, score: str = "score") -> DataFrame:
    """(score, n, rank) of each different score: how often, and the average of the ranks it takes, from 1 ascending.

    Equal scores are counted first; what lies before is added up over buckets of the score's order and
    within each, so no task sorts all rows, however the scores are spread. Null and NaN scores are left out.
    """
    each = scores.filter(F.col(score).isNotNull() & ~F.isnan(score)).groupBy(F.col(score).alias("score")).agg(F.count(F.lit(1)).alias("n"))
    each = each.withColumn("score", F.col("score").cast("double"))
    cuts = each.agg(F.percentile_approx("score", [i / BUCKETS for i in range(1, BUCKETS)], ACCURACY)).first()[0] or []
    splits = [float("-inf"), *sorted({c for c in cuts if abs(c) < float("inf")} or {0.0}), float("inf")]
    cut = Bucketizer(splits=splits, inputCol="score", outputCol="b").transform(each)
    earlier = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # BUCKETS rows at most
    starts = cut.groupBy("b").agg(F.sum("n").alias("m")).select("b", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("start"))
    within = Window.partitionBy("b").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("start") + F.coalesce(F.sum("n").over(within), F.lit(0))
    return cut.join(F.broadcast(starts), "b").select("score", "n", (before + (F.col("n") + 1) / 2).alias("rank"))


def auroc(positives: DataFrame, negatives: DataFrame, score: str = "score") -> DataFrame:
    """n_pos, n_neg and auroc: the chance that a positive's score is the higher one, equal ones counting half.

    A side without scores gives null.
    """
    both = positives.select(F.col(score).cast("double").alias("score"), F.lit(1).alias("pos")).unionByName(negatives.select(F.col(score).cast("double").alias("score"), F.lit(0).alias("pos")))
    both = both.filter("score IS NOT NULL AND NOT isnan(score)")
    ranks = average_ranks(both)
    sides = both.groupBy("score").agg(F.sum("pos").alias("p"), F.sum(1 - F.col("pos")).alias("q"))
    sums = sides.join(ranks, "score").agg(F.coalesce(F.sum("p"), F.lit(0)).alias("n_pos"), F.coalesce(F.sum("q"), F.lit(0)).alias("n_neg"), F.sum(F.col("p") * F.col("rank")).alias("r"))
    u = F.col("r") - F.col("n_pos") * (F.col("n_pos") + 1) / 2
    value = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.try_divide(u, F.col("n_pos") * F.col("n_neg")))
    return sums.select("n_pos", "n_neg", value.alias("auroc"))


def some(row: Row, *counts: str) -> Row:
    """``row``; ValueError if one of its counts is 0, as rates of nothing mean nothing."""
    for name in counts:
        if not row[name]:
            raise ValueError(f"nothing to evaluate: {name} is 0")
    return row
