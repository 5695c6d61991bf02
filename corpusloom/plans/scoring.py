"""Cosine scores of embeddings against prototypes, rejection of the unknown, calibrated top classes.

The scores of a row are one array in the order of the sorted labels, so everything after the product is
row-local: no shuffle, no window.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.vec import bound
from corpusloom.plans.prototype import Prototypes

# Rejection threshold, classes reported, temperature, and the least share reported as "Other".
THRESHOLD, TOP_K, TEMPERATURE, LEAST_OTHER = 0.5, 3, 0.1, 0.05
#: Classes whose prototypes are sent to every worker (at 384 numbers, 150 MB at most); more are refused.
MAX_CLASSES = 50_000


@dataclass
class Scorer:
    """Prototypes as a matrix: labels sorted, one row each, and the mean that is taken off a query."""

    labels: list[str]
    matrix: np.ndarray
    centre: np.ndarray

    @staticmethod
    def of(prototypes: Prototypes) -> Scorer:
        """Collect the classes, MAX_CLASSES at most."""
        rows = prototypes.classes.select("label", "prototype").limit(MAX_CLASSES + 1).collect()
        if len(rows) > MAX_CLASSES:
            raise ValueError(f"more than {MAX_CLASSES} classes")
        rows.sort(key=lambda r: str(r[0]))
        centre = prototypes.global_mean.first()
        matrix = np.array([r[1] for r in rows], float).reshape(len(rows), -1) if rows else np.zeros((0, 0))
        return Scorer([r[0] for r in rows], matrix, np.array(centre[0] if centre else [], float))


def with_scores(queries: DataFrame, scorer: Scorer, column: str = "embedding") -> DataFrame:
    """``queries`` with scores: array<double>, the cosine to each class; null for a null embedding.

    One matrix product per Arrow batch: with hundreds of numbers a vector, higher-order functions take
    some hundred times as long.
    """
    shared = queries.sparkSession.sparkContext.broadcast(scorer)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def scores(vectors: pd.Series) -> pd.Series:
        known = shared.value
        there = [i for i, v in enumerate(vectors) if v is not None]
        out: list = [None] * len(vectors)
        if there:
            x = np.stack([vectors.iloc[i] for i in there]).astype(float)
            if known.labels:
                x = x - known.centre
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            for i, row in zip(there, x @ known.matrix.T if known.labels else np.zeros((len(x), 0))):
                out[i] = row
        return pd.Series(out, dtype=object)

    return queries.withColumn("scores", scores(F.col(column)))


def best_score() -> Column:
    """The highest score; minus infinity without classes."""
    return F.coalesce(F.array_max("scores"), F.when(F.col("scores").isNotNull(), F.lit(float("-inf"))))


def probabilities(temperature: float = TEMPERATURE) -> Column:
    """Softmax of the scores over all classes, by temperature."""
    logits = bound(F.array_max("scores"), lambda top: F.transform("scores", lambda s: F.exp((s - top) / F.lit(temperature))))
    share = lambda own: bound(F.aggregate(own, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(own, lambda x: x / total))
    return bound(logits, share)


def label_array(scorer: Scorer) -> Column:
    """The labels in the order of the scores, as one literal however many there are."""
    return F.from_json(F.lit(json.dumps(scorer.labels)), "array<string>")


def predict(queries: DataFrame, scorer: Scorer, threshold: float = THRESHOLD, top_k: int = TOP_K, temperature: float = TEMPERATURE) -> DataFrame:
    """``queries`` with unknown, max_sim and topk (label, pct), best first.

    A highest score below ``threshold`` is unknown and has no topk; pct is 100 times the softmax over all
    classes; equal scores are ordered by label.
    """
    if top_k <= 0:
        raise ValueError("top_k must be at least 1")
    if temperature <= 0:
        raise ValueError("temperature must be positive")
    scored = with_scores(queries, scorer).withColumn("max_sim", best_score())
    both = F.arrays_zip(F.col("scores").alias("s"), probabilities(temperature).alias("p"))
    # labels are sorted, so places order equal scores as labels do; only the best places become labels
    ranked = F.array_sort(F.transform(both, lambda b, i: F.struct((-F.round(b["s"], 12)).alias("s"), i.alias("i"), (b["p"] * 100).alias("pct"))))
    top = bound(label_array(scorer), lambda labels: F.transform(F.slice(ranked, 1, top_k), lambda b: F.struct(F.get(labels, b["i"]).alias("label"), b["pct"].alias("pct"))))
    unknown = F.col("max_sim") < F.lit(threshold)
    none = F.array().cast("array<struct<label:string,pct:double>>")
    return scored.withColumn("unknown", unknown).withColumn("topk", F.when(~unknown, top).otherwise(none)).drop("scores")


def other_share() -> Column:
    """What the reported classes leave of 100, null if it is too little to report or nothing is reported."""
    rest = F.lit(100.0) - F.aggregate("topk", F.lit(0.0), lambda a, t: a + t["pct"])
    return F.when((F.size("topk") > 0) & (rest > LEAST_OTHER), rest)


def rank_of(label: Column, scorer: Scorer) -> Column:
    """The rank of ``label`` among the scores, from 1; of equal scores the larger label comes first. Null if it is no class."""

    def at(place: Column) -> Column:
        ahead = lambda own: F.size(F.filter("scores", lambda s, i: (s > own) | ((s == own) & (i >= place)))) + 1
        return F.when(place > 0, bound(F.get("scores", place - 1), ahead))

    return bound(F.array_position(label_array(scorer), label).cast("int"), at)
