"""Class prototypes: capped, trimmed, centred means of embeddings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import vec
from corpusloom.operators.skew import top_n
from corpusloom.session import Scratch

# Members of a class that count, and the share of least typical ones that is trimmed.
CAP, TRIM = 50, 0.05


def capped(df: DataFrame, label: str, order: str, cap: int | None) -> DataFrame:
    """The first ``cap`` rows of each class in ``order``; all for None, none for 0 and less. A null label is a class of its own."""
    if cap is None:
        return df
    if cap <= 0:
        return df.limit(0)
    return top_n(df, [label], [F.col(order)], cap, F.col(order), "__rank").drop("__rank")


@dataclass
class Prototypes:
    """One row per class (label, prototype), the mean over all capped rows (global_mean, one row), and the members kept."""

    classes: DataFrame
    global_mean: DataFrame
    members: DataFrame


def build(df: DataFrame, cap: int = CAP, trim: float = TRIM) -> Prototypes:
    """Prototypes of ``df`` (key, label, embedding).

    Per class: the first ``cap`` rows by key, at length 1; the mean at length 1; without the ``trim`` share of
    lowest cosine to it, if at least one row stays (ties: smaller key goes first); the mean of the rest at
    length 1, minus the mean of all capped rows, at length 1 again. Null labels and embeddings are left out;
    without any row there are no classes and no mean.
    """
    if cap <= 0:
        raise ValueError("cap must be at least 1")
    if not 0.0 <= trim < 1.0:
        raise ValueError("trim must be at least 0 and below 1")
    rows = df.filter("label IS NOT NULL AND embedding IS NOT NULL").select("key", "label", vec.unit(vec.doubles("embedding")).alias("u"))
    rows = Scratch(df.sparkSession, "prototypes").put(capped(rows, "label", "key", cap), "capped")  # the cap bounds it; read three times and more
    overall = rows.groupBy(F.lit(1)).agg(vec.mean(F.col("u")).alias("global_mean")).select("global_mean")  # no row for no rows
    first = rows.groupBy("label").agg(vec.unit(vec.mean(F.col("u"))).alias("centroid"), F.count(F.lit(1)).alias("n"))
    scored = rows.join(first, "label").withColumn("cos", vec.dot(F.col("u"), F.col("centroid")))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.round("cos", 12), "key"))
    kept = scored.withColumn("rank", rank).withColumn("dropped", F.floor(F.col("n") * F.lit(trim)))
    members = kept.select("key", "label", "cos", (F.col("rank") > F.col("dropped")).alias("kept"), "u")
    second = members.filter("kept").groupBy("label").agg(vec.unit(vec.mean(F.col("u"))).alias("c"))
    classes = second.crossJoin(overall).select("label", vec.unit(vec.minus(F.col("c"), F.col("global_mean"))).alias("prototype"))
    return Prototypes(classes, overall, members)
