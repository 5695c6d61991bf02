"""Group-wise stratified split and the half split of cats."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.names import CAT_LABEL
from corpusloom.operators.skew import ranked, skew_join

# Splits in the order in which equal needs are served, with their shares.
RATIOS = {"train": 0.70, "val": 0.15, "test": 0.15}


def group_table(manifest: DataFrame) -> DataFrame:
    """(dedup_group, breed, n) of the rows in the frozen set: rows of the group and its most frequent breed, the smallest of equals."""
    rows = manifest.filter(F.col("in_mvp25") & F.col("dedup_group").isNotNull())
    each = rows.groupBy("dedup_group", "canonical_breed").agg(F.count(F.lit(1)).alias("n"))
    mode = F.min(F.struct((-F.col("n")).alias("k"), F.col("canonical_breed").alias("breed")))
    return each.groupBy("dedup_group").agg(mode["breed"].alias("breed"), F.sum("n").alias("n"))


def greedy(sizes: list[int], counts: list[int], shares: list[float]) -> np.ndarray:
    """Groups of each size that go to each split when, largest first, each goes to the split of largest deficit.

    The deficit is the split's share minus its rows over all rows; equal deficits are served in order. Runs of
    equal size are handed out together: a split is served as long as its deficit is above a common level.
    """
    total = float(sum(s * c for s, c in zip(sizes, counts)))
    lack, out = np.array(shares, float), np.zeros((len(sizes), len(shares)), np.int64)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        step = sizes[i] / total
        # a split is served while its deficit exceeds the level; a level slightly too high leaves a few over
        low, high = lack.min() - step * (counts[i] + 1), lack.max()
        for _ in range(80):
            level = (low + high) / 2
            if np.ceil(np.maximum(lack - level, 0) / step).sum() > counts[i]:
                low = level
            else:
                high = level
        take = np.ceil(np.maximum(lack - high - 1e-9, 0) / step).astype(np.int64)
        while take.sum() > counts[i]:
            take[take.argmax()] -= 1
        lack = lack - take * step
        for _ in range(int(counts[i] - take.sum())):
            j = int(np.argmax(np.round(lack, 12)))
            take[j] += 1
            lack[j] -= step
        out[i] = take
    return out


def group_split(groups: DataFrame, ratios: dict[str, float] | None = None) -> DataFrame:
    """(dedup_group, split) of ``groups`` (dedup_group, breed, n), no group torn; see ``greedy``.

    Groups of one breed and size are interchangeable: how many go where is worked out on their counts, and
    which ones is drawn by hash. A null breed is a stratum of its own.
    """
    ratios = ratios or RATIOS
    names, shares = list(ratios), list(ratios.values())
    columns = ", ".join(f"s{j} bigint" for j in range(len(names)))

    def per_breed(pdf: pd.DataFrame) -> pd.DataFrame:
        made = greedy(pdf["n"].tolist(), pdf["groups"].tolist(), shares)
        return pdf.assign(**{f"s{j}": made[:, j] for j in range(len(names))})

    cell = F.concat_ws(" ", F.coalesce("breed", F.lit("")), "n").alias("cell")
    counts = groups.groupBy("breed", "n").agg(F.count(F.lit(1)).alias("groups"))
    plan = counts.groupBy("breed").applyInPandas(per_breed, f"breed string, n bigint, groups bigint, {columns}").select(cell, *[f"s{j}" for j in range(len(names))])
    split, upto, bounds = F.lit(names[-1]), F.lit(0), []
    for j, name in enumerate(names[:-1]):
        upto = upto + F.col(f"s{j}")
        bounds.append((name, upto))
    for name, bound in reversed(bounds):
        split = F.when(F.col("rank") < bound, name).otherwise(split)
    drawn = ranked(groups.withColumn("cell", cell), ["cell"], F.col("dedup_group"))
    return skew_join(drawn, plan, "cell").select("dedup_group", split.alias("split"))


def half_split(manifest: DataFrame) -> DataFrame:
    """(image_id, split) of the cats: in the order of a hash, the first half (rounded down) val, the rest test. Every image once."""
    cats = manifest.filter((F.col("canonical_breed") == CAT_LABEL) & F.col("image_id").isNotNull()).select("image_id").distinct()
    half = cats.agg(F.floor(F.count(F.lit(1)) / 2).alias("half"))
    order = ranked(cats.withColumn("all", F.lit(1)), ["all"], F.col("image_id"), buckets=1024)
    return order.crossJoin(F.broadcast(half)).select("image_id", F.when(F.col("rank") < F.col("half"), "val").otherwise("test").alias("split"))
