"""Joins and rankings that hold when one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most keys that are treated as hot, which bounds what is collected and broadcast; a key beyond them has less than one row in MAX_HOT.
MAX_HOT = 10_000
#: Rows of a hot key that one reducer gets, and reducers at most.
SHARE, MOST = 50_000, 4096


def hot_keys(df: DataFrame, key: str, at_least: int) -> list[tuple]:
    """(key, rows) of the keys of at least ``at_least`` rows, the MAX_HOT hottest at most; null is no key."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    top = counts.filter(F.col("__n") >= at_least).orderBy(F.col("__n").desc(), key).limit(MAX_HOT)
    return [tuple(r) for r in top.select(key, "__n").collect()]


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", at_least: int = 100_000, rows: int | None = None) -> DataFrame:
    """Equi-join of ``left`` with a ``right`` that is unique in ``key``, hot keys of ``left`` salted.

    Rows of a hot key are spread over so many reducers that each gets about SHARE of them, and only the matching row
    of ``right`` is repeated as often. ``how`` is inner, left or left_semi. Without a hot key it is a plain join. ``rows``, if
    known, is how many rows ``left`` has at most: with fewer than ``at_least`` no key can be hot.
    """
    hot = hot_keys(left, key, at_least) if rows is None or rows >= at_least else []
    if not hot:
        return left.join(right, key, how)
    kind = left.schema[key].dataType.simpleString()
    spread = [(k, min(MOST, max(2, -(-n // SHARE)))) for k, n in hot]
    keys = F.broadcast(left.sparkSession.createDataFrame(spread, f"`{key}` {kind}, __hot int"))
    # by content, so that a recomputed task spreads its rows as before
    salt = F.when(F.col("__hot").isNotNull(), F.pmod(F.xxhash64(*left.columns), F.col("__hot"))).otherwise(F.lit(0)).cast("int")
    salts = F.when(F.col("__hot").isNotNull(), F.sequence(F.lit(0), F.col("__hot") - 1)).otherwise(F.array(F.lit(0)))
    lhs = left.join(keys, key, "left").withColumn("__salt", salt).drop("__hot")
    rhs = right.join(keys, key, "left").withColumn("__salt", F.explode(salts)).drop("__hot")
    return lhs.join(rhs, [key, "__salt"], how).drop("__salt")


def ranked(df: DataFrame, groups: list[str], tie: Column, name: str = "rank", buckets: int = 256) -> DataFrame:
    """``name`` = 0, 1, ... within each group in a fixed pseudo-random order, without sorting a whole group in one task.

    Each group is cut into ``buckets`` by the hash of ``tie`` (unique in the group); a row's rank is the
    number of rows in earlier buckets plus its rank in its own. Null group keys are groups of their own.
    """
    cut = df.withColumn("__h", F.xxhash64(tie)).withColumn("__b", F.pmod(F.col("__h"), F.lit(buckets)).cast("int"))
    names = [f"__g{i}" for i in range(len(groups))]
    sizes = cut.groupBy(*[F.col(g).alias(n) for g, n in zip(groups, names)], F.col("__b").alias("__gb")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*names).orderBy("__gb").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*names, "__gb", F.coalesce(before, F.lit(0)).alias("__start"))
    same = F.col("__b") == F.col("__gb")
    for g, n in zip(groups, names):
        same = same & F.col(g).eqNullSafe(F.col(n))
    own = F.row_number().over(Window.partitionBy(*groups, "__b").orderBy("__h", tie)) - 1
    return cut.withColumn("__own", own).join(starts, same).withColumn(name, F.col("__start") + F.col("__own")).drop("__h", "__b", "__gb", "__own", "__start", *names)


def top_n(df: DataFrame, groups: list[str], order: list[Column], n: int, spread: Column, name: str = "rank", parts: int = 256) -> DataFrame:
    """The first ``n`` rows of each group by ``order``, with ``name`` = 1, 2, ...; a group is first cut into ``parts`` by the hash of ``spread``."""
    cut = df.withColumn("__part", F.pmod(F.xxhash64(spread), F.lit(parts)))
    few = cut.withColumn(name, F.row_number().over(Window.partitionBy(*groups, "__part").orderBy(*order))).filter(F.col(name) <= n).drop("__part")
    return few.withColumn(name, F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).filter(F.col(name) <= n)
