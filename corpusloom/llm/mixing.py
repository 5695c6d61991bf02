"""Problem 8: sources mixed to target weights.

Method: entropy balancing. Of all document rates that give each source its share of the tokens, those
closest in entropy to one use of every document are exponentials of the document's tokens, cut off at
the source's max_repeat. The convex dual has one unknown per source; distributed Newton iterations,
kept inside a bracket, solve it. A rate depends on source and tokens only, so the iterations run over
the counts of (source, tokens). Rates are rounded to copies along the cumulated rates, in order of
tokens, so that a source's tokens miss their target by a part of one document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.dirty import filled_text
from corpusloom.llm.tokens import TOKENIZERS, count_tokens
from corpusloom.operators.skew import ranked, skew_join
from corpusloom.session import Scratch

#: Newton iterations beyond which something is wrong, relative error at which they end, and roundings that are tried.
ROUNDS, CLOSE, OFFSETS = 300, 1e-9, 64
#: Most sources that a mix may have.
MAX_SOURCES = 10_000


def _known(df: DataFrame, **values: dict[str, float]) -> DataFrame:
    """``df`` with the values of the row's source, a column each; rows of sources without all of them are left out. MAX_SOURCES bounds what is broadcast."""
    sources = set.intersection(*map(set, values.values()))
    rows = [(s, *(float(v[s]) for v in values.values())) for s in sorted(sources)]
    table = df.sparkSession.createDataFrame(rows, ", ".join(["source string", *[f"`{n}` double" for n in values]]))
    return df.join(F.broadcast(table), "source")


def _rate() -> Column:
    """The rate of a row with tilt, mean and most."""
    return F.least("most", F.exp(F.least(F.lit(700.0), F.col("tilt") * F.col("n_tokens") / F.col("mean"))))


def budgets(have: dict[str, float], targets: dict[str, tuple[float, int]], total: float | None) -> dict[str, float]:
    """Tokens wanted of each source that has tokens, a positive share and a max_repeat of at least 1.

    Without ``total``, the largest mix in which every such source reaches its share, the shares of the
    others being spread over them; with it, what no source can give is left out.
    """
    able = {s: (w, r) for s, (w, r) in targets.items() if have.get(s, 0) > 0 and w and w > 0 and r and r >= 1}
    if not able:
        return {}
    scale = sum(w for w, _ in able.values())
    most = min(have[s] * r / (w / scale) for s, (w, r) in able.items())
    size = most if total is None else total
    return {s: min(w / scale * size, have[s] * r) for s, (w, r) in able.items()}


def tilts(sizes: DataFrame, want: dict[str, float], have: dict[str, float], mean: dict[str, float], most: dict[str, float]) -> dict[str, float]:
    """The dual unknown of each source, by Newton iterations over ``sizes`` (source, n_tokens, documents)."""
    tilt = dict.fromkeys(want, 0.0)
    done = {s for s in want if want[s] >= have[s] * most[s] * (1 - 1e-12)}
    tilt |= dict.fromkeys(done, math.inf)
    low, high = dict.fromkeys(want, -math.inf), dict.fromkeys(want, math.inf)
    for _ in range(ROUNDS):
        open_ = {s: tilt[s] for s in want if s not in done}
        if not open_:
            return tilt
        tokens = F.col("documents") * F.col("n_tokens") * F.col("rate")
        rated = _known(sizes, tilt=open_, mean=mean, most=most).withColumn("rate", _rate())
        sums = rated.groupBy("source").agg(F.sum(tokens), F.sum(F.when(F.col("rate") < F.col("most"), tokens * F.col("n_tokens") / F.col("mean")).otherwise(0.0)))
        for s, got, slope in sums.collect():
            miss = got - want[s]
            if abs(miss) <= CLOSE * want[s] or high[s] - low[s] <= 1e-14 * abs(tilt[s]):  # or as near as numbers are
                done.add(s)
                continue
            if miss > 0:
                high[s] = tilt[s]
            else:
                low[s] = tilt[s]
            # Newton on the logarithm of the tokens, which is the flatter function
            step = tilt[s] - math.log(got / want[s]) * got / slope if slope > 0 and got > 0 else math.nan
            if not low[s] < step < high[s]:
                step = (low[s] + high[s]) / 2 if math.isfinite(low[s]) and math.isfinite(high[s]) else (high[s] - max(1.0, abs(high[s])) if miss > 0 else low[s] + max(1.0, abs(low[s])))
            tilt[s] = step
    raise ArithmeticError(f"no rates after {ROUNDS} iterations for {sorted(set(want) - done)}")


def mix(docs: DataFrame, targets: dict[str, tuple[float, int]], scratch: Scratch, total: float | None = None) -> DataFrame:
    """``docs`` (doc_id, source, n_tokens) with copies, the documents of the mix only.

    ``targets`` gives (share, max_repeat) by source. A source without documents, a share or repeats gives
    nothing, and its share goes to the others in proportion; so do documents of other or null sources and
    documents without tokens. copies is 1 to max_repeat; of equally long documents of a source, which get
    one more is drawn by the hash of doc_id. Repeated rows count as documents of their own.
    """
    spark = docs.sparkSession
    used = scratch.put(docs.filter(F.col("source").isin(list(targets)) & (F.col("n_tokens") > 0)).select("doc_id", "source", "n_tokens"), "used")
    sizes = scratch.put(used.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("documents")), "sizes")
    sums = sizes.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("documents")), F.sum("documents")).collect()  # a row per source
    have, mean = {r[0]: float(r[1]) for r in sums}, {r[0]: r[1] / r[2] for r in sums}
    want = budgets(have, targets, total)
    if not want:
        return used.withColumn("copies", F.lit(0).cast("bigint")).limit(0)
    most = {s: float(targets[s][1]) for s in want}
    tilt = tilts(sizes, want, have, mean, most)
    rated = _known(sizes, want=want, tilt=tilt, mean=mean, most=most).withColumn("uses", F.col("documents") * _rate())
    upto = F.sum("uses").over(Window.partitionBy("source").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0))
    rated = rated.withColumn("upto", F.round(upto, 9)).withColumn("from", F.coalesce(F.lag("upto").over(Window.partitionBy("source").orderBy("n_tokens")), F.lit(0.0)))
    rated = scratch.put(rated.select("source", "n_tokens", "documents", "want", "upto", "from"), "rated")
    share = lambda o: F.floor(F.col("upto") + o) - F.floor(F.col("from") + o)
    tried = rated.withColumn("offset", F.explode(F.array(*[F.lit((k + 0.5) / OFFSETS) for k in range(OFFSETS)])))
    tried = tried.groupBy("source", "offset", "want").agg(F.sum(F.col("n_tokens") * share(F.col("offset"))).alias("tokens"))
    best = tried.groupBy("source").agg(F.min(F.struct(F.abs(F.col("tokens") - F.col("want")).alias("miss"), "offset"))["offset"].alias("offset"))
    cell = F.concat_ws(" ", "source", "n_tokens").alias("cell")
    whole = rated.join(best, "source").withColumn("whole", share(F.col("offset"))).select(cell, "documents", "whole")  # a row a source
    drawn = skew_join(ranked(used.withColumn("cell", cell), ["cell"], F.col("doc_id")), whole, "cell")
    each, rest = F.expr("whole div documents"), F.expr("whole % documents")
    copies = (each + (F.col("rank") < rest).cast("int")).cast("bigint").alias("copies")
    return drawn.select("doc_id", "source", "n_tokens", copies).filter("copies > 0")


def _inputs(spark: SparkSession, sf: str, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents with their tokens, mix_targets with shares and repeats of each source summed and least)."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.lower(filled_text(F.col("source"))).alias("source"), "text")
    targets = spark.read.parquet(f"{sf}/mix_targets.parquet").select(F.lower(filled_text(F.col("source"))).alias("source"), "target_share", "max_repeat")
    targets = targets.filter("source IS NOT NULL").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeat").alias("max_repeat"))
    return count_tokens(docs, "text", path), targets


def _mixed(spark: SparkSession, sf: str, path: str = TOKENIZERS) -> tuple[DataFrame, DataFrame, DataFrame]:
    scratch = Scratch(spark, "p8")
    docs, targets = _inputs(spark, sf, path)
    rows = targets.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"there are more than {MAX_SOURCES} target sources")
    docs = scratch.put(docs, "tokens")
    return docs, targets, mix(docs, {r[0]: (r[1], r[2]) for r in rows}, scratch)


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The documents of the mix with their copies."""
    return _mixed(spark, sf)[2]


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and reached share of each source of either side, with its documents, copies and tokens."""
    docs, targets, mixed = _mixed(spark, sf)
    there = docs.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("tokens_there"))
    got = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("used"), F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"))
    out = targets.join(there.filter("source IS NOT NULL"), "source", "full").join(got, "source", "left").na.fill(0, ["documents", "tokens_there", "used", "copies", "tokens"])
    return out.withColumn("share", F.round(F.try_divide("tokens", F.sum("tokens").over(Window.partitionBy(F.lit(1)))), 6))


def p8_kept(spark: SparkSession, sf: str) -> DataFrame:
    """What the mix must keep, counted: documents used too often or not at all, sources without a target, and sources that can, but miss their share by more than a thousandth and one document."""
    docs, targets, mixed = _mixed(spark, sf)
    used = mixed.join(targets, "source", "left")
    got = mixed.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"), F.max("n_tokens").alias("largest"))
    able = targets.filter("target_share > 0 AND max_repeat >= 1").join(docs.filter("n_tokens > 0").select("source").distinct(), "source", "left_semi").join(got, "source", "left")
    every = Window.partitionBy(F.lit(1))  # a row a source
    total = F.sum("tokens").over(every)
    miss = F.abs(F.coalesce("tokens", F.lit(0)) / total - F.col("target_share") / F.sum("target_share").over(every))
    off = able.withColumn("off", miss > 0.001 + F.coalesce("largest", F.lit(0)) / total).agg(F.count(F.when(F.col("off"), True)).alias("off"))
    counted = used.agg(F.count(F.when(F.col("copies") > F.col("max_repeat"), True)).alias("too_often"), F.count(F.when(F.col("copies") < 1, True)).alias("unused"), F.count(F.when(F.col("target_share").isNull(), True)).alias("untargeted"))
    return counted.crossJoin(off)  # one row each


QUERIES = {"p8_mix": p8_mix, "p8_shares": p8_shares, "p8_kept": p8_kept}

ORACLES = {"p8_kept": "SELECT 0::BIGINT AS too_often, 0::BIGINT AS unused, 0::BIGINT AS untargeted, 0::BIGINT AS off"}
