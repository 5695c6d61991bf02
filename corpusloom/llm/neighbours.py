"""Problem 4: the most similar vectors of every vector.

Method: score-aware quantisation. Every vector is coded with four bits a place under an anisotropic loss
(``quantise``); a block of queries scans the codes of the pieces of the index that may hold something
better, first those nearby, then, knowing its k-th best, whatever is not out of the question. Candidates
are all rows whose estimate comes within MARGIN deviations of the query's k-th best, however many; they are
scored exactly. So near-copies in one hot group are scanned whole, a picture like others visits a
few pieces, and one unlike any other visits all codes, which are an eighth of the vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.vectors import BITS, BLUR, ROOM, STEP, UNIT_SQL, Candidates, Index, indexed, products, usable
from corpusloom.operators.skew import skew_join, top_n
from corpusloom.session import Scratch

#: How many deviations of the estimates a candidate may lie below the k-th best estimate, which luck has raised, or below the floor.
MARGIN = 4.0
#: Share of the estimates of a chunk from which on, if they are near enough, the chunk is scored by the vectors themselves, as
#: happens among near-copies that differ by less than codes can tell.
DENSE = 0.02


def scanned(index: Index, block: int, k: int, floor: float | None) -> pa.Table | None:
    """(q, x, cos): the k nearest of each vector of the block that were found, by vid; cosines exact, at least ``floor`` if there is one."""
    vecs, vids = index.vectors(block)
    if not len(vecs):
        return None
    lowest = -2.0 if floor is None else floor
    found, sure = Candidates(len(vecs), k, lowest, MARGIN * index.blur), Candidates(len(vecs), k, lowest, 2 * BLUR)
    own = np.int64(block) << BITS

    def visit(wanted: np.ndarray) -> None:
        for b, queries, rows in index.visits(wanted):
            codes, at, raw = index.decoded(b)[rows], (np.int64(b) << BITS) + rows, None
            for s in range(0, len(queries), STEP):
                some = queries[s : s + STEP]
                for r in range(0, len(rows), 4 * STEP):
                    here = at[r : r + 4 * STEP]
                    itself = (own + some)[:, None] == here[None] if b == block else None
                    guess = vecs[some] @ codes[r : r + 4 * STEP].T
                    if itself is not None:
                        guess[itself] = -3
                    near = found.near(some, guess)
                    if near.mean() <= DENSE or near.sum() <= ROOM * k * len(some):
                        found.add(some, here, guess, near)
                        continue
                    raw = index.raw.read(b)[rows] if raw is None else raw
                    exact = vecs[some] @ raw[r : r + 4 * STEP].T
                    if itself is not None:
                        exact[itself] = -3
                    sure.add(some, here, exact)
                    found.best = np.maximum(found.best, sure.best)
        sure.settle()
        found.best = np.maximum(found.best, sure.best)
        found.settle()

    first = index.nearby(vecs, block)
    visit(first)
    visit(index.promising(vecs, found.best - found.margin) & ~first)
    q, at = np.concatenate([found.q, sure.q]), np.concatenate([found.at, sure.at])
    x, cos = np.zeros(len(q), np.int64), np.full(len(q), -3.0)
    for b in np.unique(at >> BITS):
        here = np.flatnonzero(at >> BITS == b)
        other, names = index.vectors(int(b))
        for s in range(0, len(here), 16384):
            part = here[s : s + 16384]
            row = at[part] - (b << BITS)
            x[part], cos[part] = names[row], products(vecs[q[part]], other[row])
    good = cos >= lowest - 1e-7
    q, x, cos = q[good], x[good], cos[good]
    order = np.lexsort((x, -np.round(cos, 6), q))
    order = order[np.concatenate([[True], (q[order[1:]] != q[order[:-1]]) | (x[order[1:]] != x[order[:-1]])])] if len(order) else order
    q, x, cos = q[order], x[order], cos[order]
    near = np.arange(len(q)) - np.searchsorted(q, q) < k
    return pa.table({"q": pa.array(vids[q[near]], pa.int64()), "x": pa.array(x[near], pa.int64()), "cos": pa.array(cos[near], pa.float64())})


def neighbours(vectors: DataFrame, k: int, floor: float | None, scratch: Scratch) -> DataFrame:
    """(q, x, cos) of different vectors (vid, vec): x is among the k nearest of q found, their cosine at least ``floor``, if there is one.

    Every vector is a query and every vector is held by the index. Which pieces a query skips rests on the pieces' means
    and spreads, so the result is approximate; cosines are exact. A pair counts for both its ends, whichever found it.
    Cosines count to six digits, ties go to the smaller vid.
    """
    spark, n = vectors.sparkSession, vectors.count()
    schema = "q bigint, x bigint, cos double"
    if n < 2:
        return spark.createDataFrame([], schema)
    index, _ = indexed(vectors, n, scratch)
    found = scratch.put(index.each_block(spark, lambda block: scanned(index, block, k, floor), schema), "found")
    scratch.drop("index")
    scratch.drop("index-raw")
    # what a vector's admirers found matters only if it comes up to the vector's own k-th
    own = found.groupBy("q").agg(F.min("cos").alias("kth"), F.count(F.lit(1)).alias("n"))
    worth = own.select(F.col("q").alias("x"), F.when(F.col("n") >= k, F.col("kth")).otherwise(-2.0).alias("kth"))
    admired = skew_join(found, scratch.put(worth, "kth"), "x", "left", rows=n * k)
    admired = admired.filter(F.round("cos", 6) >= F.round(F.coalesce("kth", F.lit(-2.0)), 6))
    both = found.unionByName(admired.select(F.col("x").alias("q"), F.col("q").alias("x"), "cos")).groupBy("q", "x").agg(F.max("cos").alias("cos"))
    best = top_n(both, ["q"], [F.round("cos", 6).desc(), F.col("x")], k, F.col("x"))
    return scratch.put(best.select("q", "x", "cos"), "nearest")


def nearest_images(df: DataFrame, scratch: Scratch, k: int = 10, floor: float | None = 0.80) -> DataFrame:
    """(image_id, rank, other, cos): the k most similar other images of each usable embedding of ``df``, none below ``floor`` if there is one.

    Of equally similar ones (to six digits) the smaller image_id comes first. Images with equal vectors are
    searched once: only their k + 1 smallest ids can be among anyone's k most similar.
    """
    vectors, members = usable(df, scratch)
    near = neighbours(vectors, k + 1, floor, scratch)
    firsts = top_n(members, ["vid"], [F.col("image_id")], k + 1, F.col("image_id"))
    firsts = scratch.put(firsts.groupBy("vid").agg(F.collect_list("image_id").alias("ids")), "first-ids")  # k + 1 at most
    own = firsts.select(F.col("vid").alias("q"), F.explode("ids").alias("image_id"), F.lit(1.0).alias("cos"))
    others = skew_join(near, firsts.withColumnRenamed("vid", "x"), "x").select("q", F.explode("ids").alias("image_id"), F.round("cos", 6).alias("cos"))
    best = own.unionByName(others).withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("cos"), "image_id"))).filter(F.col("r") <= k + 1)
    lists = best.groupBy(F.col("q").alias("vid")).agg(F.sort_array(F.collect_list(F.struct("r", F.col("image_id").alias("id"), "cos"))).alias("best"))
    each = skew_join(members, scratch.put(lists, "lists"), "vid")
    mine = F.slice(F.filter("best", lambda b: b["id"] != F.col("image_id")), 1, k)
    rows = each.select("image_id", F.posexplode(mine).alias("pos", "b"))
    return rows.select("image_id", (F.col("pos") + 1).alias("rank"), F.col("b.id").alias("other"), F.col("b.cos").alias("cos"))


def similar_pairs(df: DataFrame, scratch: Scratch, k: int = 10, floor: float = 0.80) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of different images, one among the k most similar of the other; see ``nearest_images``."""
    pairs = nearest_images(df, scratch, k, floor)
    return pairs.select(F.least("image_id", "other").alias("id_a"), F.greatest("image_id", "other").alias("id_b")).distinct()


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of pictures of a cosine of 0.80 or more, one among the 10 most similar of the other."""
    return similar_pairs(spark.read.parquet(f"{sf}/image_vectors.parquet").select("image_id", "embedding"), Scratch(spark, "p4"))


def p4_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """The 10 most similar other pictures of each, however similar, by rank."""
    return nearest_images(spark.read.parquet(f"{sf}/image_vectors.parquet").select("image_id", "embedding"), Scratch(spark, "p4"), floor=None)


QUERIES = {"p4_found": p4_found, "p4_nearest": p4_nearest}

_NEAREST = f"""
WITH {UNIT_SQL},
p AS (SELECT a.image_id, b.image_id AS other, round(list_inner_product(a.w, b.w), 6) AS cos FROM u a JOIN u b ON a.image_id <> b.image_id WHERE list_inner_product(a.w, b.w) >= 0.8e0),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY cos DESC, other) AS rank FROM p)"""

ORACLES = {"p4_found": f"{_NEAREST} SELECT DISTINCT least(image_id, other) AS id_a, greatest(image_id, other) AS id_b FROM r WHERE rank <= 10"}
