"""Connected components by a two-dimensional grid.

Vertices are hashed into B blocks and an edge lies in the cell of its two blocks; a task runs union-find
over one cell. A vertex then meets the representatives it got in the cells of its row and column (2B - 1 at
most, however many links it has), takes one as its parent, and the representatives that met are the edges of the
next, much smaller, grid. That is repeated until no two representatives meet. B grows with the edges, so that a
cell stays within ``CELL_EDGES`` on average; a hub's links are spread over a whole row of cells. Who
represents others goes by a hash, not by the order of vertices, so chains of consecutive vertices shrink as fast as any.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.skew import skew_join
from corpusloom.session import Scratch, let_workers_import

#: Edges of a cell, on average; the grid of the first round has FIRST_BLOCKS blocks at least.
CELL_EDGES, FIRST_BLOCKS = 500_000, 4


def union_find(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of the edges (u, v), sorted, and the smallest vertex that each is linked with."""
    vertices, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    parent = np.arange(len(vertices))
    while True:
        ra, rb = parent[a], parent[b]
        open_ = ra != rb
        if not open_.any():
            return vertices, vertices[parent]
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def mixed(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit numbers that is different for different ones."""
    x = x.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x


def _cell(table: pa.Table) -> pa.Table:
    u, v = table["u"].to_numpy(), table["v"].to_numpy()
    own = np.unique(np.concatenate([u, v]))
    hashes = mixed(own)
    order = np.argsort(hashes)
    vertices, rep = union_find(mixed(u), mixed(v))  # in order of their hashes
    own = own[order]
    return pa.table({"v": pa.array(own, pa.int64()), "rep": pa.array(own[np.searchsorted(vertices, rep)], pa.int64())})


def connected(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, root) of each vertex of ``edges`` (u, v: bigint); root is the smallest vertex linked with v.

    Null ends and loops link nothing; repeated and reversed edges count once; without edges the result is empty.
    """
    let_workers_import(edges.sparkSession)
    pair = [F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")]
    clean = edges.filter("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(*pair).distinct()
    now = scratch.put(clean, "edges0")
    rounds: list[DataFrame] = []
    first = 0
    while n := now.count():
        first = first or n
        k = len(rounds)
        blocks = max(math.ceil(math.sqrt(2 * n / CELL_EDGES)), 1 if k else FIRST_BLOCKS)
        block = lambda c: F.pmod(F.xxhash64(c, F.lit(k)), F.lit(blocks))  # noqa: E731, B023
        cells = now.withColumns({"r": F.least(block("u"), block("v")), "c": F.greatest(block("u"), block("v"))})
        met = cells.groupBy("r", "c").applyInArrow(_cell, "v bigint, rep bigint")
        met = met.groupBy("v").agg(F.collect_set("rep").alias("reps"))  # 2 * blocks - 1 at most
        by_hash = F.array_min(F.transform("reps", lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("rep"))))
        met = scratch.put(met.select("v", by_hash["rep"].alias("m"), "reps"), f"met{k}")
        rounds.append(met.select("v", "m"))
        links = met.filter("size(reps) > 1").select(F.col("m").alias("u"), F.explode("reps").alias("v")).filter("u <> v")
        scratch.drop(f"edges{k}")
        now = scratch.put(links.select(*pair).distinct(), f"edges{k + 1}")
    if not rounds:
        return now.select("v", F.col("u").alias("root"))
    labels = rounds[-1].select("v", F.col("m").alias("root"))
    for parents in reversed(rounds[:-1]):
        later = labels.select(F.col("v").alias("m"), "root")
        labels = skew_join(parents, later, "m", "left", rows=2 * first).select("v", F.coalesce("root", "m").alias("root"))
    labels = scratch.put(labels, "roots")
    least = labels.groupBy("root").agg(F.min("v").alias("least"))
    return skew_join(labels, least, "root", rows=2 * first).select("v", F.col("least").alias("root"))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) of each vertex of ``edges`` (a, b; of any type that can be ordered): the smallest vertex linked with it.

    Null ends and loops link nothing; repeats count once.
    """
    links = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b").distinct()
    links = scratch.put(links, "links")
    # sorted, so that the smallest number of a component is its smallest vertex
    ids = links.select(F.explode(F.array("a", "b")).alias("id")).distinct().orderBy("id")
    ids = scratch.put(ids.withColumn("vid", F.monotonically_increasing_id()), "ids")
    numbered = skew_join(links, ids.select(F.col("id").alias("a"), F.col("vid").alias("u")), "a")
    numbered = skew_join(numbered, ids.select(F.col("id").alias("b"), F.col("vid").alias("v")), "b")
    labels = connected(numbered.select("u", "v"), scratch).join(ids.select("id", F.col("vid").alias("v")), "v")
    roots = ids.select(F.col("vid").alias("root"), F.col("id").alias("component"))
    return skew_join(labels.select("id", "root"), roots, "root").select("id", "component")
