"""Problem 2: records grouped into clusters of mutually similar ones.

Method: an approximate nearest-neighbour graph is built by neighbour descent and modularity-based
community detection runs on it. The graph starts within the blocks of the index and a few pieces of others; then every vector
is compared with its neighbours' neighbours until no list changes. Only lists of addresses are shuffled,
workers read the vectors they compare. Communities move record by record, then whole communities, until no level
gains modularity; a community's typical members are those of highest internal weighted degree.
Clusters need no graph: what is alike within a block of the index forms groups, every two groups are compared by their
means, and only those that may hold two alike vectors by these themselves. All pairs of vectors are covered that way.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.vectors import BITS, BLUR, MISSED, SPREAD, STEP, UNIT_SQL, Candidates, Files, Index, Raw, blobs, block_of, indexed, matrix, products, tail, usable
from corpusloom.operators.components import connected, union_find
from corpusloom.operators.skew import skew_join, top_n
from corpusloom.session import Scratch

#: Neighbours of a vector, and pieces of the index besides its block in which they are sought at the start.
NEIGHBOURS, STARTS = 10, 4
#: Modularity that a round of moves must gain to be followed by another.
GAIN = 1e-4

#: Tasks that compare the groups of a block, and of all blocks, at most.
RUNS, TASKS = 4, 2000
#: Groups from which on alike ones are merged before all are compared, draws of pivots for that, groups of a pivot, and pivots of a draw at most (25 MB in all).
MERGE_FROM, TABLES, MEETING, MOST_MEETING = 50_000, 8, 256, 2048
#: Rows of a task that merges, about; groups of a block of merged ones.
MEET_ROWS, NODES = 32_768, 4096
#: How many times the average squared distance from the mean a member may have.
FAR = 2.0
#: Vectors by which the spread of groups is measured, and the least that is taken for it.
MEASURES, LEAST_SPREAD = 256, 1.1

#: The part of an address that is the place in its block.
LOW = (1 << BITS) - 1
EDGE = "v bigint, w bigint, sim double"
LISTS = "v bigint, w array<bigint>, sim array<double>, fresh array<boolean>"


def _top(v: np.ndarray, w: np.ndarray, sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k most similar different w of each v, ties to the smaller w; in order of v, nearest first."""
    order = np.lexsort((w, v))
    order = order[np.concatenate([[True], (v[order[1:]] != v[order[:-1]]) | (w[order[1:]] != w[order[:-1]])])] if len(v) else order
    order = order[np.lexsort((w[order], -sim[order], v[order]))]
    v, w, sim = v[order], w[order], sim[order]
    near = np.arange(len(v)) - np.searchsorted(v, v) < k
    return v[near], w[near], sim[near]


def _edges(v: np.ndarray, w: np.ndarray, sim: np.ndarray) -> pa.Table:
    return pa.table({"v": pa.array(v, pa.int64()), "w": pa.array(w, pa.int64()), "sim": pa.array(sim, pa.float64())})


def _lists(v: np.ndarray, w: np.ndarray, sim: np.ndarray, fresh: np.ndarray) -> pa.Table:
    """Edges in order of v as a row a v."""
    names, start = np.unique(v, return_index=True)
    offsets = pa.array(np.append(start, len(v)).astype(np.int32))
    columns = {"v": pa.array(names, pa.int64()), "w": pa.ListArray.from_arrays(offsets, pa.array(w, pa.int64()))}
    columns |= {"sim": pa.ListArray.from_arrays(offsets, pa.array(sim, pa.float64())), "fresh": pa.ListArray.from_arrays(offsets, pa.array(fresh, pa.bool_()))}
    return pa.table(columns)


def _flat(table: pa.Table | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The edges of lists."""
    if table is None or not table.num_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    table = table.combine_chunks()
    w = table["w"].chunk(0)
    return np.repeat(table["v"].to_numpy(), np.diff(w.offsets.to_numpy())), w.flatten().to_numpy(), table["sim"].chunk(0).flatten().to_numpy()


def _coded(v: np.ndarray, w: np.ndarray, old_v: np.ndarray, old_w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One number for each pair (v, w), the same for equal pairs of either side; all v are of one block."""
    names, at = np.unique(np.concatenate([w, old_w]), return_inverse=True)
    codes = (np.concatenate([v, old_v]) & LOW) * max(len(names), 1) + at
    return codes[: len(v)], codes[len(v) :]


def started(index: Index, block: int, floor: float, k: int) -> pa.Table | None:
    """Lists of the k nearest of each vector of a block within it and in STARTS pieces nearby, cosines exact and at least ``floor``."""
    x = index.raw.read(block)
    if not len(x):
        return None
    own, found = np.int64(block) << BITS, Candidates(len(x), k, floor, BLUR)
    for b, queries, rows in index.visits(index.nearby(x, block, STARTS)):
        other, at = index.raw.read(b)[rows], (np.int64(b) << BITS) + rows
        for s in range(0, len(queries), STEP):
            some = queries[s : s + STEP]
            cos = x[some] @ other.T
            if b == block:
                cos[(own + some)[:, None] == at[None]] = -3  # itself
            found.add(some, at, cos)
    found.settle()
    exact = np.empty(len(found.q))
    for b in np.unique(found.at >> BITS):
        here, other = np.flatnonzero(found.at >> BITS == b), index.raw.read(int(b))
        exact[here] = products(x[found.q[here]], other[found.at[here] & LOW])
    good = exact >= floor
    v, w, sim = _top(own + found.q[good], found.at[good], exact[good], k)
    return _lists(v, w, sim, np.ones(len(v), bool))


def met(index: Index, state: Files, worsts: Raw, block: int, routes: pa.Table | None, floor: float, k: int) -> pa.Table:
    """Edges (v, w, sim) that improve a list: neighbours of one vector of the block, and each v of ``routes`` (v, xs; of the block) with its xs.

    Pairs of which both have heard before are left out; an edge comes both ways if it improves both lists.
    """
    mine = state.read(block, ["v", "w", "sim", "fresh"])
    of, w, _ = _flat(mine)
    fresh = mine["fresh"].combine_chunks().flatten().to_numpy(zero_copy_only=False) if len(of) else np.zeros(0, bool)
    at = np.arange(len(of))
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(1, k):  # those d places apart in the list of one vector
        here = at[: max(len(of) - d, 0)]
        here = here[(of[here] == of[here + d]) & (fresh[here] | fresh[here + d])]
        a.append(w[here])
        b.append(w[here + d])
    if routes is not None:
        xs = routes["xs"].combine_chunks()
        v, x = np.repeat(routes["v"].to_numpy(), np.diff(xs.offsets.to_numpy())), xs.flatten().to_numpy()
        codes, known = _coded(v, x, of, w)
        codes, first = np.unique(codes, return_index=True)
        first = first[~np.isin(codes, known) & (v[first] != x[first])]
        a.append(v[first])
        b.append(x[first])
    a, b = np.concatenate(a), np.concatenate(b)
    a, b = np.minimum(a, b), np.maximum(a, b)
    names, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    pairs = np.unique(place[: len(a)] * max(len(names), 1) + place[len(a) :])
    ia, ib = np.divmod(pairs, max(len(names), 1))
    vecs, worst = np.empty((len(names), index.dim), "<f4"), np.full(len(names), floor)
    blocks, first = np.unique(names >> BITS, return_index=True)
    for other, s, e in zip(blocks, first, np.append(first[1:], len(names))):
        vecs[s:e] = index.raw.take(int(other), names[s:e] & LOW)
        least = worsts.read(int(other))[:, 0]
        known = (names[s:e] & LOW) < len(least)
        worst[s:e][known] = least[names[s:e][known] & LOW]
    vs, ws, ss = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for p in range(0, len(pairs), 16384):
        i, j = ia[p : p + 16384], ib[p : p + 16384]
        near = np.einsum("ij,ij->i", vecs[i], vecs[j]) >= np.minimum(worst[i], worst[j]) - BLUR
        i, j = i[near], j[near]
        exact = products(vecs[i], vecs[j])
        for c, d in ((i, j), (j, i)):
            good = exact >= worst[c]
            vs.append(names[c[good]])
            ws.append(names[d[good]])
            ss.append(exact[good])
    return _edges(*_top(np.concatenate(vs), np.concatenate(ws), np.concatenate(ss), k))


def worst_of(lists: pa.Table | None, floor: float, k: int) -> np.ndarray:
    """The least similarity that gets into the list of each row of a block, by place, up to the last that has one."""
    heads, _, sims = _flat(lists)
    out = np.full(int(heads[-1] & LOW) + 1 if len(heads) else 0, floor)
    if len(heads):
        who, start, n = np.unique(heads, return_index=True, return_counts=True)
        out[who & LOW] = np.where(n >= k, np.minimum.reduceat(sims, start), floor)
    return out


def improved(state: Files, block: int, found: pa.Table, k: int) -> pa.Table:
    """The lists of a block with the edges ``found`` (v, w, sim) for it."""
    old_v, old_w, old_sim = _flat(state.read(block, ["v", "w", "sim"]))
    sides = [(old_v, found["v"]), (old_w, found["w"]), (old_sim, found["sim"])]
    v, w, sim = _top(*(np.concatenate([a, b.to_numpy()]) for a, b in sides), k)
    codes, old = _coded(v, w, old_v, old_w)
    return _lists(v, w, sim, ~np.isin(codes, old))


def graph_of(index: Index, spark: SparkSession, floor: float, scratch: Scratch, k: int = NEIGHBOURS) -> DataFrame:
    """(v, w, sim): for each vector, by address, the k nearest found by neighbour descent, cosines exact and at least ``floor``.

    In each round the neighbours of a vector hear of each other, and the vector of their neighbours, unless both links are
    old; who is nearer than the farthest neighbour of either takes its place. Rounds end when no list changes, which comes, as lists only improve.
    """

    def by_block(rows: DataFrame, run, schema: str) -> DataFrame:  # noqa: ANN001
        """``run(block, its rows or none)`` for every block; ``rows`` start with their block."""
        filled = ["bigint(null)" if f.dataType.simpleString() == "bigint" else f"CAST(NULL AS {f.dataType.simpleString()})" for f in rows.schema.fields[1:]]
        every = spark.range(0, index.blocks, 1, 1).selectExpr("int(id) AS block", *[f"{c} AS `{n}`" for c, n in zip(filled, rows.columns[1:])])

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches([b for b in batches if b.num_rows])
            for block in pa.compute.unique(whole["block"]).to_pylist():
                own = whole.filter(pa.compute.and_(pa.compute.equal(whole["block"], block), pa.compute.is_valid(whole["v"])))
                yield from run(block, own if own.num_rows else None).to_batches()

        return rows.unionByName(every).repartitionById(index.blocks, "block").mapInArrow(task, schema)

    root = scratch.root

    def noted(t: int, block: int, lists: pa.Table | None) -> pa.Table | None:
        """``lists``, after writing what gets into them for the workers of the round."""
        for _ in Raw(f"{root}/worst{t}", "<f8", 1).write(block, iter([worst_of(lists, floor, k)])):
            pass
        return lists

    lists = scratch.put(index.each_block(spark, lambda block: noted(0, block, started(index, block, floor, k)), LISTS), "lists0")
    t = 0
    while lists.filter(F.exists("fresh", lambda f: f)).limit(1).count():
        state, worsts = Files(scratch, f"lists{t}"), Raw(f"{root}/worst{t}", "<f8", 1)
        heard = lists.select("v", F.explode(F.arrays_zip("w", "fresh")).alias("e")).select("v", F.col("e.w").alias("mid"), F.col("e.fresh").alias("fresh"))
        told = lists.select(F.col("v").alias("mid"), "w", F.transform(F.filter(F.arrays_zip("w", "fresh"), lambda e: e["fresh"]), lambda e: e["w"]).alias("news"))
        routes = skew_join(heard, told, "mid", rows=index.rows * k).select(block_of("v").alias("block"), "v", F.when(F.col("fresh"), F.col("w")).otherwise(F.col("news")).alias("xs"))
        found = by_block(routes.filter("size(xs) > 0"), lambda b, rows, state=state, worsts=worsts: met(index, state, worsts, b, rows, floor, k), EDGE)
        found = found.select(block_of("v").alias("block"), "v", "w", "sim")
        empty = _edges(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        better = by_block(found, lambda b, rows, state=state, t=t: noted(t + 1, b, improved(state, b, empty if rows is None else rows, k)), LISTS)
        lists = scratch.put(better, f"lists{t + 1}")
        scratch.drop(f"lists{t}")
        scratch.drop(f"worst{t}")
        t += 1
    edges = lists.select("v", F.explode(F.arrays_zip("w", "sim")).alias("e"))
    return edges.select("v", F.col("e.w").alias("w"), F.col("e.sim").alias("sim"))


class Joined:
    """Names that turn out to be of one group, as far as one task knows."""

    def __init__(self) -> None:
        self.old, self.new = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def now(self, r: np.ndarray) -> np.ndarray:
        if not len(self.old):
            return r
        at = np.minimum(np.searchsorted(self.old, r), len(self.old) - 1)
        return np.where(self.old[at] == r, self.new[at], r)

    def join(self, u: np.ndarray, v: np.ndarray) -> None:
        if len(u):
            self.old, self.new = union_find(np.concatenate([self.old, u]), np.concatenate([self.new, v]))

    def links(self) -> pa.Table:
        less = self.old != self.new
        return pa.table({"u": pa.array(self.old[less], pa.int64()), "v": pa.array(self.new[less], pa.int64())})


def _alike(x: np.ndarray, y: np.ndarray, mine: np.ndarray, theirs: np.ndarray, joined: Joined, floor: float) -> None:
    """Join the groups ``mine`` of the rows of ``x`` and ``theirs`` of ``y`` where a cosine is at least ``floor``."""
    for r in range(0, len(x), STEP):
        for s in range(0, len(y), STEP):
            cos = x[r : r + STEP] @ y[s : s + STEP].T
            p, q = joined.now(mine[r : r + STEP]), joined.now(theirs[s : s + STEP])
            at, hit = np.nonzero((cos >= floor - BLUR) & (p[:, None] != q[None]))
            good = cos[at, hit] >= floor + BLUR
            for c in np.array_split(np.flatnonzero(~good), len(at) // 16384 + 1):
                good[c] = products(x[r + at[c]], y[s + hit[c]]) >= floor
            joined.join(p[at[good]], q[hit[good]])


def _means(x: np.ndarray, of: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mean of each group of the rows of ``x``, ``of`` telling whose they are and ``n`` their numbers, and each row's squared distance from its own."""
    order = np.argsort(of, kind="stable")
    mean = (np.add.reduceat(x[order], np.concatenate([[0], np.cumsum(n)[:-1]]), axis=0, dtype=np.float64) / n[:, None]).astype("<f4")
    return mean, np.where(n[of] > 1, ((x - mean[of]) ** 2).sum(1, dtype=np.float64), 0.0)


def rooted(index: Index, block: int, floor: float) -> pa.Table | None:
    """(at, root, grp) of the vectors of a block: the components of what is alike within it, and those parts of them that have a mean of use.

    Members whose squared distance from the mean is over FAR times the average are a part each.
    """
    x = index.raw.read(block)
    if not len(x):
        return None
    own, joined = (np.int64(block) << BITS) + np.arange(len(x)), Joined()
    for s in range(0, len(x), STEP):
        _alike(x[s : s + STEP], x[: s + STEP], own[s : s + STEP], own[: s + STEP], joined, floor)
    grp = joined.now(own)
    root, new = grp.copy(), np.ones(1, bool)
    while new.any():
        _, of, n = np.unique(root, return_inverse=True, return_counts=True)
        far = _means(x, of, n)[1]
        new = (n[of] > 1) & (far > FAR * (np.bincount(of, far) / n)[of] + BLUR)
        root[new] = own[new]
        left = np.flatnonzero(~new)  # parts go by their smallest member
        first = np.full(len(n), np.iinfo(np.int64).max)
        np.minimum.at(first, of[left], own[left])
        root[left] = first[of[left]]
    return pa.table({"at": pa.array(own), "root": pa.array(root), "grp": pa.array(grp)})


def measured(index: Index, roots: Files, means: Raw, block: int) -> pa.Table | None:
    """(root, n, square, far, spread) of the groups of a block, whose means are written, longest first: members, squared length, most squared distance of a member.

    spread is by how much products of MEASURES vectors of the next block with what tells members from their mean exceed those of random directions.
    """
    x = index.raw.read(block)
    if not len(x):
        return None
    names, of, n = np.unique(roots.read(block, ["root"])["root"].to_numpy(), return_inverse=True, return_counts=True)
    mean, far = _means(x, of, n)
    most = np.zeros(len(names))
    np.maximum.at(most, of, far)
    square = np.where(n == 1, 1.0, np.minimum((mean.astype(np.float64) ** 2).sum(1), 1))
    order = np.argsort(-square, kind="stable")
    for _ in means.write(block, iter([mean[order]])):
        pass
    spread, rows = None, np.flatnonzero((n[of] >= 4) & (far > 1e-3))
    if len(rows) >= 200:
        other = next(y for k in range(1, index.blocks + 1) if len(y := index.raw.read((block + k) % index.blocks)))
        some = other[:: max(1, len(other) // MEASURES)]
        apart = (x[rows] - mean[of[rows]]) / np.sqrt(far[rows] / index.dim)[:, None]
        foreign = x[rows] @ some.T < 0.4  # members of the same group are no measure
        squares, seen = np.where(foreign, (apart @ some.T) ** 2, 0).sum(0), foreign.sum(0)
        if (seen >= 200).any():
            spread = float(np.sqrt(squares[seen >= 200] / seen[seen >= 200]).max())
    columns = {"root": pa.array(names[order], pa.int64()), "n": pa.array(n[order], pa.int64()), "square": pa.array(square[order]), "far": pa.array(most[order])}
    return pa.table(columns | {"spread": pa.array([spread] * len(names), pa.float64())})


class Nodes:
    """Groups of alike vectors, each of one block, by their root: their means in raw files, and who belongs to each.

    The product of two groups' means is the mean of their members' products: from the floor on, some two members are
    alike. Below, how far the best of them may exceed it follows from how far members are from the means; only groups that may hold
    two alike have their members compared. Lone vectors are their own mean, so their product is exact.
    """

    #: Members of the block of groups at hand.
    held: tuple | None = None

    def __init__(self, index: Index, spark: SparkSession, scratch: Scratch, name: str, floor: float):
        self.index, self.floor, self.blocks, self.owned = index, floor, index.blocks, Files(scratch, name)
        self.raw = Raw(f"{scratch.root}/{name}-means", "<f4", index.dim)
        owned, raw = self.owned, self.raw
        schema = "root bigint, n bigint, square double, far double, spread double"
        table = scratch.put(index.each_block(spark, lambda block: measured(index, owned, raw, block), schema), f"{name}-nodes")
        self.files = Files(scratch, f"{name}-nodes")
        self.count, spread = table.agg(F.count(F.lit(1)), F.max("spread")).first()
        self.spread = SPREAD if spread is None else max(LEAST_SPREAD, spread)
        self.reach = float(tail(np.array([2 * MISSED / max(index.rows, 2) ** 2]))[0]) * self.spread / np.sqrt(index.dim)

    def read(self, block: int) -> tuple[np.ndarray, ...]:
        """(root, squared length, distance, mean) of the groups of a block, longest first."""
        t = self.files.read(block, ["root", "square", "far"])
        if t is None:
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros((0, self.index.dim), "<f4")
        return *(t[c].to_numpy() for c in ("root", "square", "far")), self.raw.read(block)

    def members(self, block: int, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(root, vector) of the members of ``roots`` of a block, by root."""
        t = self.owned.read(block, ["root", "at"])
        root, at = t["root"].to_numpy(), t["at"].to_numpy()
        mine = np.isin(root, roots)
        order = np.argsort(root[mine], kind="stable")
        return root[mine][order], self.index.raw.take(block, at[mine][order] & LOW)

    def compared(self, i: int, a: tuple[np.ndarray, ...], j: int, joined: Joined) -> None:
        """Join the groups ``a`` of block ``i`` with those of block ``j`` that hold vectors alike to theirs."""
        b = a if i == j else self.read(j)
        reach = lambda sa, fa, sb, fb: self.reach * np.sqrt(sa * fb + sb * fa + fa * fb)
        maybe = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for s in range(0, len(a[0]), STEP):
            ra, sa, fa, xa = (c[s : s + STEP] for c in a)
            for r in range(s if i == j else 0, len(b[0]), STEP):
                rb, sb, fb, xb = (c[r : r + STEP] for c in b)
                cos = xa @ xb.T
                at, hit = np.divmod(np.flatnonzero(cos >= np.float32(self.floor - BLUR - reach(sa[0], fa.max(), sb[0], fb.max()))), len(rb))
                near = cos[at, hit]
                may = near >= self.floor - BLUR - reach(sa[at], fa[at], sb[hit], fb[hit])
                at, hit, near = at[may], hit[may], near[may]
                u, v = joined.now(ra[at]), joined.now(rb[hit])
                apart = u != v
                sure = apart & (near >= self.floor + BLUR)
                joined.join(u[sure], v[sure])
                maybe.append((s + at[apart & ~sure], r + hit[apart & ~sure]))
        at, hit = (np.concatenate(m) for m in zip(*maybe))
        apart = joined.now(a[0][at]) != joined.now(b[0][hit])
        if apart.any():
            self._members(i, a, at[apart], j, b, hit[apart], joined)

    def _members(self, i: int, a: tuple[np.ndarray, ...], at: np.ndarray, j: int, b: tuple[np.ndarray, ...], hit: np.ndarray, joined: Joined) -> None:
        """Compare the members of the groups ``at`` of block ``i`` with the means of the groups ``hit`` of block ``j``, and with their members where these may be alike."""
        if self.held is None or self.held[0] != i:
            self.held = (i, *self.members(i, a[0]))
        roots_u, xs = self.held[1:]
        order = np.argsort(at, kind="stable")
        at, hit = at[order], hit[order]
        least = self.floor - BLUR - self.reach * np.sqrt(b[2])
        names, first = np.unique(at, return_index=True)
        kept = np.zeros(len(at), bool)
        for k, s, e in zip(names, first, np.append(first[1:], len(at))):
            x = xs[slice(*np.searchsorted(roots_u, [a[0][k], a[0][k] + 1]))]
            for r in range(s, e, STEP):
                some = hit[r : min(r + STEP, e)]
                for q in range(0, len(x), STEP):
                    kept[r : r + len(some)] |= (x[q : q + STEP] @ b[3][some].T >= least[some]).any(0)
        if not kept.any():
            return
        at, v = at[kept], b[0][hit[kept]]
        roots_v, ys = self.members(j, np.unique(v))
        names, first = np.unique(at, return_index=True)
        for k, s, e in zip(names, first, np.append(first[1:], len(at))):
            others = v[s:e][joined.now(v[s:e]) != joined.now(a[0][k : k + 1])]
            p, q = slice(*np.searchsorted(roots_u, [a[0][k], a[0][k] + 1])), np.isin(roots_v, others)
            _alike(xs[p], ys[q], roots_u[p], roots_v[q], joined, self.floor)

    def alike(self, spark: SparkSession) -> DataFrame:
        """(u, v): links of all groups that hold alike vectors; every two groups are compared."""
        runs = max(1, min(RUNS, TASKS // max(1, self.blocks)))

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    i, run = divmod(k, runs)
                    a, joined = self.read(i), Joined()
                    if len(a[0]):
                        for d in range(run, self.blocks // 2 + 1, runs):  # a ring: each two blocks meet once
                            if 2 * d != self.blocks or i < d or not d:
                                self.compared(i, a, (i + d) % self.blocks, joined)
                    yield from joined.links().to_batches()

        return spark.range(0, self.blocks * runs, 1, self.blocks * runs).mapInArrow(task, "u bigint, v bigint")


def taken(raw: Raw, at: np.ndarray) -> np.ndarray:
    """The rows of ``raw`` at some addresses."""
    out, order = np.empty((len(at), raw.width), raw.kind), np.argsort(at, kind="stable")
    blocks, first = np.unique(at[order] >> BITS, return_index=True)
    for b, s, e in zip(blocks, first, np.append(first[1:], len(at))):
        out[order[s:e]] = raw.take(int(b), at[order[s:e]] & LOW)
    return out


def meetings(nodes: Nodes, spark: SparkSession) -> DataFrame:
    """(u, v): links of groups that are alike by their means and have a nearest pivot in common, in one of TABLES draws of pivots.

    This only makes groups fewer before every two of them are compared, so nothing hangs on whom it finds.
    """
    index, size, floor = nodes.index, min(MOST_MEETING, max(16, nodes.count // MEETING)), nodes.floor
    few = -(-size * TABLES // nodes.blocks)

    def some(block: int) -> pa.Table | None:
        mean = nodes.read(block)[-1]
        return pa.table({"vec": blobs(mean[:: max(1, len(mean) // few)][:few])}) if len(mean) else None

    found = np.stack([np.frombuffer(r.vec, "<f4") for r in index.each_block(spark, some, "vec binary").collect()])
    found /= np.linalg.norm(found, axis=1, keepdims=True)
    pivots = spark.sparkContext.broadcast(np.array_split(found[np.random.default_rng(1).permutation(len(found))], TABLES))

    def place(block: int) -> pa.Table | None:
        root, _, _, mean = nodes.read(block)
        if not len(root):
            return None
        at, start, out = (np.int64(block) << BITS) + np.arange(len(root)), 0, []
        for p in pivots.value:
            if len(p):
                near = np.concatenate([(mean[s : s + STEP] @ p.T).argmax(1) for s in range(0, len(mean), STEP)])
                out.append(pa.table({"bucket": pa.array(start + near, pa.int64()), "at": pa.array(at), "root": pa.array(root)}))
            start += len(p)
        return pa.concat_tables(out).combine_chunks()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def links() -> Iterator[pa.RecordBatch]:
            bucket, at, root = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in range(3))
            x, us, vs = taken(nodes.raw, at), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            names, first = np.unique(bucket, return_index=True)
            for s, e in zip(first, np.append(first[1:], len(bucket))):
                for r in range(s, e, STEP):
                    u, v = np.nonzero(x[r : min(r + STEP, e)] @ x[r:e].T >= floor + BLUR)
                    us.append(root[r + u[u < v]])
                    vs.append(root[r + v[u < v]])
            joined = Joined()
            joined.join(np.concatenate(us), np.concatenate(vs))
            yield from joined.links().to_batches()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if sum(b.num_rows for b in held) >= MEET_ROWS:
                    yield from links()
                    held = []
        if held:
            yield from links()

    tasks = max(12, -(-nodes.count * TABLES // MEET_ROWS))
    placed = index.each_block(spark, place, "bucket bigint, at bigint, root bigint")
    return placed.repartition(tasks, "bucket").sortWithinPartitions("bucket", "at").mapInArrow(meet, "u bigint, v bigint")


class Merged(Nodes):
    """Groups of groups known to be alike; parts far from the mean stay groups of their own."""

    def __init__(self, nodes: Nodes, spark: SparkSession, scratch: Scratch, joins: DataFrame):
        self.index, self.floor, self.reach, self.count = nodes.index, nodes.floor, nodes.reach, nodes.count
        index, dim = nodes.index, nodes.index.dim
        scratch.put(joins.select(block_of("root").alias("block"), "root", "next").repartitionById(index.blocks, "block").select("root", "next"), "moves")
        moves = Files(scratch, "moves")
        fewer = max(1, nodes.count - joins.filter("root <> next").count())
        self.blocks = max(-(-fewer // NODES), min(index.blocks, 24))
        self.raw = raw = Raw(f"{scratch.root}/merged-means", "<f4", dim)

        def parts(block: int) -> pa.Table | None:
            t, mean = nodes.files.read(block, ["root", "n", "square", "far"]), nodes.read(block)[-1]
            if t is None:
                return None
            root, own, moved = t["root"].to_numpy(), nodes.owned.read(block, ["root", "at"]), moves.read(block, ["root", "next"])
            to = root.copy()
            if moved is not None and moved.num_rows:
                old, new = moved["root"].to_numpy(), moved["next"].to_numpy()
                order = np.argsort(old)
                old, new = old[order], new[order]
                place = np.minimum(np.searchsorted(old, root), len(old) - 1)
                to = np.where(old[place] == root, new[place], root)
            r, at = own["root"].to_numpy(), own["at"].to_numpy()
            by = np.argsort(r, kind="stable")
            r, at = r[by], at[by]
            rank = np.argsort(root)  # lists lie in order of the roots
            lists = pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(r, root[rank]), len(r)).astype(np.int32)), pa.array(at, pa.int64()))
            columns = {"next": pa.array(to[rank], pa.int64()), "root": pa.array(root[rank], pa.int64())}
            columns |= {c: pa.array(t[c].to_numpy()[rank]) for c in ("n", "square", "far")}
            return pa.table(columns | {"members": lists, "mean": blobs(mean[rank])})

        def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole = [b for b in batches if b.num_rows]
            if not whole:
                return
            t = pa.Table.from_batches(whole).combine_chunks()
            mean, n, far, square, id_ = matrix(t["mean"], dim), *(t[c].to_numpy() for c in ("n", "far", "square")), t["next"].to_numpy().copy()
            root, new = t["root"].to_numpy(), np.ones(1, bool)
            lists = t["members"].combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            x, owner = taken(index.raw, lists.flatten().to_numpy()), np.repeat(np.arange(len(n)), n)
            while new.any():
                _, of, k = np.unique(id_, return_inverse=True, return_counts=True)
                order, start = np.argsort(of, kind="stable"), np.concatenate([[0], np.cumsum(k)[:-1]])
                total = np.bincount(of, n)
                middle = (np.add.reduceat((mean * n[:, None])[order], start, axis=0, dtype=np.float64) / total[:, None]).astype("<f4")
                single = k == 1
                middle[single] = mean[order[start[single]]]
                length = np.where(single, square[order[start]], np.minimum((middle.astype(np.float64) ** 2).sum(1), 1))
                reached = np.zeros(len(n))
                for s in range(0, len(x), STEP):
                    np.maximum.at(reached, owner[s : s + STEP], ((x[s : s + STEP] - middle[of[owner[s : s + STEP]]]) ** 2).sum(1, dtype=np.float64))
                reached = np.where(single[of], far, reached)
                new = ~single[of] & (reached > FAR * (1 - length)[of] + BLUR)
                id_[new] = -1 - root[new]  # apart from any other
            most = np.zeros(len(k))
            np.maximum.at(most, of, reached)
            rank = np.argsort(-length, kind="stable")
            for _ in raw.write(whole[0].column(0)[0].as_py(), iter([middle[rank]])):
                pass
            # members group by group, named by a part of each
            lists = lists.take(pa.array(order))
            ends = np.append(start, len(order))
            whole_lists = pa.ListArray.from_arrays(pa.array(lists.offsets.to_numpy()[ends].astype(np.int32)), lists.values)
            yield from pa.table({"root": pa.array(root[order[start]][rank]), "square": pa.array(length[rank]), "far": pa.array(most[rank]), "members": whole_lists.take(pa.array(rank))}).to_batches()

        part = F.pmod(F.xxhash64("next"), F.lit(self.blocks)).cast("int").alias("block")
        rows = index.each_block(spark, parts, "next bigint, root bigint, n bigint, square double, far double, members array<bigint>, mean binary")
        rows = rows.select(part, "*").repartitionById(self.blocks, "block").sortWithinPartitions("root")
        scratch.put(rows.mapInArrow(store, "root bigint, square double, far double, members array<bigint>"), "merged")
        self.files = Files(scratch, "merged")

    def members(self, block: int, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t = self.files.read(block, ["root", "members"])
        t = t.filter(pa.array(np.isin(t["root"].to_numpy(), roots))).sort_by("root").combine_chunks()
        lists = t["members"].chunk(0)
        n = np.diff(lists.offsets.to_numpy())
        return np.repeat(t["root"].to_numpy(), n), taken(self.index.raw, lists.flatten().to_numpy())


def _labelled(index: Index, spark: SparkSession, scratch: Scratch, floor: float) -> DataFrame:
    """(at, root) of every vector: the components of all that are alike."""
    labels = scratch.put(index.each_block(spark, lambda block: rooted(index, block, floor), "at bigint, root bigint, grp bigint"), "labels")
    nodes = Nodes(index, spark, scratch, "labels", floor)
    links = labels.filter("root <> grp").select(F.col("root").alias("u"), F.col("grp").alias("v"))
    if nodes.count >= MERGE_FROM:
        met = scratch.put(connected(meetings(nodes, spark), Scratch(spark, "p2-met")), "met").select(F.col("v").alias("root"), F.col("root").alias("next"))
        nodes = Merged(nodes, spark, scratch, met)
        links = links.unionByName(met.select(F.col("root").alias("u"), F.col("next").alias("v")))
    links = links.unionByName(nodes.alike(spark))
    joins = connected(links, Scratch(spark, "p2-joined")).select(F.col("v").alias("root"), F.col("root").alias("next"))
    return scratch.put(skew_join(labels.select("at", "root"), joins, "root", "left", rows=index.rows).select("at", F.coalesce("next", "root").alias("root")), "clusters")


def communities(graph: DataFrame, scratch: Scratch) -> tuple[DataFrame, float]:
    """((v, community) of the vertices of the undirected ``graph`` (v, w, sim), modularity of that division).

    Half of the nodes, by hash, move in each round to the neighbouring community of highest gain in modularity (ties
    to the smaller one), as long as two rounds gain GAIN; the best division so far counts. Then communities are the nodes of the next level,
    until a level gains nothing. A graph without edges has modularity 0.
    """
    both = graph.unionByName(graph.select(F.col("w").alias("v"), F.col("v").alias("w"), "sim")).filter("v <> w")
    links = scratch.put(both.groupBy("v", "w").agg(F.max("sim").alias("sim")), "level0")
    total = links.agg(F.sum("sim")).first()[0]  # twice the weight of all edges
    if not total:
        return links.select("v", F.col("v").alias("community")), 0.0
    labels, reached, level = scratch.put(links.select("v").distinct().select("v", F.col("v").alias("community")), "names0"), None, 0
    while True:
        nodes, value = moved(links, float(total), scratch, level)
        if reached is not None and value < reached + GAIN:
            return labels, reached
        reached, level = value, level + 1
        nodes = nodes.select(F.col("v").alias("community"), F.col("community").alias("next"))
        labels = scratch.put(skew_join(labels, nodes, "community").select("v", F.col("next").alias("community")), f"names{level}")
        scratch.drop(f"names{level - 1}")
        ends = [nodes.select(F.col("community").alias(c), F.col("next").alias(f"to_{c}")) for c in ("v", "w")]
        links = skew_join(skew_join(links, ends[0], "v"), ends[1], "w").groupBy(F.col("to_v").alias("v"), F.col("to_w").alias("w")).agg(F.sum("sim").alias("sim"))
        links = scratch.put(links, f"level{level}")


def moved(links: DataFrame, total: float, scratch: Scratch, level: int) -> tuple[DataFrame, float]:
    """((v, community), modularity): the nodes of ``links`` (v, w, sim: both ways, a node's own weight as v = w) after rounds of moves."""
    rows, loops = links.agg(F.count(F.lit(1)), F.sum(F.when(F.col("v") == F.col("w"), F.col("sim")).otherwise(0.0))).first()
    other = links.filter("v <> w")
    nodes = scratch.put(links.groupBy("v").agg(F.sum("sim").alias("degree")).select("v", F.col("v").alias("community"), "degree"), f"nodes{level}-0")
    values: list[float] = []
    kept = nodes
    while len(values) < 3 or values[-1] > values[-3] + GAIN:
        k = len(values)
        sizes = nodes.groupBy("community").agg(F.sum("degree").alias("weight"))
        near = skew_join(other, nodes.select(F.col("v").alias("w"), "community"), "w", rows=rows).select("v", "community", F.col("sim").alias("towards"))
        near = near.unionByName(nodes.select("v", "community", F.lit(0.0).alias("towards"))).groupBy("v", "community").agg(F.sum("towards").alias("towards"))
        near = skew_join(near, sizes, "community", rows=2 * rows).join(nodes.select("v", F.col("community").alias("own"), "degree"), "v")
        mine = F.col("community") == F.col("own")
        gain = F.round(F.col("towards") - F.col("degree") * (F.col("weight") - F.when(mine, F.col("degree")).otherwise(0.0)) / total, 9)
        new = near.groupBy("v").agg(
            F.min(F.struct((-gain).alias("g"), (~mine).alias("moves"), "community"))["community"].alias("to"), F.min("own").alias("own"), F.min("degree").alias("degree"), F.sum(F.when(mine, F.col("towards"))).alias("held")
        )
        moving = F.pmod(F.xxhash64("v", F.lit(k)), F.lit(2)) == 0
        new = scratch.put(new.select("v", F.when(moving, F.col("to")).otherwise(F.col("own")).alias("community"), "degree", "held"), f"nodes{level}-{k + 1}")
        # what the nodes were held by gives the modularity of where they were
        squares = sizes.agg(F.sum(F.col("weight") * F.col("weight"))).first()[0]
        values.append((new.agg(F.sum("held")).first()[0] + loops) / total - squares / total**2)
        if values[-1] >= max(values):
            kept = nodes
        nodes = new
    return kept.select("v", "community"), max(values)


def degrees(graph: DataFrame, groups: DataFrame, copies: DataFrame) -> DataFrame:
    """(v, grp, inside) of each vertex of ``groups`` (v, grp): its weighted degree within its group; each vector counts as often as ``copies`` (v, copies) has it."""
    both = graph.unionByName(graph.select(F.col("w").alias("v"), F.col("v").alias("w"), "sim")).groupBy("v", "w").agg(F.max("sim").alias("sim"))
    ends = groups.join(copies, "v").select(F.col("v").alias("w"), F.col("grp").alias("other"), "copies")
    of = skew_join(skew_join(both, groups, "v"), ends, "w").filter("grp = other").groupBy("v").agg(F.sum(F.col("sim") * F.col("copies")).alias("inside"))
    each = groups.join(copies, "v").join(of, "v", "left")
    return each.select("v", "grp", (F.coalesce("inside", F.lit(0.0)) + F.col("copies") - 1).alias("inside"))


class Graph:
    """The neighbour graph of the usable embeddings of a table (image_id, embedding), by address, and who has which vector."""

    def __init__(self, df: DataFrame, scratch: Scratch, floor: float = 0.47, dim: int = 384):
        self.scratch, self.floor, self.spark = scratch, floor, df.sparkSession
        vectors, named = usable(df, scratch, dim)
        self.rows = vectors.count()
        if self.rows:
            self.index, self.table = indexed(vectors, self.rows, scratch)
            scratch.drop("vectors")
            at = self.table.select("vid", F.col("at").alias("v"))
            self.members = scratch.put(skew_join(named, at, "vid").select("v", "image_id"), "named")
        else:
            self.table = self.spark.createDataFrame([], "at bigint, vid bigint")
            self.members = self.spark.createDataFrame([], "v bigint, image_id string")

    @cached_property
    def edges(self) -> DataFrame:
        """The neighbour graph, made when first asked for."""
        return self.scratch.put(graph_of(self.index, self.spark, self.floor, self.scratch), "graph") if self.rows else self.spark.createDataFrame([], EDGE)

    def clusters(self) -> DataFrame:
        """(v, grp) of every vector: its cluster."""
        if not self.rows:
            return self.spark.createDataFrame([], "v bigint, grp bigint")
        return _labelled(self.index, self.spark, self.scratch, self.floor).select(F.col("at").alias("v"), F.col("root").alias("grp"))

    def communities(self) -> tuple[DataFrame, float]:
        """((v, grp) of every vector: its community, one without an edge being its own; modularity)."""
        found, value = communities(self.edges, self.scratch)
        every = self.table.select(F.col("at").alias("v")).join(found, "v", "left")
        return self.scratch.put(every.select("v", F.coalesce("community", "v").alias("grp")), "communities"), value

    def described(self, groups: DataFrame, name: str) -> DataFrame:
        """(``name``, size, typical) of each of ``groups`` (v, grp) of two images or more: its smallest image_id, its images, its three most typical.

        Typical are those of highest weighted degree within the group, where images with equal vectors count as
        often as they come, in the size too; they are named once, by the smallest.
        """
        counts = self.members.groupBy("v").agg(F.min("image_id").alias("image_id"), F.count(F.lit(1)).alias("copies"))
        counts = self.scratch.put(counts, "counts")
        rows = degrees(self.edges, groups, counts.select("v", "copies")).join(counts, "v")
        sizes = rows.groupBy("grp").agg(F.sum("copies").alias("size"), F.min("image_id").alias(name)).filter("size > 1")
        top = top_n(rows, ["grp"], [F.round("inside", 6).desc(), F.col("image_id")], 3, F.col("v"), "r")
        typical = top.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("r", "image_id"))).alias("t"))
        return sizes.join(typical, "grp").select(name, "size", F.col("t.image_id").alias("typical"))


def _graph(spark: SparkSession, sf: str) -> Graph:
    return Graph(spark.read.parquet(f"{sf}/image_vectors.parquet").select("image_id", "embedding"), Scratch(spark, "p2"))


def named(graph: Graph) -> DataFrame:
    """(image_id, cluster_id) of every image in a cluster of at least 5 images; cluster_id is its smallest image_id."""
    rows = graph.scratch.put(skew_join(graph.members, graph.clusters(), "v").select("image_id", "grp"), "grouped")
    clusters = rows.groupBy("grp").agg(F.min("image_id").alias("cluster_id"), F.count(F.lit(1)).alias("n")).filter("n >= 5")
    return skew_join(rows, clusters, "grp").select("image_id", "cluster_id")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every image in a cluster of at least 5 images, with the smallest image_id of the cluster."""
    return named(_graph(spark, sf))


def p2_communities(spark: SparkSession, sf: str) -> DataFrame:
    """Every community of two images or more: its size and its three most typical members, by weighted degree within it."""
    graph = _graph(spark, sf)
    return graph.described(graph.communities()[0], "community_id")


def p2_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Every cluster of two images or more: its size and its three most typical members, by weighted degree within it."""
    graph = _graph(spark, sf)
    return graph.described(graph.clusters(), "cluster_id")


QUERIES = {"p2_found": p2_found, "p2_communities": p2_communities, "p2_clusters": p2_clusters}

ORACLES = {
    "p2_found": f"""
WITH RECURSIVE {UNIT_SQL},
e AS MATERIALIZED (SELECT a.image_id AS a, b.image_id AS b FROM u a JOIN u b ON a.image_id <> b.image_id WHERE list_inner_product(a.w, b.w) >= 0.47e0),
reach AS (SELECT a AS image_id, a AS other FROM e UNION SELECT r.image_id, e.b FROM reach r JOIN e ON e.a = r.other),
c AS (SELECT image_id, min(other) AS cluster_id FROM reach GROUP BY image_id)
SELECT image_id, cluster_id FROM (SELECT *, count(*) OVER (PARTITION BY cluster_id) AS n FROM c) WHERE n >= 5"""
}
