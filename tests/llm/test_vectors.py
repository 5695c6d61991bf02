import numpy as np
import pytest

from corpusloom.llm import clusters, neighbours, quantise, vectors
from corpusloom.session import Scratch
from tests.llm.conftest import linked

DIM = 384


def blob(rng, centre, n, noise):
    x = centre + noise * rng.normal(size=(n, DIM)) / np.sqrt(DIM)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v], 1) for i, v in rows], "image_id string, embedding array<float>, vid int").select("image_id", "embedding")


def made(seed, sizes, lone, noise=0.75):
    rng = np.random.default_rng(seed)
    rows = []
    for c, n in enumerate(sizes):
        centre = rng.normal(size=DIM)
        rows += [(f"c{c:02}-{k:04}", v) for k, v in enumerate(blob(rng, centre / np.linalg.norm(centre), n, noise))]
    rows += [(f"lone-{k:04}", v) for k, v in enumerate(rng.normal(size=(lone, DIM)))]
    order = rng.permutation(len(rows))
    return [rows[i] for i in order]


BAD = [("none", None), ("short", [1.0] * 383), ("zero", [0.0] * DIM), ("nan", [float("nan")] * DIM), ("inf", [float("inf")] + [1.0] * (DIM - 1)), (None, [1.0] * DIM)]


def cosines(rows):
    x = np.array([np.float32(v) for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x @ x.T


def test_usable(spark, scratch):
    rows = [("b", [2.0] * DIM), ("a", [2.0] * DIM), ("a", [2.0] * DIM), ("c", [-1.0] * DIM), *BAD]
    vecs, members = vectors.usable(table(spark, rows), scratch)
    got = members.collect()
    assert sorted(r.image_id for r in got) == ["a", "b", "c"]
    by = {r.image_id: r.vid for r in got}
    assert by["a"] == by["b"] < by["c"]
    lengths = [np.linalg.norm(np.frombuffer(r.vec, "<f4")) for r in vecs.collect()]
    assert np.allclose(lengths, 1) and len(lengths) == 2


def test_clusters(spark, scratch, monkeypatch):
    monkeypatch.setattr(vectors, "ROWS_A_PIVOT", 20)
    monkeypatch.setattr(vectors, "SMALL", 60)
    rows = made(3, [150, 40, 12, 7, 6, 5, 5, 3], 150)
    rows += [(f"copy-{k:02}", 0.25 * np.array(rows[0][1])) for k in range(30)] + [rows[1]]
    s = cosines(rows)
    ids = [i for i, _ in rows]
    want = linked([(ids[a], ids[b]) for a, b in zip(*np.nonzero(s >= 0.47)) if a < b and ids[a] != ids[b]])
    sizes = {}
    for i, c in want.items():
        sizes.setdefault(c, set()).add(i)
    graph = clusters.Graph(table(spark, rows + BAD), scratch)
    root = dict(map(tuple, graph.clusters().collect()))
    got = {}
    for r in graph.members.collect():
        got.setdefault(root[r.v], set()).add(r.image_id)
    got = {min(v): v for v in got.values() if len(v) >= 5}
    want = {c: v for c, v in sizes.items() if len(v) >= 5}
    assert sum(got.get(c) == v for c, v in want.items()) >= 0.9 * len(want)
    # lists are of the nearest, as brute force has them
    at, names = {r.v: r.image_id for r in graph.members.orderBy("image_id", ascending=False).collect()}, {i: k for k, i in enumerate(ids)}
    best = {}
    for e in graph.edges.collect():
        best.setdefault(at[e.v], []).append(e.sim)
    alone = s.copy()
    alone[s > 0.999999] = -1  # itself and its copies
    hits = [len([x for x in best.get(i, []) if x >= np.sort(alone[names[i]])[-10] - 1e-6]) / min(10, (alone[names[i]] >= 0.47).sum()) for i in at.values() if (alone[names[i]] >= 0.47).any()]
    assert np.mean(hits) >= 0.95


def test_clusters_compare_groups_not_vectors(spark, scratch, monkeypatch):
    """Clusters come from means of groups: no neighbour graph is made, and few vectors are read again."""
    monkeypatch.setattr(vectors, "ROWS_A_PIVOT", 20)
    monkeypatch.setattr(vectors, "SMALL", 100)
    rows = made(13, [200] + [30] * 6 + [7] * 10, 300)
    ids, s = [i for i, _ in rows], cosines(rows)
    want = linked([(ids[a], ids[b]) for a, b in zip(*np.nonzero(s >= 0.47)) if a < b])
    monkeypatch.setattr(clusters, "graph_of", lambda *a: pytest.fail("a neighbour graph is made"))
    graph = clusters.Graph(table(spark, rows), scratch)
    root, names = dict(map(tuple, graph.clusters().collect())), {r.v: r.image_id for r in graph.members.collect()}
    least = {}
    for v, r in root.items():
        least[r] = min(least.get(r, names[v]), names[v])
    assert {names[v]: least[r] for v, r in root.items()} == {i: want.get(i, i) for i in ids}
    nodes, index, joined, taken = clusters.Nodes(graph.index, spark, scratch, "labels", 0.47), graph.index, clusters.Joined(), []
    assert nodes.count < len(rows) and index.blocks > 4
    take, read = vectors.Raw.take, vectors.Raw.read
    monkeypatch.setattr(vectors.Raw, "take", lambda self, block, at: taken.extend(at) or take(self, block, at))
    monkeypatch.setattr(vectors.Raw, "read", lambda self, block: read(self, block) if self is nodes.raw else pytest.fail("a block of vectors is read"))
    for i in range(index.blocks):
        a = nodes.read(i)
        for j in range(i, index.blocks):
            nodes.compared(i, a, j, joined)
    assert len(taken) < 0.1 * len(rows) * index.blocks / 2  # what comparing vectors reads for every two blocks
    assert len(joined.links())


def test_far_members_are_groups_of_their_own(spark, scratch):
    rng = np.random.default_rng(14)
    rows = [(f"x{k:02}", v) for k, v in enumerate(blob(rng, np.eye(DIM)[0], 60, 0.2))] + [("far", np.cos(np.radians(50)) * np.eye(DIM)[0] + np.sin(np.radians(50)) * np.eye(DIM)[1])]
    graph = clusters.Graph(table(spark, rows), scratch)
    assert len({r.grp for r in graph.clusters().collect()}) == 1
    parts = {}
    for r in spark.read.parquet(f"{scratch.root}/labels").collect():
        parts.setdefault(r.root, []).append(r.at)
    assert sorted(map(len, parts.values())) == [1, 60] and all(k == min(v) for k, v in parts.items())


def test_merged_groups_give_the_same_clusters(spark, scratch, monkeypatch):
    """Groups that are alike by their means are merged before all are compared; far parts stay apart, so single links between dense groups are found."""
    monkeypatch.setattr(vectors, "ROWS_A_PIVOT", 20)
    monkeypatch.setattr(vectors, "SMALL", 60)
    monkeypatch.setattr(clusters, "MERGE_FROM", 1)
    rng, rows = np.random.default_rng(15), made(15, [150, 40, 12] + [7] * 12 + [3] * 4, 200)
    for pair in range(4):
        p, q = np.linalg.qr(rng.normal(size=(DIM, 2)))[0].T
        at = lambda d: np.cos(np.radians(d)) * p + np.sin(np.radians(d)) * q  # noqa: B023, E731
        rows += [(f"p{pair}-x{k:02}", v) for k, v in enumerate(blob(rng, at(0), 30, 0.2))] + [(f"p{pair}-y{k:02}", v) for k, v in enumerate(blob(rng, at(140), 30, 0.2))]
        rows += [(f"p{pair}-a", at(40)), (f"p{pair}-b", at(100))]
    ids, s = [i for i, _ in rows], cosines(rows)
    want, counts = linked([(ids[a], ids[b]) for a, b in zip(*np.nonzero(s >= 0.47)) if a < b]), []
    alike = clusters.Nodes.alike
    monkeypatch.setattr(clusters.Nodes, "alike", lambda self, spark: counts.append((self.count, sum(len(self.read(b)[0]) for b in range(self.blocks)))) or alike(self, spark))
    graph = clusters.Graph(table(spark, rows), scratch)
    root, names = dict(map(tuple, graph.clusters().collect())), {r.v: r.image_id for r in graph.members.collect()}
    least = {}
    for v, r in root.items():
        least[r] = min(least.get(r, names[v]), names[v])
    assert {names[v]: least[r] for v, r in root.items()} == {i: want.get(i, i) for i in ids}
    ((before, after),) = counts
    assert len(set(want.values())) < after < before


def test_descent_reads_rows_not_blocks(spark, scratch, monkeypatch):
    """A round that compares few vectors of a block reads these only, and what gets into their lists, not all lists of the block."""
    monkeypatch.setattr(vectors, "SMALL", 150)
    vecs, _ = vectors.usable(table(spark, made(11, [6] * 10, 1200)), scratch)
    index, at = vectors.indexed(vecs, vecs.count(), scratch)
    first = sorted(r.at for r in at.collect())
    by = [[v for v in first if v >> vectors.BITS == b] for b in range(index.blocks)]
    lists = clusters._lists(np.array(by[0][:1] * 2), np.array([by[1][3], by[2][5]]), np.array([0.5, 0.5]), np.ones(2, bool))
    state = scratch.put(spark.createDataFrame(lists.to_pandas(), clusters.LISTS).coalesce(1), "some")
    assert state.count() == 1
    worsts = vectors.Raw(f"{scratch.root}/some-worst", "<f8", 1)
    for b in range(index.blocks):
        list(worsts.write(b, iter([np.full(len(by[b]), -1.0)])))
    taken = []
    take = vectors.Raw.take
    monkeypatch.setattr(vectors.Raw, "take", lambda self, block, rows: taken.append((block, rows.tolist())) or take(self, block, rows))
    monkeypatch.setattr(vectors.Raw, "read", lambda self, block, read=vectors.Raw.read: read(self, block) if self is worsts else pytest.fail("a whole block is read"))
    found = clusters.met(index, vectors.Files(scratch, "some"), worsts, 0, None, -1.0, 10).to_pydict()
    assert taken == [(1, [3]), (2, [5])]
    monkeypatch.undo()
    a, b = index.raw.read(1)[3].astype(float), index.raw.read(2)[5].astype(float)
    assert found["v"] == [by[1][3], by[2][5]] and found["w"] == [by[2][5], by[1][3]] and np.allclose(found["sim"], a @ b)


@pytest.mark.parametrize("rows", [[], BAD, [("a", np.ones(DIM))], [("a", np.ones(DIM)), ("b", np.ones(DIM))]])
def test_few_vectors(spark, rows):
    df = table(spark, rows)
    graph = clusters.Graph(df, Scratch(spark, "few"))
    assert graph.clusters().count() == graph.communities()[0].count() == min(1, graph.members.count())
    pairs = neighbours.similar_pairs(df, Scratch(spark, "few"))
    assert [tuple(r) for r in pairs.collect()] == ([("a", "b")] if len(rows) == 2 else [])


def test_codes():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    books = quantise.fit(x)
    codes = quantise.code(x, books)
    decoded = np.concatenate([books[m][codes[:, m]] for m in range(len(books))], axis=1)
    guess = quantise.scan(x[:7], codes, books)
    assert np.allclose(guess, x[:7] @ decoded.T, atol=1e-4)
    assert codes.max() < 16 and (quantise.decode(quantise.pack(codes), books) == decoded).all()
    # the sum of a query's table entries is the estimate
    tables = np.einsum("md,mkd->mk", x[3].reshape(len(books), -1), books)
    assert np.allclose([tables[np.arange(len(books)), c].sum() for c in codes[:20]], guess[3, :20], atol=1e-4)
    # the anisotropic codes keep a vector's product with itself better than the nearest codewords do
    nearest = quantise.code(x, books, 0)
    plain = np.concatenate([books[m][nearest[:, m]] for m in range(len(books))], axis=1)
    miss = lambda d: np.abs(1 - (d * x).sum(1)).mean()
    assert miss(decoded) < miss(plain)


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(vectors, "ROWS_A_PIVOT", 20)
    monkeypatch.setattr(vectors, "SMALL", 60)
    rng = np.random.default_rng(5)
    rows = made(6, [60, 20, 9], 150)
    for b in range(12):  # bursts
        rows += [(f"burst{b:02}-{k}", v) for k, v in enumerate(blob(rng, np.array(rows[b][1]), 2 + b, 0.3))]
    rows += [(f"copy-{k:02}", rows[3][1]) for k in range(25)]
    s = np.round(cosines(rows), 6)
    ids, want = [i for i, _ in rows], set()
    for a in range(len(rows)):
        near = sorted((-s[a, b], ids[b]) for b in range(len(rows)) if b != a and s[a, b] >= 0.80)[:10]
        want |= {(min(ids[a], i), max(ids[a], i)) for _, i in near}
    got = {tuple(r) for r in neighbours.similar_pairs(table(spark, rows + BAD), Scratch(spark, "n")).collect()}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.02 * len(want)
    copies = {p for p in got if p[0].startswith("copy") and p[1].startswith("copy")}
    assert len(copies) <= 11 * 25  # copies aren't expanded into all pairs


def test_nearest_are_ranked(spark):
    rng = np.random.default_rng(7)
    rows = [(f"p{k}", v) for k, v in enumerate(blob(rng, np.eye(DIM)[0], 6, 0.3))] + [("q0", None), ("twin", None)]
    rows[-2], rows[-1] = ("q0", -np.eye(DIM)[0]), ("twin", rows[0][1])
    s = np.round(cosines(rows), 6)
    got = {}
    for r in neighbours.nearest_images(table(spark, rows), Scratch(spark, "n"), k=3).collect():
        got.setdefault(r.image_id, {})[r.rank] = r.other
    ids = [i for i, _ in rows]
    for a in range(7):
        if ids[a] != "q0":
            want = [i for _, i in sorted((-s[a, b], ids[b]) for b in range(len(ids)) if b != a and s[a, b] >= 0.8)[:3]]
            assert [got[ids[a]][k] for k in (1, 2, 3)] == want
    assert "q0" not in got


def test_nearest_of_every_picture(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SMALL", 100)
    rows = made(8, [60, 20, 9], 250)
    rows += [(f"copy-{k:02}", rows[3][1]) for k in range(15)] + [(f"scaled-{k:02}", 0.3 * (k + 1) * np.array(rows[5][1])) for k in range(60)]
    s = np.round(cosines(rows), 6)
    ids = [i for i, _ in rows]
    got = {}
    for r in neighbours.nearest_images(table(spark, rows + BAD), Scratch(spark, "n"), floor=None).collect():
        got.setdefault(r.image_id, {})[r.rank] = r.other
    want = {ids[a]: [i for _, i in sorted((-s[a, b], ids[b]) for b in range(len(ids)) if b != a)[:10]] for a in range(len(ids))}
    assert got.keys() == want.keys()
    assert all([got[i][k] for k in range(1, 11)] == want[i] for i in want)


def test_hot_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(vectors, "ROWS_A_PIVOT", 8)
    rng = np.random.default_rng(9)
    rows = [(f"hot-{k:04}", v) for k, v in enumerate(blob(rng, np.eye(DIM)[0], 1500, 0.33))] + [(f"lone-{k:03}", v) for k, v in enumerate(rng.normal(size=(500, DIM)))]
    s = np.round(cosines(rows), 6)
    ids, want = [i for i, _ in rows], set()
    for a in range(1500):
        near = sorted((-s[a, b], ids[b]) for b in range(len(rows)) if b != a and s[a, b] >= 0.80)[:10]
        want |= {(min(ids[a], i), max(ids[a], i)) for _, i in near}
    got = {tuple(r) for r in neighbours.similar_pairs(table(spark, rows), Scratch(spark, "n")).collect()}
    assert (len(got & want) / len(want), len(got - want)) == (1, 0)


def test_copies_nearer_than_codes_can_tell(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SMALL", 300)
    rng = np.random.default_rng(12)
    rows = [(f"hot-{k:04}", v) for k, v in enumerate(blob(rng, np.eye(DIM)[1], 900, 0.1))] + [(f"lone-{k:03}", v) for k, v in enumerate(rng.normal(size=(100, DIM)))]
    s = np.round(cosines(rows), 6)
    ids, want = [i for i, _ in rows], set()
    for a in range(900):
        near = sorted((-s[a, b], ids[b]) for b in range(len(rows)) if b != a and s[a, b] >= 0.80)[:10]
        want |= {(min(ids[a], i), max(ids[a], i)) for _, i in near}
    got = {tuple(r) for r in neighbours.similar_pairs(table(spark, rows), Scratch(spark, "n")).collect()}
    assert len(got & want) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(want)


def test_one_link_between_dense_groups(spark, scratch, monkeypatch):
    monkeypatch.setattr(vectors, "SMALL", 50)
    rng = np.random.default_rng(10)
    rows = []
    for pair in range(8):  # two groups whose only link are their far members a and b, of cosine 0.5
        p, q = np.linalg.qr(rng.normal(size=(DIM, 2)))[0].T
        at = lambda d: np.cos(np.radians(d)) * p + np.sin(np.radians(d)) * q  # noqa: B023, E731
        rows += [(f"p{pair}-x{k:02}", v) for k, v in enumerate(blob(rng, at(0), 30, 0.2))] + [(f"p{pair}-y{k:02}", v) for k, v in enumerate(blob(rng, at(140), 30, 0.2))]
        rows += [(f"p{pair}-a", at(40)), (f"p{pair}-b", at(100))]
    s = cosines(rows)
    ids = [i for i, _ in rows]
    want = linked([(ids[a], ids[b]) for a, b in zip(*np.nonzero(s >= 0.47)) if a < b])
    assert len(set(want.values())) == 8
    graph = clusters.Graph(table(spark, rows), scratch)
    root, got = dict(map(tuple, graph.clusters().collect())), {}
    for r in graph.members.collect():
        got.setdefault(root[r.v], set()).add(r.image_id)
    assert sorted(map(sorted, got.values())) == sorted(sorted(i for i in ids if want[i] == c) for c in set(want.values()))


def test_copies_without_a_neighbour(spark, tmp_path):
    rows = made(11, [6], 4)
    lone = next(v for i, v in rows if i == "lone-0000")
    rows += [(f"lone-0000-{k}", lone) for k in range(40)]
    table(spark, rows).write.parquet(f"{tmp_path}/image_vectors.parquet")
    for query in (clusters.p2_communities, clusters.p2_clusters):
        got = {r[0]: (r.size, r.typical) for r in query(spark, str(tmp_path)).collect()}
        assert got["lone-0000"] == (41, ["lone-0000"])
        assert got["c00-0000"][0] == 6 and len(got["c00-0000"][1]) == 3 and len(got) == 2


def modularity(edges, of):
    """Of the division ``of`` of the undirected weighted edges."""
    total, inside, degree = 2 * sum(s for _, _, s in edges), 0.0, {}
    for v, w, s in edges:
        inside += 2 * s * (of[v] == of[w])
        for x in (v, w):
            degree[of[x]] = degree.get(of[x], 0.0) + s
    return inside / total - sum(d * d for d in degree.values()) / total**2


def test_communities(spark, scratch):
    # four cliques of different sizes in a ring, and two vertices apart: the best division is known
    sizes, edges, at = (5, 6, 7, 9), [], 0
    for n in sizes:
        edges += [(at + a, at + b, 0.9) for a in range(n) for b in range(a)]
        edges.append((at, (at + n) % sum(sizes), 0.5))
        at += n
    edges.append((100, 101, 0.7))
    found, value = clusters.communities(spark.createDataFrame(edges, "v bigint, w bigint, sim double"), scratch)
    of = dict(map(tuple, found.collect()))
    assert value == pytest.approx(modularity(edges, of))
    cliques = [c for c, n in enumerate(sizes) for _ in range(n)]
    best = dict(enumerate(cliques)) | {100: 9, 101: 9}
    assert value == pytest.approx(modularity(edges, best)) and len(set(of.values())) == 5
    # and no single move, nor joining two communities, gains anything
    for x in of:
        for c in set(of.values()):
            assert modularity(edges, of | {x: c}) <= value + 1e-9
    for a in set(of.values()):
        for b in set(of.values()):
            assert modularity(edges, {x: a if c == b else c for x, c in of.items()}) <= value + 1e-9
    empty, none = clusters.communities(spark.createDataFrame([], "v bigint, w bigint, sim double"), scratch)
    assert (empty.count(), none) == (0, 0.0)
