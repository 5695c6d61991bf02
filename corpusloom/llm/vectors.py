"""What the vector problems share: usable vectors, copies folded into one, and an index whose blocks workers read by themselves.

The index holds every vector in the bucket of its nearest pivot, raw in files of their own and as a code of four bits a
place, sorted by bucket and cut into blocks, a file each in the shared folder. Pieces, the rows of one
bucket and one band of nearness to its pivot in one block, have their mean and spread; from these follows how good a neighbour a piece may
hold for a query, hence which pieces it must visit. Vectors are shuffled once, into their blocks; whoever
needs a block's vectors or codes later reads its file.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import quantise
from corpusloom.operators.skew import skew_join
from corpusloom.session import Scratch, let_workers_import

#: Pivots are a sample of the vectors: one in ROWS_A_PIVOT, at least FEW and at most MANY, which bounds what is collected and broadcast (13 MB).
ROWS_A_PIVOT, FEW, MANY = 64, 16, 8192
#: Pivots from which on they form a tree of two levels, and branches that a vector follows.
TREE_FROM, BRANCHES = 1024, 4
#: Bands of cosine with the pivot that a bucket is cut into, so that rows far from it don't hide those near it.
BANDS = 8
#: Rows of a block, and how many blocks small tables get if each has SMALL rows.
BLOCK, BLOCKS, SMALL = 4096, 24, 256
#: Rows of one side that meet at once.
STEP = 1024
#: What a query keeps of a chunk before it knows better, as a multiple of k.
ROOM = 4
#: How far a product of single precision may be off, with room to spare.
BLUR = 1e-5
#: Pieces that every query visits whatever they promise; better neighbours that all the pieces it skips may hold, by expectation; margin on their spread.
FIRST, MISSED, SPREAD = 24, 0.001, 1.5
#: Rows of a block in FEW_ROWS of which all are read rather than those wanted.
FEW_ROWS = 8
#: Bits of an address below the block.
BITS = 33


def usable(df: DataFrame, scratch: Scratch, dim: int = 384) -> tuple[DataFrame, DataFrame]:
    """(vectors, members): the different usable embeddings of ``df`` (image_id, embedding), and who has them.

    Usable are ``dim`` finite numbers, not all zero; null ids are left out. An image_id that comes with
    several usable embeddings keeps the smallest (by number from the front). Equal embeddings (equal in a
    hash of 128 bits) are one row of vectors (vid, vec: ``dim`` little-endian floats of length 1 in all), so
    that copies are compared once. members has (vid, image_id); vid rises with the smallest image_id of a vector.
    """
    let_workers_import(df.sparkSession)
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = (F.size("embedding") == dim) & finite & F.exists(v, lambda x: x != 0)
    rows = df.filter(F.col("image_id").isNotNull() & good).groupBy("image_id").agg(F.min(F.col("embedding").cast("array<float>")).alias("embedding"))
    digest = F.concat_ws(" ", *[F.hex(F.xxhash64(F.lit(seed), "embedding")) for seed in (1, 2)])
    rows = scratch.put(rows.withColumn("digest", digest), "usable")
    # only digests are sorted to number the vectors
    firsts = rows.groupBy("digest").agg(F.min("image_id").alias("image_id"))
    firsts = scratch.put(firsts.orderBy("image_id").withColumn("vid", F.monotonically_increasing_id()), "firsts")
    members = skew_join(rows.select("digest", "image_id"), firsts.select("digest", "vid"), "digest").select("vid", "image_id")

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                x = x / np.abs(x).max(1, keepdims=True)
                x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("<f4")
                yield pa.RecordBatch.from_arrays([batch.column(0), blobs(x)], ["vid", "vec"])

    # one row a digest on either side: no key is hot
    vectors = rows.join(firsts, ["digest", "image_id"]).select("vid", "embedding").mapInArrow(unit, "vid bigint, vec binary")
    vectors, members = scratch.put(vectors, "vectors"), scratch.put(members, "members")
    scratch.drop("usable")
    scratch.drop("firsts")
    return vectors, members


def blobs(x: np.ndarray) -> pa.Array:
    """The rows of ``x`` as binary values."""
    x = np.ascontiguousarray(x)
    width = x.shape[1] * x.itemsize
    offsets = pa.py_buffer((np.arange(len(x) + 1) * width).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(x), [None, offsets, pa.py_buffer(x)])


def matrix(column: pa.Array | pa.ChunkedArray, dim: int, kind: str = "<f4") -> np.ndarray:
    """The binary values of a column as rows of ``dim`` numbers."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    parts = [np.zeros((0, dim), kind)]
    for c in chunks:
        if len(c):
            start = np.frombuffer(c.buffers()[1], np.int32)[c.offset]
            parts.append(np.frombuffer(c.buffers()[2], kind, len(c) * dim, int(start)).reshape(-1, dim))
    return np.concatenate(parts) if len(parts) != 2 else parts[1]


def sampled(vectors: DataFrame, size: int, rows: int, seed: int, key: str = "vid") -> np.ndarray:
    """About ``size`` of the ``rows`` vectors, those whose hash is small: the same ones on every run, and no more than that go to the driver."""
    share = F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11) / float(1 << 53)
    few = vectors.filter(share < size / max(rows, 1)) if rows > size else vectors
    found = sorted(map(tuple, few.select(key, "vec").collect())) or [tuple(vectors.agg(F.min(F.struct(key, "vec")).alias("m")).select("m.*").first())]
    return np.stack([np.frombuffer(v, "<f4") for _, v in found])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The inner product of each row of ``a`` with that row of ``b``, in double precision."""
    return np.einsum("ij,ij->i", a.astype(np.float64), b.astype(np.float64))


class Pivots:
    """Pivots, in an order in which those of one branch of the tree are together, and the nearest one of any vector."""

    def __init__(self, centres: np.ndarray):
        self.heads = None
        if len(centres) >= TREE_FROM:
            heads = centres[:: math.ceil(math.sqrt(len(centres)))]
            branch = np.concatenate([(centres[a : a + STEP] @ heads.T).argmax(1) for a in range(0, len(centres), STEP)])
            order = np.argsort(branch, kind="stable")
            centres, self.heads = centres[order], heads
            self.bounds = np.searchsorted(branch[order], np.arange(len(heads) + 1))
        self.centres = centres

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivot of each row of ``x`` and its cosine; in a tree, of the BRANCHES nearest branches."""
        best, at = np.full(len(x), -np.inf, np.float32), np.zeros(len(x), np.int64)

        def among(rows: np.ndarray, a: int, b: int) -> None:
            s = x[rows] @ self.centres[a:b].T
            top = s.argmax(1)
            value = s[np.arange(len(rows)), top]
            better = value > best[rows]
            best[rows[better]], at[rows[better]] = value[better], a + top[better]

        if self.heads is None:
            for a in range(0, len(x), STEP):
                among(np.arange(a, min(len(x), a + STEP)), 0, len(self.centres))
            return at, best
        towards = x @ self.heads.T
        ways = np.argpartition(-towards, BRANCHES, axis=1)[:, :BRANCHES] if towards.shape[1] > BRANCHES else np.broadcast_to(np.arange(towards.shape[1]), towards.shape)
        for h in np.unique(ways):
            a, b = self.bounds[h : h + 2]
            if a < b:
                among(np.flatnonzero((ways == h).any(1)), a, b)
        return at, best


def tail(p: np.ndarray) -> np.ndarray:
    """How many deviations a normal value exceeds with probability ``p`` (a rational approximation, off by less than 0.001); -inf for p >= 0.5."""
    t = np.sqrt(-2 * np.log(np.clip(p, 1e-300, 0.5)))
    z = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t**3)
    return np.where(p < 0.5, z, -np.inf)


class Candidates:
    """The (query, address, estimate) that may be among the k nearest of m queries; all within ``margin`` of the k-th best estimate."""

    def __init__(self, m: int, k: int, lowest: float, margin: float):
        self.m, self.k, self.margin = m, k, margin
        self.best = np.full(m, lowest, np.float32)  # the k-th best estimate so far
        self.q, self.at, self.guess = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        self.open: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def near(self, queries: np.ndarray, guess: np.ndarray) -> np.ndarray:
        """Which of the estimates (query, row) of some queries are near enough so far."""
        near = guess >= (self.best[queries] - self.margin)[:, None]
        many = np.flatnonzero(near.sum(1) > ROOM * self.k)
        if len(many):  # the k-th best of these rows alone is a bound
            kth = -np.partition(-guess[many], self.k - 1, axis=1)[:, self.k - 1]
            self.best[queries[many]] = np.maximum(self.best[queries[many]], kth)
            near[many] = guess[many] >= (self.best[queries[many]] - self.margin)[:, None]
        return near

    def add(self, queries: np.ndarray, at: np.ndarray, guess: np.ndarray, near: np.ndarray | None = None) -> None:
        """The estimates (query, row) of some queries with the rows at these addresses, as far as they are near enough."""
        row, col = np.nonzero(self.near(queries, guess) if near is None else near)
        self.open.append((queries[row], at[col], guess[row, col]))
        self.waiting += len(row)
        if self.waiting > 16 * self.k * self.m:
            self.settle()

    def settle(self) -> None:
        """Each candidate once, and only those still near enough."""
        q, at, guess = (np.concatenate([own, *[o[i] for o in self.open]]) for i, own in enumerate((self.q, self.at, self.guess)))
        order = np.lexsort((at, -guess, q))
        q, at, guess = q[order], at[order], guess[order]
        fresh = np.ones(len(q), bool)
        fresh[1:] = (q[1:] != q[:-1]) | (at[1:] != at[:-1])  # equal rows have equal estimates
        q, at, guess = q[fresh], at[fresh], guess[fresh]
        start = np.searchsorted(q, np.arange(self.m + 1))
        full = np.flatnonzero(np.diff(start) >= self.k)
        self.best[full] = np.maximum(self.best[full], guess[start[full] + self.k - 1])
        keep = guess >= self.best[q] - self.margin
        self.q, self.at, self.guess, self.open, self.waiting = q[keep], at[keep], guess[keep], [], 0


class Files:
    """The files of a table with one file a block, for workers to read."""

    def __init__(self, scratch: Scratch, name: str):
        where = f"{scratch.root}/{name}"
        sc = scratch.spark.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(where)
        names = [f.getPath().getName() for f in at.getFileSystem(sc._jsc.hadoopConfiguration()).listStatus(at)]
        self.paths = {int(m[1]): f"{where}/{n}" for n in names if (m := re.match(r"part-(\d+)-", n))}

    def read(self, block: int, columns: list[str]) -> pa.Table | None:
        """These columns of a block, in the order of its rows; None if the block is empty."""
        if block not in self.paths:
            return None
        files, path = pa.fs.FileSystem.from_uri(self.paths[block])
        with files.open_input_file(path) as source:
            return pa.parquet.ParquetFile(source).read(columns=columns, use_threads=False)


class Raw:
    """Rows of ``width`` numbers in a file a block, not compressed, so that workers read those they need by their place."""

    def __init__(self, where: str, kind: str, width: int):
        self.where, self.kind, self.width = where, kind, width
        self.size = np.dtype(kind).itemsize * width

    def _file(self, block: int) -> tuple[pa.fs.FileSystem, str]:
        return pa.fs.FileSystem.from_uri(f"{self.where}/{block}")

    def write(self, block: int, parts: Iterator[np.ndarray]) -> Iterator[None]:
        """Write ``parts`` one after another, each when asked for the next; the file is there once all are written, the same from any attempt."""
        files, path = self._file(block)
        files.create_dir(path.rsplit("/", 1)[0], recursive=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with files.open_output_stream(part) as sink:
            for x in parts:
                sink.write(np.ascontiguousarray(x, self.kind).tobytes())
                yield
        files.move(part, path)

    def read(self, block: int) -> np.ndarray:
        """All rows of a block, none if it has no file."""
        files, path = self._file(block)
        if files.get_file_info(path).type == pa.fs.FileType.NotFound:
            return np.zeros((0, self.width), self.kind)
        with files.open_input_file(path) as source:
            return np.frombuffer(source.read(), self.kind).reshape(-1, self.width)

    def take(self, block: int, rows: np.ndarray) -> np.ndarray:
        """Some rows of a block; the whole file is read only for many of them."""
        files, path = self._file(block)
        with files.open_input_file(path) as source:
            if len(rows) * FEW_ROWS >= source.size() // self.size:
                return np.frombuffer(source.read(), self.kind).reshape(-1, self.width)[rows]
            parts = [source.read_at(self.size, int(r) * self.size) for r in rows]
            return np.frombuffer(b"".join(parts), self.kind).reshape(-1, self.width)


class Index:
    """The blocks of an index, their pieces and codes; workers get it by pickling, which carries names of files, codebooks and sizes only."""

    def __init__(self, files: Files, raw: Raw, pieces: Files, blocks: int, dim: int, books: np.ndarray, blur: float, rows: int):
        self.raw = raw
        self.files, self.piece_files, self.blocks, self.dim, self.books, self.blur, self.rows = files, pieces, blocks, dim, books, blur, rows
        self._pieces: tuple | None = None

    def vectors(self, block: int, columns: tuple[str, ...] = ("vid",)) -> tuple[np.ndarray, ...]:
        """The raw vectors of a block, then other columns of it."""
        t = self.files.read(block, list(columns)) if columns else None
        return (self.raw.read(block), *[np.zeros(0, np.int64) if t is None else t[c].to_numpy() for c in columns])

    def decoded(self, block: int) -> np.ndarray:
        """The vectors of a block as their codes have them."""
        t = self.files.read(block, ["code"])
        width = len(self.books) // 2
        return quantise.decode(matrix(t["code"], width, "u1"), self.books) if t is not None else np.zeros((0, self.dim), "<f4")

    def pieces(self) -> tuple[np.ndarray, ...]:
        """(block, first row, rows, mean, length of the mean, reach) of each piece; reach is how far above its mean's product a query may find a better neighbour there."""
        if self._pieces is None:
            parts = [t for b in sorted(self.piece_files.paths) if (t := self.piece_files.read(b, ["block", "start", "n", "mean"])) is not None]
            t = pa.concat_tables(parts)
            order = np.lexsort((t["start"].to_numpy(), t["block"].to_numpy()))
            block, start, n = (t[c].to_numpy()[order].astype(np.int64) for c in ("block", "start", "n"))
            mean = matrix(t["mean"], self.dim, "<f2")[order].astype(np.float32)
            square = (mean.astype(np.float64) ** 2).sum(1)
            reach = tail(MISSED / len(n) / n) * SPREAD * np.sqrt(np.maximum(1 - square, 0) / self.dim)
            self._pieces = (block, start, n, mean, np.sqrt(square).astype(np.float32), reach.astype(np.float32))
        return self._pieces

    def promising(self, q: np.ndarray, least: np.ndarray) -> np.ndarray:
        """(query, piece): whether the piece may hold rows of a product of ``least`` or more with the query."""
        _, _, _, mean, _, reach = self.pieces()
        return np.concatenate([q[a : a + STEP] @ mean.T >= least[a : a + STEP, None] - reach[None] for a in range(0, len(q), STEP)])

    def nearby(self, q: np.ndarray, own: int, first: int = FIRST) -> np.ndarray:
        """(query, piece): whether the piece is of the ``own`` block or one of the ``first`` whose means point most nearly to the query."""
        block, _, _, mean, length, _ = self.pieces()
        out = np.zeros((len(q), len(block)), bool)
        out[:, block == own] = True
        for a in range(0, len(q), STEP):
            cos = (q[a : a + STEP] @ mean.T) / np.maximum(length, 1e-9)[None]
            near = np.argpartition(-cos, first, axis=1)[:, :first] if cos.shape[1] > first else np.broadcast_to(np.arange(cos.shape[1]), cos.shape)
            np.put_along_axis(out[a : a + STEP], near, True, 1)
        return out

    def visits(self, wanted: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(block, queries, rows of the block) for each block of which any piece is ``wanted`` (query, piece)."""
        block, start, n, *_ = self.pieces()
        any_query = wanted.any(0)
        for b in np.unique(block[any_query]):
            here = np.flatnonzero((block == b) & any_query)
            yield int(b), np.flatnonzero(wanted[:, here].any(1)), np.concatenate([np.arange(start[p], start[p] + n[p]) for p in here])

    def each_block(self, spark, run: Callable[[int], pa.Table | None], schema: str) -> DataFrame:  # noqa: ANN001
        """The rows of ``run(block)`` of every block, a task each."""

        def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in batch.column(0).to_pylist():
                    if (found := run(b)) is not None:
                        yield from found.to_batches()

        return spark.range(0, self.blocks, 1, self.blocks).mapInArrow(tasks, schema)


def block_of(at: str | Column) -> Column:
    """The block of an address."""
    return F.shiftright(F.col(at) if isinstance(at, str) else at, BITS).cast("int")


def indexed(vectors: DataFrame, rows: int, scratch: Scratch, name: str = "index") -> tuple[Index, DataFrame]:
    """The index of ``vectors`` (vid, vec), at least one of them, and its table (at, vid): where each vector lies.

    Pivots and codebooks are fitted on MANY and FIT_ROWS vectors at most; every row is held. A row's address is its block
    and its place in it. Buckets too large for a block, such as a third of all rows, are spread over several by hash.
    """
    let_workers_import(vectors.sparkSession)
    spark = vectors.sparkSession
    pivots = Pivots(sampled(vectors, min(MANY, max(FEW, math.ceil(rows / ROWS_A_PIVOT))), rows, 1))
    sample = sampled(vectors, quantise.FIT_ROWS, rows, 2)
    dim = sample.shape[1]
    books = quantise.fit(sample)
    blur = quantise.error(sample, books)
    blocks = max(math.ceil(rows / BLOCK), min(BLOCKS, math.ceil(rows / SMALL)), 1)
    # where a bucket lies on the line of all rows, by the sample; pivots count too, so that no bucket has no room
    share = np.bincount(np.concatenate([pivots.nearest(sample)[0], np.arange(len(pivots.centres))]), minlength=len(pivots.centres)).astype(float)
    upto = np.cumsum(share) / share.sum()
    shared = spark.sparkContext.broadcast((pivots, books, np.concatenate([[0.0], upto])))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, books, line = shared.value
        for batch in batches:
            if batch.num_rows:
                x, vid = matrix(batch.column(1), dim), batch.column(0).to_numpy()
                bucket, cos = pivots.nearest(x)
                band = np.clip(cos * BANDS, 0, BANDS - 1).astype(np.int64)
                mixed = (vid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)  # spreads consecutive numbers
                spot = line[bucket] + (line[bucket + 1] - line[bucket]) * (mixed / float(1 << 53))
                block = np.minimum((spot * blocks).astype(np.int32), blocks - 1)
                arrays = [pa.array(block), pa.array((bucket * BANDS + band).astype(np.int32)), batch.column(0), blobs(quantise.pack(quantise.code(x, books))), batch.column(1)]
                yield pa.RecordBatch.from_arrays(arrays, ["block", "bucket", "vid", "code", "vec"])

    raw = Raw(f"{scratch.root}/{name}-raw", "<f4", dim)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the rows of one block, in their order
        sink, held = None, []
        for batch in batches:
            if batch.num_rows:
                held.append(matrix(batch.column(4), dim))
                sink = sink or raw.write(batch.column(0)[0].as_py() >> BITS, (held.pop() for _ in iter(lambda: len(held), 0)))
                next(sink)
                yield pa.RecordBatch.from_arrays(batch.columns[:4], ["at", "bucket", "vid", "code"])
        if sink:
            next(sink, None)  # nothing is left: the file takes its name

    placed = vectors.select("vid", "vec").mapInArrow(place, "block int, bucket int, vid bigint, code binary, vec binary")
    table = placed.repartitionById(blocks, "block").sortWithinPartitions("bucket", "vid").withColumn("at", F.monotonically_increasing_id())
    table = scratch.put(table.select("at", "bucket", "vid", "code", "vec").mapInArrow(store, "at bigint, bucket int, vid bigint, code binary"), name)
    files = Files(scratch, name)

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0).to_pylist():
                t = files.read(block, ["bucket"])
                if t is not None and t.num_rows:
                    bucket, x = t["bucket"].to_numpy(), raw.read(block)
                    first = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1])
                    n = np.diff(np.append(first, len(x)))
                    middle = (np.add.reduceat(x, first, axis=0) / n[:, None]).astype("<f2")
                    arrays = [pa.array(np.full(len(n), block, np.int32)), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32)), blobs(middle)]
                    yield pa.RecordBatch.from_arrays(arrays, ["block", "start", "n", "mean"])

    every = spark.range(0, blocks, 1, blocks).mapInArrow(means, "block int, start int, n int, mean binary")
    scratch.put(every.repartition(8), f"{name}-pieces")
    shared.unpersist()
    return Index(files, raw, Files(scratch, f"{name}-pieces"), blocks, dim, books, blur, rows), table.select("at", "vid")


#: SQL of the usable unit vectors u (image_id, w) of image_vectors, for comparison on small tables.
UNIT_SQL = """
v AS (SELECT image_id, CAST(min(embedding) AS DOUBLE[]) AS e FROM image_vectors
      WHERE image_id IS NOT NULL AND len(embedding) = 384 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 384 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY image_id),
u AS (SELECT image_id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS w FROM v)"""
