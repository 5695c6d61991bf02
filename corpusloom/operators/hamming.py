"""All pairs of 64-bit hashes within a Hamming distance, by multi-index hashing.

The hashes are cut into m blocks, each with a radius of its own such that two hashes within the distance are
within the radius of at least one block: the radii plus one sum to more than the distance. Only the hashes
themselves, 8 bytes each, are written to the shared folder, in parts that workers read by themselves: a task takes one block and
two parts, sorts both by the block's highest bits and compares the rows of each bucket with those of all buckets within
the radius, tile by tile. Nothing that is looked up or meets by chance is shuffled or kept. A pair counts in the first
block in which it is near, so no distinct is needed; only pairs are joined with their ids. How many blocks
there are, and of how many bits a bucket, follows from the number of hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.names import hash_bits
from corpusloom.operators.skew import skew_join
from corpusloom.session import Scratch, let_workers_import


def _variants(bits: int, radius: int) -> list[int]:
    return [sum(1 << b for b in flips) for k in range(radius + 1) for flips in combinations(range(bits), k)]


def _numbers(hashes: DataFrame) -> DataFrame:
    return hashes.select("image_id", hash_bits(F.col("phash_hex")).alias("bits")).filter("image_id IS NOT NULL AND bits IS NOT NULL")


def representatives(hashes: DataFrame) -> DataFrame:
    """(bits, representative) of each different hash of ``hashes`` (image_id, phash_hex): the smallest id that has it."""
    return _numbers(hashes).groupBy("bits").agg(F.min("image_id").alias("representative"))


def hash_classes(hashes: DataFrame) -> DataFrame:
    """(image_id, bits, representative) of ``hashes`` (image_id, phash_hex): images of one hash share the smallest id as representative.

    Null ids, null hashes and what is not 16 hex digits are left out; letter case and repeated rows make no difference.
    """
    return skew_join(_numbers(hashes).distinct(), representatives(hashes), "bits").select("image_id", "bits", "representative")


#: Hashes of a part (32 MB), which two at once bound a task's memory; bits of a bucket at most.
PART, MOST_BITS = 1 << 22, 20
#: What a visit of a bucket, and of one near it, costs against comparing two hashes (about 1.6 ns).
VISIT, NEAR = 30_000, 12
#: Comparisons of a task, about; rows that go to a task at once, so that a bucket of many rows is spread; comparisons of a tile (512 KB).
TASK, RUN, TILE = 2e9, 2048, 1 << 16


def layout(blocks: int, radius: int) -> list[tuple[int, int, int]]:
    """(lowest bit, width, radius) of each block; widths differ by one bit at most, and wider blocks come last."""
    widths = [64 // blocks + (i >= blocks - 64 % blocks) for i in range(blocks)]
    near = [radius // blocks - (i >= radius % blocks + 1) for i in range(blocks)]
    return [(sum(widths[:i]), widths[i], near[i]) for i in range(blocks)]


def _bits(width: int, near: int, rows: int) -> tuple[float, int]:
    """(cost, bits): what comparing ``rows`` hashes in one block costs, and the bits of a bucket for which it is least."""
    part = min(rows, PART)

    def least(bits: int) -> tuple[float, int]:
        ball = sum(comb(bits, k) for k in range(near + 1))
        visits = min(1 << bits, part) * max(rows / PART, 1) ** 2
        return rows * rows / 2 * ball / (1 << bits) + visits * (VISIT + NEAR * ball), bits

    return min(map(least, range(min(width, MOST_BITS) + 1)))


def cost(blocks: int, radius: int, rows: int) -> float:
    """What ``rows`` different hashes cost in ``blocks`` blocks, in comparisons."""
    return sum(_bits(width, near, rows)[0] for _, width, near in layout(blocks, radius) if near >= 0)


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    """64-bit numbers turned left, sorted: a block at its highest bits."""
    x = (x << np.uint64(by)) | (x >> np.uint64(64 - by)) if by else x.copy()
    x.sort()
    return x


def _tiles(a: np.ndarray, b: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in a, places in b) within the distance."""
    for s in range(0, len(b), TILE):
        some = b[s : s + TILE]
        step = max(1, TILE // len(some))
        for r in range(0, len(a), step):
            i, j = np.nonzero(np.bitwise_count(a[r : r + step, None] ^ some[None]) <= radius)
            if len(i):
                yield i + r, j + s


def near_pairs(a: np.ndarray, b: np.ndarray | None, parts: list[tuple[int, int, int]], at: int, bits: int, radius: int, share: int = 0, shares: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(x, y): the pairs of ``a`` and ``b`` (or within a, if None) of distance ``radius`` or less that are near in block ``at`` of ``parts`` and in none before.

    Buckets are told by ``bits`` bits of the block. Of ``a`` only one run of RUN rows in ``shares`` is compared, from the one of number ``share`` on.
    """
    low, width, near = parts[at]
    by = (64 - low - width) % 64
    a, own = _turned(a, by), b is None
    b = a if own else _turned(b, by)
    bucket = lambda x: (x >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(x), np.int64)
    start = np.concatenate([[0], np.cumsum(np.bincount(bucket(b), minlength=1 << bits))])
    flips = np.array(_variants(bits, near), np.int64)
    xs, ys = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for run in range(share * RUN, len(a), shares * RUN):
        rows = a[run : run + RUN]
        names, first = np.unique(bucket(rows), return_index=True)
        for name, s, e in zip(names, first, np.append(first[1:], len(rows))):
            others = name ^ flips
            if own:  # each pair of buckets once
                others = others[others >= name]
            lo, n = start[others], start[others + 1] - start[others]
            lo, n = lo[n > 0], n[n > 0]
            if not len(n):
                continue
            if len(n) == 1:
                place, theirs = None, b[lo[0] : lo[0] + n[0]]
            else:
                place = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                theirs = b[place]
            for i, j in _tiles(rows[s:e], theirs, radius):
                if own:
                    later = (j + lo[0] if place is None else place[j]) > run + s + i
                    i, j = i[later], j[later]
                xs.append(rows[s:e][i])
                ys.append(theirs[j])
    x, y = np.concatenate(xs), np.concatenate(ys)
    differ = x ^ y
    back = lambda z: (z >> np.uint64(by)) | (z << np.uint64(64 - by)) if by else z
    differ = back(differ)
    within = lambda low, width, near: np.bitwise_count((differ >> np.uint64(low)) & np.uint64((1 << width) - 1)) <= near
    keep = within(*parts[at]) & (differ != 0)
    for before in parts[:at]:
        keep &= ~within(*before)
    return back(x[keep]), back(y[keep])


def _read(path: str) -> np.ndarray:
    files, name = pa.fs.FileSystem.from_uri(path)
    with files.open_input_file(name) as source:
        return pa.parquet.ParquetFile(source).read(columns=["bits"], use_threads=False)["bits"].to_numpy().view(np.uint64)


def hamming_pairs(hashes: DataFrame, radius: int = 10, blocks: int | None = None) -> DataFrame:
    """(id_a, id_b, hamming) between the rows of ``hashes`` (bits, representative; ``representatives``), id_a < id_b, distance 1 to ``radius``.

    Images of equal hashes are one class (``hash_classes``), so copies are never expanded into pairs. Without
    ``blocks``, their number is the cheapest for this many hashes.
    """
    spark = hashes.sparkSession
    let_workers_import(spark)
    scratch = Scratch(spark, "hamming")
    own = scratch.put(hashes.select("bits", "representative"), "own")
    rows = own.count()
    blocks = blocks or min(range(2, 7), key=lambda m: cost(m, radius, rows))
    parts = [b for b in layout(blocks, radius) if b[2] >= 0]
    pieces = max(1, ceil(rows / PART))
    scratch.put(own.select("bits").repartition(pieces, "bits"), "parts")
    files = scratch.files("parts")
    paths = [files[k] for k in sorted(files)]
    cells = []
    for at, (_, width, near) in enumerate(parts):
        price, bits = _bits(width, near, rows)
        shares = max(1, ceil(price / TASK / (len(paths) * (len(paths) + 1) / 2 or 1)))
        cells += [(at, bits, i, j, share, shares) for i in range(len(paths)) for j in range(i, len(paths)) for share in range(shares)]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                at, bits, i, j, share, shares = cells[k]
                a = _read(paths[i])
                x, y = near_pairs(a, None if i == j else _read(paths[j]), parts, at, bits, radius, share, shares)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["x", "y"])

    found = scratch.put(spark.range(0, len(cells), 1, max(1, len(cells))).mapInArrow(compared, "x bigint, y bigint"), "pairs")
    scratch.drop("parts")
    ids = [own.select(F.col("bits").alias(c), F.col("representative").alias(f"id_{c}")) for c in ("x", "y")]
    named = skew_join(skew_join(found, ids[0], "x"), ids[1], "y")
    a, b = F.least("id_x", "id_y"), F.greatest("id_x", "id_y")
    return named.select(a.alias("id_a"), b.alias("id_b"), F.bit_count(F.col("x").bitwiseXOR(F.col("y"))).cast("int").alias("hamming"))
