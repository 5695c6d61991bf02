"""Score-aware quantisation: four bits a place, under a loss that spares large inner products.

A vector is cut into places of WIDTH numbers, each coded as one of 16 codewords. Codebooks and codes
minimise an anisotropic loss, in which the part of the residual that is parallel to the vector, the one that
spoils large inner products, weighs more. A query's inner product with a code is the sum of one entry
of a table of 16 a place; for many queries at once these sums are the product with the decoded vectors.
"""

from __future__ import annotations

import numpy as np

#: Numbers a place, codewords, vectors the codebooks are fitted on at most, rounds of plain and of anisotropic fitting.
WIDTH, WORDS, FIT_ROWS, PLAIN, ROUNDS = 1, 16, 4000, 4, 3
#: Inner product t from which the loss counts, in deviations of unrelated vectors' products, 1 / sqrt(dim).
LOSS_FROM = 2.0


def weight(dim: int) -> float:
    """How much more the parallel residual weighs than the rest: (dim - 1) * t^2 / (1 - t^2)."""
    square = LOSS_FROM**2 / dim
    return (dim - 1) * square / (1 - square)


def _misses(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(square of the residual, residual times vector) of each row of one place under each codeword."""
    cross, own = part @ book.T, (part * part).sum(1)[:, None]
    return own - 2 * cross + (book * book).sum(1)[None], own - cross


def code(x: np.ndarray, books: np.ndarray, sweeps: int = 2) -> np.ndarray:
    """The codes of the rows of ``x``: the nearest codewords, then improved one place after the other under the anisotropic loss."""
    n, dim = x.shape
    parts = np.ascontiguousarray(x.reshape(n, len(books), -1).transpose(1, 0, 2))
    eta, rows = np.float32(weight(dim) - 1), np.arange(n)
    codes = np.empty((len(books), n), np.uint8)
    parallel = np.zeros((len(books), n), np.float32)  # residual times vector, by place
    for m, book in enumerate(books):
        square, along = _misses(parts[m], book)
        codes[m] = square.argmin(1)
        parallel[m] = along[rows, codes[m]]
    total = parallel.sum(0)
    for _ in range(sweeps):
        for m, book in enumerate(books):
            square, along = _misses(parts[m], book)
            rest = total - parallel[m]
            codes[m] = (square + eta * (rest[:, None] + along) ** 2).argmin(1)
            parallel[m] = along[rows, codes[m]]
            total = rest + parallel[m]
    return np.ascontiguousarray(codes.T)


def fit(x: np.ndarray) -> np.ndarray:
    """Codebooks (place, codeword, number) of the sample ``x``: codes and codewords are improved in turn."""
    n, dim = x.shape
    parts = x.reshape(n, -1, WIDTH)
    places, eta = parts.shape[1], weight(dim) - 1
    start = np.resize(np.random.default_rng(7).permutation(n)[:WORDS], WORDS)
    books = np.stack([parts[start, m] for m in range(places)]).astype(np.float32)
    books += np.random.default_rng(8).normal(0, 1e-4, books.shape).astype(np.float32)
    for k in range(PLAIN + ROUNDS):
        pull_by = eta if k >= PLAIN else 0.0
        codes = code(x, books, 1 if k >= PLAIN else 0)
        along = ((parts - looked_up(codes, books).reshape(parts.shape)) * parts).sum(2)
        total = along.sum(1)
        for m in range(places):
            p, c = parts[:, m].astype(np.float64), codes[:, m]
            pull = pull_by * (total - along[:, m] + (p * p).sum(1))
            count = np.bincount(c, minlength=WORDS)
            right = np.stack([np.bincount(c, (1 + pull) * p[:, i], WORDS) for i in range(WIDTH)], 1)
            outer = np.stack([np.stack([np.bincount(c, p[:, i] * p[:, j], WORDS) for j in range(WIDTH)], 1) for i in range(WIDTH)], 1)
            left = count[:, None, None] * np.eye(WIDTH) + pull_by * outer
            some = count > 0
            books[m][some] = np.linalg.solve(left[some], right[some][..., None])[..., 0]
    return books


def looked_up(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The vectors that ``codes`` (row, place) stand for."""
    return books[np.arange(len(books))[None], codes].reshape(len(codes), -1)


def pack(codes: np.ndarray) -> np.ndarray:
    """Two codes a byte; the number of places is even."""
    return codes[:, 0::2] << 4 | codes[:, 1::2]


def decode(packed: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The vectors that packed codes stand for."""
    codes = np.empty((len(packed), len(books)), np.uint8)
    codes[:, 0::2], codes[:, 1::2] = packed >> 4, packed & 15
    return looked_up(codes, books)


def scan(queries: np.ndarray, codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Estimated inner products (query, row), which are the sums of the queries' table entries over all places."""
    return queries @ looked_up(codes, books).T


def error(x: np.ndarray, books: np.ndarray) -> float:
    """The deviation of estimated from exact inner products among the sample ``x``; that of its nearest pairs if it is larger."""
    x = x[:2048]
    off = x - looked_up(code(x, books), books)
    exact, miss = x @ x.T, x @ off.T
    other = ~np.eye(len(x), dtype=bool)
    near = other & (exact >= 0.5)
    all_pairs = miss[other].std() if other.any() else 0.0
    return float(max(all_pairs, miss[near].std() if near.any() else 0.0))
