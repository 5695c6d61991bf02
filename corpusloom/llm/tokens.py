"""Problem 7: a whole corpus encoded with a public byte-level BPE tokenizer.

Method: speculate and verify. Greedy longest match proposes the tokens of a word; a proposal is right
exactly if every adjacent pair of its tokens is compatible, that is, if encoding the pair's bytes gives
the pair back. Pairs are tested together, as arrays: the tokens at the right edge of the first and the
left edge of the second are followed down the tree of merges, and a pair fails if a merge across the
border would come before the merges on either side. Only words with a failing pair undergo merging.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import let_workers_import

#: Folder and file of the vocabulary; read by the driver, sent to the workers (1.6 MB).
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.json"
# Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words that a worker keeps, and their longest; beyond it starts afresh, which changes no result.
KEEP_WORDS, KEEP_BYTES = 200_000, 48
#: Tokens of a batch that a worker returns.
BATCH_TOKENS = 1_000_000

_ENCODERS: dict[str, Encoder] = {}


def _byte_letters() -> dict[str, int]:
    """The letters by which vocabulary files name bytes: printable bytes name themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Encodes texts; holds the vocabulary, the tree of merges and what earlier words gave."""

    def __init__(self, vocabulary: bytes):
        model = json.loads(vocabulary)["model"]
        letters = _byte_letters()
        raw = {name: bytes(letters[c] for c in name) for name in model["vocab"] if all(c in letters for c in name)}
        self.words = regex.compile(PATTERN)
        self.ids = {raw[name]: i for name, i in model["vocab"].items() if name in raw}
        self.size = max(self.ids.values()) + 1
        self.longest = max(map(len, self.ids))
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([self.ids[raw[a]] for a, _ in merges], np.int64)
        right = np.array([self.ids[raw[b]] for _, b in merges], np.int64)
        made = np.array([self.ids[raw[a] + raw[b]] for a, b in merges], np.int64)
        rank = np.arange(len(merges), dtype=np.int64)
        self.merges = dict(zip(zip(left.tolist(), right.tolist()), zip(rank.tolist(), made.tolist())))
        key = left * self.size + right
        order = np.argsort(key, kind="stable")
        self.pair_keys, self.pair_ranks = key[order], rank[order]
        self._edges(left, right, made, rank)
        self.bytes_ = [self.ids[bytes([b])] for b in range(256)]
        self.known_words: dict[str, tuple[int, ...]] = {}
        self.failed = self.checked = 0
        own = self._formed()
        self.proposals = {t: i for t, i in self.ids.items() if own[i]}

    def _edges(self, left: np.ndarray, right: np.ndarray, made: np.ndarray, rank: np.ndarray) -> None:
        """Tokens along each token's edges, outermost first, with the rank of the merge that ends each (never: for the token itself)."""
        lefts, rights, ranks = (np.full(self.size, -1, np.int64) for _ in range(3))
        lefts[made[::-1]], rights[made[::-1]], ranks[made[::-1]] = left[::-1], right[::-1], rank[::-1]
        never = len(rank)

        def follow(child: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            tokens, ends = [np.arange(self.size)], [np.full(self.size, never, np.int64)]
            while True:
                now = tokens[-1]
                down = np.where(now >= 0, child[now], -1)
                if (down < 0).all():
                    return np.stack(tokens, 1), np.stack(ends, 1)
                tokens.append(down)
                ends.append(np.where(down >= 0, ranks[now], -1))

        self.right_edge, self.right_end = follow(rights)
        self.left_edge, self.left_end = follow(lefts)
        self.split = np.stack([lefts, rights], 1)

    def _formed(self) -> np.ndarray:
        """Of each token, whether merging its own bytes gives it back: its two parts do, and nothing crosses their border earlier."""
        ok = np.zeros(self.size, bool)
        ok[self.bytes_] = True
        formed = np.flatnonzero(self.split[:, 0] >= 0)
        quiet = ~self._crosses(*self.split[formed].T, inner=True)
        for t, (a, b), q in zip(formed.tolist(), self.split[formed].tolist(), quiet.tolist()):  # parts come before what they form
            ok[t] = q and ok[a] and ok[b]
        return ok

    def _crosses(self, a: np.ndarray, b: np.ndarray, inner: bool = False) -> np.ndarray:
        """Of each pair of tokens, whether merging the joined bytes merges across their border.

        ``inner`` leaves out the merge of the two whole tokens, which is what forms a token.
        """
        out = np.zeros(len(a), bool)
        for i in range(self.right_edge.shape[1]):
            at = np.flatnonzero((self.right_edge[a, i] >= 0) & ~out)
            if not len(at):
                break
            x, x_end = self.right_edge[a[at], i], self.right_end[a[at], i]
            for j in range(self.left_edge.shape[1]):
                y, y_end = self.left_edge[b[at], j], self.left_end[b[at], j]
                if (y < 0).all():
                    break
                if inner and i == j == 0:
                    continue
                key = x * self.size + y
                k = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
                rank = self.pair_ranks[k]
                # of equal ranks the leftmost merge goes first
                out[at] |= (y >= 0) & (self.pair_keys[k] == key) & (rank < x_end) & (rank <= y_end)
        return out

    def greedy(self, word: bytes) -> list[int]:
        """The tokens of the longest matches from left to right."""
        out, at, n, proposals = [], 0, len(word), self.proposals
        while at < n:
            end = min(n, at + self.longest)
            while (token := proposals.get(word[at:end])) is None:
                end -= 1
            out.append(token)
            at = end
        return out

    def merge(self, word: bytes) -> list[int]:
        """The tokens by merging: again and again the pair of lowest rank, the leftmost of equals."""
        tokens = [self.bytes_[b] for b in word]
        after = list(range(1, len(tokens) + 1))
        before = list(range(-1, len(tokens) - 1))
        merges, heap, end = self.merges, [], len(tokens)
        for i in range(end - 1):
            if m := merges.get((tokens[i], tokens[i + 1])):
                heap.append((m[0], i, tokens[i], tokens[i + 1], m[1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if tokens[i] != a or j >= end or tokens[j] != b:
                continue  # one of the two has been merged meanwhile
            tokens[i], tokens[j] = new, -1
            after[i] = k = after[j]
            if k < end:
                before[k] = i
                if m := merges.get((new, tokens[k])):
                    heapq.heappush(heap, (m[0], i, new, tokens[k], m[1]))
            if (h := before[i]) >= 0 and (m := merges.get((tokens[h], new))):
                heapq.heappush(heap, (m[0], h, tokens[h], new, m[1]))
        return [t for t in tokens if t >= 0]

    def learn(self, words: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """The tokens of each of ``words``."""
        words = list(words)
        raw = [w.encode("utf-8") for w in words]
        guesses = [self.greedy(r) for r in raw]
        lengths = np.array([len(g) for g in guesses], np.int64)
        flat = np.fromiter(chain.from_iterable(guesses), np.int64, int(lengths.sum()))
        pairs = flat[:-1] * self.size + flat[1:]
        owner = np.repeat(np.arange(len(words)), lengths)
        inside = owner[:-1] == owner[1:] if len(flat) else np.zeros(0, bool)
        pairs, owner = pairs[inside], owner[:-1][inside] if len(flat) else owner
        unique, at = np.unique(pairs, return_inverse=True)
        bad = self._crosses(unique // self.size, unique % self.size)
        failing = np.zeros(len(words), bool)
        failing[owner[bad[at]]] = True
        self.checked += len(words)
        self.failed += int(failing.sum())
        return {w: tuple(self.merge(r) if f else g) for w, r, g, f in zip(words, raw, guesses, failing)}

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text."""
        split = [self.words.findall(t) for t in texts]
        known = self.known_words
        new = set(chain.from_iterable(split)).difference(known)
        if new:
            if len(known) + len(new) > KEEP_WORDS:
                known.clear()
                new = set(chain.from_iterable(split))
            short = [w for w in new if len(w) <= KEEP_BYTES]
            known |= self.learn(short)
            if len(short) < len(new):
                long = self.learn(w for w in new if len(w) > KEEP_BYTES)  # these aren't kept
                return [list(chain.from_iterable(known[w] if w in known else long[w] for w in words)) for words in split]
        return [list(chain.from_iterable(map(known.__getitem__, words))) for words in split]


def encoder(vocabulary: bytes) -> Encoder:
    """The encoder of this vocabulary, one per worker process."""
    name = hashlib.md5(vocabulary).hexdigest()
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(vocabulary)
    return _ENCODERS[name]


def _chunks(texts: list[str | None], characters: int = 400_000) -> Iterator[list[str]]:
    chunk, n = [], 0
    for t in texts:
        chunk.append(t or "")
        n += len(chunk[-1])
        if n >= characters:
            yield chunk
            chunk, n = [], 0
    if chunk:
        yield chunk


def _encoded(texts: pa.Array, vocabulary: bytes) -> Iterator[list[list[int]]]:
    enc = encoder(vocabulary)
    for start in range(0, len(texts), 1000):
        for chunk in _chunks(texts.slice(start, 1000).to_pylist()):
            yield enc.encode_all(chunk)


def _shipped(spark: SparkSession, path: str):  # noqa: ANN202
    let_workers_import(spark)
    return spark.sparkContext.broadcast((Path(path) if Path(path).is_file() else Path(path) / VOCABULARY).read_bytes())


def encode(df: DataFrame, key: str, text: str, path: str = TOKENIZERS) -> DataFrame:
    """(key, ids) of each row: the ids of ``text`` without special tokens, whose strings are ordinary text.

    Null and empty texts get the empty list; blank ones are encoded like any other. Rows with a null or
    repeated key stay. Other columns of ``df`` are not read. No shuffle.
    """
    vocabulary = _shipped(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, at = batch.column(0), 0
            lists: list[list[int]] = []
            for part in _encoded(batch.column(1), vocabulary.value):
                lists += part
                if sum(map(len, lists)) >= BATCH_TOKENS or at + len(lists) == len(keys):
                    ids = pa.array(lists, pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([keys.slice(at, len(lists)), ids], ["key", "ids"])
                    at += len(lists)
                    lists = []

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, ids array<int>")
    return out.withColumnRenamed("key", key)


def count_tokens(df: DataFrame, text: str, path: str = TOKENIZERS, name: str = "n_tokens") -> DataFrame:
    """``df`` without ``text``, with the number of its tokens in ``name``; 0 for null and empty texts."""
    vocabulary = _shipped(df.sparkSession, path)
    others = [c for c in df.columns if c != text]
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [len(ids) for part in _encoded(batch.column(len(others)), vocabulary.value) for ids in part]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], [*others, name])

    return df.select(*others, F.col(text).cast("string").alias("__text")).mapInArrow(run, f"{kinds}{', ' if kinds else ''}`{name}` bigint")


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The token ids of every document."""
    return encode(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text")


QUERIES = {"p7_ids": p7_ids}
