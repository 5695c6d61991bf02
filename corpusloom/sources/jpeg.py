"""A baseline JPEG encoder (ITU-T T.81) over arrays: colour at half resolution, Huffman tables fitted to the image."""

from __future__ import annotations

import heapq
import struct

import numpy as np

# The example quantisation tables of the standard's Annex K, row by row.
LUMINANCE = """16 11 10 16 24 40 51 61  12 12 14 19 26 58 60 55  14 13 16 24 40 57 69 56  14 17 22 29 51 87 80 62
18 22 37 56 68 109 103 77  24 35 55 64 81 104 113 92  49 64 78 87 103 121 120 101  72 92 95 98 112 100 103 99"""
CHROMINANCE = """17 18 24 47 99 99 99 99  18 21 26 66 99 99 99 99  24 26 56 99 99 99 99 99  47 66 99 99 99 99 99 99
99 99 99 99 99 99 99 99  99 99 99 99 99 99 99 99  99 99 99 99 99 99 99 99  99 99 99 99 99 99 99 99"""
#: Places of an 8 x 8 block along its diagonals, upwards and downwards in turn.
ZIGZAG = np.array([8 * r + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (sum(p), p[1 - sum(p) % 2]))])
_K = np.arange(8)
COSINES = np.sqrt(np.where(_K == 0, 1, 2) / 8)[:, None] * np.cos(np.pi * (2 * _K[None] + 1) * _K[:, None] / 16)


def steps(table: str, quality: int) -> np.ndarray:
    """The quantisation steps for a quality of 1 to 100."""
    percent = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(table.split(), int).reshape(8, 8) * percent + 50) // 100, 1, 255)


def _blocks(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
    """(row of blocks, column, 64): the quantised coefficients in zigzag order."""
    h, w = plane.shape[0] // 8, plane.shape[1] // 8
    tiles = (plane - 128).reshape(h, 8, w, 8).transpose(0, 2, 1, 3)
    return np.rint(COSINES @ tiles @ COSINES.T / table).astype(np.int64).reshape(h, w, 64)[:, :, ZIGZAG]


def _lengths(counts: np.ndarray) -> dict[int, int]:
    """The code length of each symbol that occurs, 16 at most, with no code of ones only."""
    heap = [(int(n), s, (s,)) for s, n in enumerate(counts) if n] + [(0, len(counts), (len(counts),))]  # the last takes the code of ones
    depth = dict.fromkeys((s for _, s, _ in heap), 0)
    heapq.heapify(heap)
    if len(heap) == 1:
        return {}
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            depth[s] += 1
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
    # too long codes are cut; shorter ones are lengthened, rarest first, until all fit
    found = {s: min(d, 16) for s, d in depth.items()}
    weight = lambda s: int(counts[s]) if s < len(counts) else 0
    while sum(2.0**-d for d in found.values()) > 1:
        s = min((s for s in found if found[s] < 16), key=lambda s: (-found[s], weight(s)))
        found[s] += 1
    order = sorted(found, key=lambda s: (-weight(s), s))
    return dict(zip(order[:-1], sorted(found.values())))  # the unused one is the longest


def _table(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(codes, lengths) by symbol, and the table as it is written: how many of each length, then the symbols."""
    lengths = _lengths(counts)
    codes, sizes, code, last = np.zeros(256, np.uint64), np.zeros(256, np.int64), 0, 0
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    for s in order:
        code <<= lengths[s] - last
        codes[s], sizes[s], last = code, lengths[s], lengths[s]
        code += 1
    return codes, sizes, bytes(sum(d == k for d in lengths.values()) for k in range(1, 17)) + bytes(order)


def encode(image: np.ndarray, quality: int = 92) -> bytes:
    """``image`` (height x width x 3 bytes) as a JPEG file."""
    h, w = image.shape[:2]
    x = np.pad(image.astype(float), ((0, -h % 16), (0, -w % 16), (0, 0)), mode="edge")
    luma = x @ [0.299, 0.587, 0.114]
    half = lambda p: p.reshape(p.shape[0] // 2, 2, p.shape[1] // 2, 2).mean((1, 3))
    planes = [luma, half(128 + (x[..., 2] - luma) / 1.772), half(128 + (x[..., 0] - luma) / 1.402)]
    tables = [steps(LUMINANCE, quality), steps(CHROMINANCE, quality)]
    y, *colours = (_blocks(p, tables[min(i, 1)]) for i, p in enumerate(planes))
    units = y.reshape(y.shape[0] // 2, 2, y.shape[1] // 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 4, 64)
    blocks = np.concatenate([units, *[c.reshape(-1, 1, 64) for c in colours]], 1).reshape(-1, 64)
    colour = np.tile([0, 0, 0, 0, 1, 1], len(units))
    for part in ([0, 1, 2, 3], [4], [5]):  # the first coefficient is the difference from that of the block before
        at = (np.arange(len(units))[:, None] * 6 + part).ravel()
        blocks[at, 0] = np.diff(blocks[at, 0], prepend=0)

    owner, place = np.nonzero(blocks[:, 1:])
    value = blocks[owner, place + 1]
    run = place - np.where(np.diff(owner, prepend=-1) == 0, np.roll(place, 1), -1) - 1
    size = lambda v: np.ceil(np.log2(np.abs(v) + 1)).astype(np.int64)
    everyone = np.arange(len(blocks))
    last = np.full(len(blocks), -1)
    last[owner] = place  # the last assignment counts
    ends, skips = everyone[last < 62], np.repeat(np.arange(len(owner)), run // 16)
    # (block, place in it, table, symbol, value, bits of the value)
    events = [
        (everyone, np.full(len(blocks), -2), 2 * colour, size(blocks[:, 0]), blocks[:, 0], size(blocks[:, 0])),
        (owner, 2 * place + 1, 2 * colour[owner] + 1, run % 16 * 16 + size(value), value, size(value)),
        (owner[skips], 2 * place[skips], 2 * colour[owner[skips]] + 1, np.full(len(skips), 0xF0), np.zeros(len(skips), int), np.zeros(len(skips), int)),
        (ends, np.full(len(ends), 999), 2 * colour[ends] + 1, np.zeros(len(ends), int), np.zeros(len(ends), int), np.zeros(len(ends), int)),
    ]
    block, where, table, symbol, value, extra = (np.concatenate([e[i] for e in events]) for i in range(6))
    order = np.lexsort((where, block))
    table, symbol, value, extra = table[order], symbol[order], value[order], extra[order]
    codes, lengths, huffman = np.zeros(len(table), np.uint64), np.zeros(len(table), np.int64), []
    for t in range(4):
        own = table == t
        code, length, written = _table(np.bincount(symbol[own], minlength=256))
        codes[own], lengths[own] = code[symbol[own]], length[symbol[own]]
        huffman.append(written)
    bits = np.where(value < 0, value + (1 << extra) - 1, value).astype(np.uint64)
    whole, total = codes << extra.astype(np.uint64) | bits, lengths + extra
    within = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
    stream = (np.repeat(whole, total) >> (np.repeat(total, total) - 1 - within).astype(np.uint64) & np.uint64(1)).astype(np.uint8)
    data = np.packbits(np.concatenate([stream, np.ones(-len(stream) % 8, np.uint8)])).tobytes().replace(b"\xff", b"\xff\0")

    segment = lambda kind, body: struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body
    out = [b"\xff\xd8", segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")]
    out += [segment(0xDB, bytes([i]) + bytes(t.reshape(64)[ZIGZAG].astype(np.uint8))) for i, t in enumerate(tables)]
    out.append(segment(0xC0, struct.pack(">BHHB", 8, h, w, 3) + bytes([1, 0x22, 0, 2, 0x11, 1, 3, 0x11, 1])))
    out += [segment(0xC4, bytes([t % 2 << 4 | t // 2]) + written) for t, written in enumerate(huffman)]
    out.append(segment(0xDA, bytes([3, 1, 0x00, 2, 0x11, 3, 0x11, 0, 63, 0])))
    return b"".join([*out, data, b"\xff\xd9"])
