"""Pluggable batch inference: detectors and encoders run in Python workers over Arrow batches.

A model is given as a factory without arguments; it is called once per worker task, so weights are loaded
where they are used. No weights come with this package; ``HashDetector`` and ``MeanEncoder`` are small
deterministic models for tests and dry runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from corpusloom.functions.geometry import CROP_SIZE, PADDING, crop_window
from corpusloom.operators.detections import CONFIDENCE, DOG_CLASS

# Images of a batch, the patch size that an input must be a multiple of, and the colour means and deviations.
BATCH, PATCH = 32, 14
MEANS, DEVIATIONS = np.array([0.485, 0.456, 0.406]), np.array([0.229, 0.224, 0.225])


class Detector(Protocol):
    """Finds objects in an image of height x width x 3 bytes."""

    def detect(self, image: np.ndarray) -> list[tuple[int, float, tuple[float, float, float, float]]]:
        """(class, confidence, box) of each object."""


class Encoder(Protocol):
    """Turns images into vectors."""

    def encode_batch(self, images: list[np.ndarray]) -> np.ndarray:
        """A row of length 1 per image. With an attribute ``takes_prepared`` that is true, images come as ``prepared``."""


def resize(image: np.ndarray, size: int) -> np.ndarray:
    """Bilinear between the nearest pixels, with pixel centres at half positions and edges repeated, as encoders take their input; float64."""
    out = image.astype(float)
    for axis in (0, 1):
        n = out.shape[axis]
        at = np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        part = (at - low).reshape((-1, 1, 1) if axis == 0 else (1, -1, 1))
        out = np.take(out, low, axis) * (1 - part) + np.take(out, np.minimum(low + 1, n - 1), axis) * part
    return out


def _weights(kernel: Callable[[np.ndarray], np.ndarray], support: float, n: int, size: int) -> np.ndarray:
    """(output, input): whole-numbered weights of a filter that widens as the image shrinks, in units of 2 ** -22."""
    scale = n / size
    wide = max(scale, 1.0)
    centre = (np.arange(size) + 0.5) * scale
    first, last = np.maximum((centre - support * wide + 0.5).astype(int), 0), np.minimum((centre + support * wide + 0.5).astype(int), n)
    at = np.arange(n)[None]
    w = np.where((at >= first[:, None]) & (at < last[:, None]), kernel((at + 0.5 - centre[:, None]) / wide), 0.0)
    w = w / w.sum(1, keepdims=True) * (1 << 22)
    return np.where(w < 0, np.ceil(w - 0.5), np.floor(w + 0.5))


def triangle(x: np.ndarray) -> np.ndarray:
    """The bilinear kernel."""
    return np.maximum(1.0 - np.abs(x), 0.0)


def lanczos(x: np.ndarray) -> np.ndarray:
    """The windowed sinc kernel of three lobes."""
    return np.where(np.abs(x) < 3.0, np.sinc(x) * np.sinc(x / 3), 0.0)


def filtered(image: np.ndarray, size: int, kernel: Callable[[np.ndarray], np.ndarray] = triangle, support: float = 1.0) -> np.ndarray:
    """Bytes resized as image libraries do: the filter covers all pixels that an output pixel stands for, across first, then down, rounded after each."""
    out = image
    for axis in (1, 0):
        if out.shape[axis] == size:
            continue
        w = _weights(kernel, support, out.shape[axis], size)
        sums = np.tensordot(w, out.astype(float), ([1], [axis]))  # whole numbers below 2 ** 53
        out = np.clip(np.floor((sums + (1 << 21)) / (1 << 22)), 0, 255).astype(np.uint8)
        out = np.moveaxis(out, 0, axis)
    return out


def prepared(image: np.ndarray, size: int = CROP_SIZE) -> np.ndarray:
    """An encoder's input: resized, as shares of 255, without mean and deviation; channels first."""
    if size % PATCH:
        raise ValueError(f"the size must be a multiple of {PATCH}")
    return ((resize(image, size) / 255 - MEANS) / DEVIATIONS).transpose(2, 0, 1)


def cut_out(image: np.ndarray, window: dict, size: int = CROP_SIZE) -> np.ndarray:
    """The pixels of a standard crop: the window centred on a grey square, resized."""
    part = image[window["iy1"] : window["iy2"], window["ix1"] : window["ix2"]]
    square = np.full((window["side_px"], window["side_px"], 3), PADDING, np.uint8)
    square[window["off_y"] : window["off_y"] + part.shape[0], window["off_x"] : window["off_x"] + part.shape[1]] = part
    return filtered(square, size)


def _image(row: dict) -> np.ndarray:
    return np.frombuffer(row["rgb"], np.uint8).reshape(int(row["height"]), int(row["width"]), 3)


def _best(found: list, confidence: float) -> tuple[float, list[float]] | None:
    """The confidence and box of the most confident object of the class, the first of equals."""
    own = [(-conf, i, box) for i, (c, conf, box) in enumerate(found) if c == DOG_CLASS and conf >= confidence]
    return (-min(own)[0], [float(x) for x in min(own)[2]]) if own else None


def _encoded(own: Encoder, images: list[np.ndarray], size: int, dim: int | None) -> list[np.ndarray]:
    """The vectors of some images, BATCH at a time; ValueError unless there is one of length 1 (and ``dim`` numbers) for each."""
    if getattr(own, "takes_prepared", False):
        images = [prepared(i, size) for i in images]
    out: list[np.ndarray] = []
    for at in range(0, len(images), BATCH):
        part = np.asarray(own.encode_batch(images[at : at + BATCH]), np.float32)
        if part.ndim != 2 or len(part) != len(images[at : at + BATCH]) or (dim is not None and part.shape[1] != dim):
            raise ValueError(f"the encoder gave {part.shape} for {len(images[at : at + BATCH])} images")
        if not np.allclose(np.linalg.norm(part, axis=1), 1, atol=1e-3):
            raise ValueError("the encoder's vectors are not of length 1")
        out += list(part)
    return out


def detect(images: DataFrame, model: Callable[[], Detector]) -> DataFrame:
    """(path, class_id, idx, conf, bbox): a row per object of ``images`` (path, height, width, rgb); undecoded images have none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = model()
        for frame in frames:
            there = frame[frame["rgb"].notna()].to_dict("records")
            rows = [(r["path"], c, i, conf, list(box)) for r in there for i, (c, conf, box) in enumerate(own.detect(_image(r)))]
            yield pd.DataFrame(rows, columns=["path", "class_id", "idx", "conf", "bbox"])

    return images.select("path", "height", "width", "rgb").mapInPandas(run, "path string, class_id int, idx int, conf double, bbox array<double>")


def encode(images: DataFrame, model: Callable[[], Encoder], size: int = CROP_SIZE, dim: int | None = None) -> DataFrame:
    """``images`` (path, height, width, rgb[, crop]) as (path, embedding); with a crop column, of the crop. Undecoded ones are left out.

    An encoder that gives anything but a vector of length 1 (and of ``dim`` numbers) for each image ends in a ValueError.
    """
    cropped = "crop" in images.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = model()
        for frame in frames:
            rows = frame[frame["rgb"].notna() & (frame["crop"].notna() if cropped else True)].to_dict("records")
            images_ = [cut_out(_image(r), r["crop"], size) if cropped else _image(r) for r in rows]
            yield pd.DataFrame({"path": [r["path"] for r in rows], "embedding": _encoded(own, images_, size, dim)})

    columns = ["path", "height", "width", "rgb", *(["crop"] if cropped else [])]
    return images.select(*columns).mapInPandas(run, "path string, embedding array<float>")


def embed_best(
    images: DataFrame, detector: Callable[[], Detector], encoder: Callable[[], Encoder], confidence: float = CONFIDENCE, size: int = CROP_SIZE, dim: int | None = None
) -> DataFrame:
    """(path, conf, embedding) of every image: of the crop around its most confident object of the class; null where there is none.

    One pass: an image's pixels are detected in, cut and encoded by the task that decoded them, and go nowhere else.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finds, encodes = detector(), encoder()
        for frame in frames:
            rows = frame.to_dict("records")
            found = [None if r["rgb"] is None else _best(finds.detect(_image(r)), confidence) for r in rows]
            windows = [None if f is None else crop_window(f[1], int(r["width"]), int(r["height"])) for r, f in zip(rows, found)]
            there = [i for i, w in enumerate(windows) if w is not None and w["side_px"] > 0]
            vectors = dict(zip(there, _encoded(encodes, [cut_out(_image(rows[i]), windows[i], size) for i in there], size, dim)))
            yield pd.DataFrame({"path": [r["path"] for r in rows], "conf": [None if f is None else f[0] for f in found], "embedding": [vectors.get(i) for i in range(len(rows))]})

    return images.select("path", "height", "width", "rgb").mapInPandas(run, "path string, conf double, embedding array<float>")


class HashDetector:
    """A stand-in: one object, the middle of the image, confidence from its mean brightness."""

    def detect(self, image: np.ndarray) -> list[tuple[int, float, tuple[float, float, float, float]]]:
        """See ``Detector``."""
        h, w = image.shape[:2]
        return [(DOG_CLASS, round(float(image.mean()) / 255, 6), (w * 0.25, h * 0.25, w * 0.75, h * 0.75))]


class MeanEncoder:
    """A stand-in: means of an 8 x 8 grid per channel, at length 1."""

    def encode_batch(self, images: list[np.ndarray]) -> np.ndarray:
        """See ``Encoder``."""
        x = np.stack([resize(i, 8).reshape(-1) for i in images]) if images else np.zeros((0, 192))
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def perceptual_hash(image: np.ndarray) -> str:
    """64 bits as hex: which of the 8 x 8 lowest cosine coefficients of the 32 x 32 grey image exceed their median."""
    grey = (image.astype(np.int64) @ np.array([19595, 38470, 7471]) + 0x8000) >> 16
    grey = filtered(grey.astype(np.uint8), 32, lanczos, 3.0).astype(float)
    k = np.arange(32)
    basis = np.cos(np.pi * (2 * k[None] + 1) * k[:, None] / 64)
    low = (basis @ grey @ basis.T)[:8, :8]
    bits = (low > np.median(low)).reshape(-1)
    return f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"


def with_hashes(images: DataFrame) -> DataFrame:
    """(path, phash_hex) of decoded images; null where an image can't be hashed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            hashes = [perceptual_hash(_image(r)) if r["rgb"] is not None else None for r in frame.to_dict("records")]
            yield pd.DataFrame({"path": frame["path"], "phash_hex": hashes})

    return images.select("path", "height", "width", "rgb").mapInPandas(run, "path string, phash_hex string")
