"""Writers. Every stage writes a new path; nothing overwrites a table that it reads."""

from __future__ import annotations

import os
import shutil
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.geometry import CROP_SIZE
from corpusloom.operators.inference import cut_out
from corpusloom.plans.prototype import Prototypes
from corpusloom.sources import jpeg

# Fixed value: the quality of crops as JPEG files.
QUALITY = 92


def write_table(df: DataFrame, path: str) -> None:
    """Parquet, replacing what is at ``path``."""
    df.write.mode("overwrite").parquet(path)


def write_splits(manifest: DataFrame, path: str) -> None:
    """The listed rows by split, a folder each."""
    rows = manifest.filter(F.col("in_mvp25") & F.col("split").isin("train", "val", "test"))
    rows.write.mode("overwrite").partitionBy("split").parquet(path)


def write_taxonomy(taxonomy: DataFrame, path: str) -> None:
    """One CSV file in the order of action, canonical label and source; a taxonomy has a row per label and corpus."""
    rows = taxonomy.repartitionByRange(1, "action").sortWithinPartitions("action", "canonical_label", "source", "original_label")
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_prototypes(prototypes: Prototypes, path: str) -> None:
    """classes and global_mean as tables below ``path``."""
    write_table(prototypes.classes, f"{path}/classes")
    write_table(prototypes.global_mean, f"{path}/global_mean")


def read_prototypes(spark: SparkSession, path: str) -> Prototypes:
    """What ``write_prototypes`` wrote."""
    return Prototypes(spark.read.parquet(f"{path}/classes"), spark.read.parquet(f"{path}/global_mean"), None)


def write_files(files: DataFrame, root: str) -> None:
    """Write (rel_path, text) as files below ``root``, a folder that every worker sees; existing files are replaced."""

    def write(rows: Iterator[Row]) -> None:
        for row in rows:
            at = os.path.join(root, row.rel_path)
            os.makedirs(os.path.dirname(at), exist_ok=True)
            with open(at, "w", encoding="utf-8") as f:
                f.write(row.text)

    files.select("rel_path", "text").filter("rel_path IS NOT NULL AND text IS NOT NULL").foreachPartition(write)


def put_file(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file from the driver, on whatever storage ``path`` names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def write_report(text: str, path: str) -> None:
    """A report as a file of the driver's."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def link_files(files: DataFrame, source: str, root: str) -> int:
    """Link (image_path, target) below ``source`` to below ``root``, by hard link or, between file systems, by copy; how many were there.

    Either separator may stand in image_path. Targets that exist already stay.
    """
    linked = files.sparkSession.sparkContext.accumulator(0)

    def link(rows: Iterator[Row]) -> None:
        for row in rows:
            at, to = os.path.join(source, row.image_path.replace("\\", "/")), os.path.join(root, row.target)
            if os.path.exists(at):
                os.makedirs(os.path.dirname(to), exist_ok=True)
                if not os.path.exists(to):
                    try:
                        os.link(at, to)
                    except OSError:
                        shutil.copyfile(at, to)
                linked.add(1)

    files.select("image_path", "target").filter("image_path IS NOT NULL AND target IS NOT NULL").foreachPartition(link)
    return linked.value


def png(image: np.ndarray) -> bytes:
    """An image of height x width x 3 bytes as a PNG file."""
    h, w = image.shape[:2]
    raw = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(image).reshape(h, w * 3)], axis=1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def write_crops(crops: DataFrame, root: str, size: int = CROP_SIZE) -> tuple[int, int]:
    """Write the crops of (target, height, width, rgb, crop) below ``root`` as JPEG files; (written, failed)."""
    sc = crops.sparkSession.sparkContext
    written, failed = sc.accumulator(0), sc.accumulator(0)

    def write(rows: Iterator[Row]) -> None:
        for row in rows:
            try:
                image = np.frombuffer(row.rgb, np.uint8).reshape(row.height, row.width, 3)
                at = os.path.join(root, row.target)
                os.makedirs(os.path.dirname(at), exist_ok=True)
                with open(at, "wb") as f:
                    f.write(jpeg.encode(cut_out(image, row.crop.asDict(), size), QUALITY))
                written.add(1)
            except Exception:
                failed.add(1)

    crops.select("target", "height", "width", "rgb", "crop").foreachPartition(write)
    return written.value, failed.value


def remove_files(files: DataFrame, root: str) -> int:
    """Remove (rel_path) below ``root``; how many there were."""
    removed = files.sparkSession.sparkContext.accumulator(0)

    def remove(rows: Iterator[Row]) -> None:
        for row in rows:
            at = os.path.join(root, row.rel_path)
            if os.path.exists(at):
                os.unlink(at)
                removed.add(1)

    files.select("rel_path").distinct().foreachPartition(remove)
    return removed.value


def write_detection_config(root: str) -> None:
    """The class list and data description of the detection export."""
    os.makedirs(root, exist_ok=True)
    with open(os.path.join(root, "classes.txt"), "w", encoding="utf-8") as f:
        f.write("0 dog_body\n1 dog_head\n")
    with open(os.path.join(root, "data.yaml"), "w", encoding="utf-8") as f:
        f.write("path: .\ntrain: images/train\nval: images/val\ntest: images/test\nnames:\n  0: dog\n")
