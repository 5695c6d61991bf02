"""Readers of image folders, annotations and label documents."""

from __future__ import annotations

import io
import os
import re
import struct
import xml.etree.ElementTree as ET
import zlib
from typing import BinaryIO

import numpy as np
import pandas as pd
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.names import CAT_PREFIX, after_dashes, before_last_underscore, file_name, folder_name, stem
from corpusloom.operators.quality import first_reason

# Extensions of images.
EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "webp")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def binary(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, content) of the files under ``path``; content is read only where it is used. FileNotFoundError without the folder."""
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    return reader.load(path).select("path", "content")


def relative(path: Column, root: str) -> Column:
    """The path below ``root``, whatever folders further up are called; scheme and host may be spelled on either side."""
    bare = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", root)
    if bare == root:
        bare = os.path.abspath(root)
    inner = "/+".join(re.escape(p) for p in bare.split("/") if p)
    return F.regexp_replace(path, rf"^(?:[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?)?/*{inner}/+", "") if root else path


def class_folders(spark: SparkSession, root: str) -> DataFrame:
    """(path, label, content) of root/<label>/<image>: images right below a class folder, any letter case of extension.

    Order is not implied; sort by path where it matters.
    """
    files = binary(spark, root).withColumn("rel", relative(F.col("path"), root))
    kind = F.lower(F.regexp_extract("rel", r"\.([^./]*)$", 1))
    return files.filter((F.size(F.split("rel", "/")) == 2) & kind.isin(*EXTENSIONS)).select("path", F.split("rel", "/")[0].alias("label"), "content")


def _verify_chunks(data: bytes) -> None:
    """Every chunk of a PNG file up to its end is there and has its checksum."""
    at = 8
    while True:
        if at + 12 > len(data):
            raise OSError("truncated")
        size = struct.unpack(">I", data[at : at + 4])[0]
        if data[at + 4 : at + 8] == b"IEND":
            return
        if at + 12 + size > len(data):
            raise OSError("truncated")
        if zlib.crc32(data[at + 4 : at + 8 + size]) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise SyntaxError("wrong checksum")
        at += 12 + size


def _size(data: bytes | None) -> tuple[int, int]:
    if not data:
        raise EOFError
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        _verify_chunks(data)
        return struct.unpack(">II", data[16:24])
    if data[:2] == b"BM":
        w, h = struct.unpack("<ii", data[18:26])
        return w, abs(h)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        if data[12:16] == b"VP8X":
            return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
        if data[12:16] == b"VP8L":
            bits = int.from_bytes(data[21:25], "little")
            return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
        w, h = struct.unpack("<HH", data[26:30])
        return w & 0x3FFF, h & 0x3FFF
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(data):
            if data[at] != 0xFF:
                raise SyntaxError
            mark = data[at + 1]
            if mark == 0xFF:
                at += 1
            elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return w, h
            elif mark in (0x01, *range(0xD0, 0xD9)):
                at += 2
            else:
                at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
        raise OSError
    raise ValueError


_FAULTS = {"ValueError": "UnidentifiedImageError", "EOFError": "UnidentifiedImageError", "error": "OSError"}


_SIZE = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("error", T.StringType())])
_BOXES = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("box", T.ArrayType(T.DoubleType()))]))


@F.pandas_udf(_SIZE)
def image_size(content: pd.Series) -> pd.DataFrame:
    """Width and height from the file's header; 0, 0 and corrupt_image:<fault> if it can't be read. PNG files are verified to their end, as they carry checksums."""
    rows = []
    for data in content:
        try:
            rows.append((*_size(data), None))
        except Exception as fault:
            name = type(fault).__name__
            rows.append((0, 0, f"corrupt_image:{_FAULTS.get(name, name)}"))
    return pd.DataFrame(rows, columns=["width", "height", "error"])


@F.pandas_udf(_BOXES)
def voc_boxes(xml: pd.Series) -> pd.Series:
    """Boxes of an annotation document in order: every box element below an object; a missing corner is 0. Null if it can't be parsed."""
    out = []
    for text in xml:
        try:
            root = ET.fromstring(text if text is not None else "")
            corners = ("xmin", "ymin", "xmax", "ymax")
            out.append([{"kind": b.tag, "box": [float(b.findtext(c, "0")) for c in corners]} for o in root.iter("object") for b in o.iter() if b.tag in ("bndbox", "bodybndbox", "headbndbox")])
        except Exception:
            out.append(None)
    return pd.Series(out, dtype=object)


def _first(boxes: str, kind: str) -> Column:
    return F.try_element_at(F.filter(F.col(boxes), lambda b: b["kind"] == kind), F.lit(1))["box"]


def _annotated(images: DataFrame, notes: DataFrame) -> DataFrame:
    sized = images.withColumn("size", image_size("content")).withColumn("md5", F.md5("content")).drop("content")
    return sized.join(notes, ["folder", "key"], "left").select("*", "size.width", "size.height", "size.error")


def _notes(spark: SparkSession, root: str, key: Column) -> DataFrame:
    files = binary(spark, root).select(folder_name(F.col("path")).alias("folder"), key.alias("key"), voc_boxes(F.decode("content", "UTF-8")).alias("boxes"))
    return files


def _manifest(rows: DataFrame, source: str, breed: Column, body: Column, head: Column, n_dogs: Column, reason: Column, image_id: Column) -> DataFrame:
    return rows.select(
        image_id.alias("image_id"),
        F.lit(source).alias("source"),
        "path",
        breed.alias("original_breed"),
        "width",
        "height",
        body.alias("body_bbox"),
        head.alias("head_bbox"),
        n_dogs.cast("int").alias("n_dogs"),
        reason.isNull().alias("usable"),
        reason.alias("exclusion_reason"),
        "md5",
    ).withColumnRenamed("path", "image_path")


def _images(spark: SparkSession, root: str, glob: str, key: Column) -> DataFrame:
    return binary(spark, root, glob).select("path", "content", folder_name(F.col("path")).alias("folder"), file_name(F.col("path")).alias("file"), key.alias("key"))



def scan_folders_by_id(spark: SparkSession, images: str, notes: str, source: str = "stanford") -> DataFrame:
    """Folders <id>-<breed> of *.jpg with annotation files of the same stem and no extension; the first box is the body."""
    rows = _images(spark, images, "*.jpg", stem(file_name(F.col("path"))))
    rows = _annotated(rows, _notes(spark, notes, file_name(F.col("path"))))
    body, none = _first("boxes", "bndbox"), F.lit(None).cast("array<double>")
    count = F.coalesce(F.size(F.filter("boxes", lambda b: b["kind"] == "bndbox")), F.lit(0))
    reason = first_reason(F.col("error"), body, none, F.col("width"), F.col("height"))
    return _manifest(rows, source, after_dashes(F.col("folder"), 2), body, none, F.greatest(count, F.lit(0)), reason, F.concat_ws("/", F.lit(source), "folder", "file"))


def scan_flat(spark: SparkSession, images: str, notes: str, source: str = "oxford") -> DataFrame:
    """A flat folder of <breed>_<n>.jpg; a capital first letter is a cat, kept for rejection tests only. The box is the head; none is no fault, and boxes aren't validated."""
    rows = _images(spark, images, "*.jpg", stem(file_name(F.col("path")))).withColumn("folder", F.lit("flat"))
    marks = _notes(spark, notes, stem(file_name(F.col("path")))).withColumn("folder", F.lit("flat"))
    rows = _annotated(rows, marks)
    name = before_last_underscore(stem(F.col("file")))
    cat = F.substring(name, 1, 1).rlike(r"^\p{Lu}")
    breed = F.when(cat, F.concat(F.lit(CAT_PREFIX), name)).otherwise(F.lower(name))
    reason = F.coalesce("error", F.when(cat, "cat_ood_only"))
    n_dogs = F.when(cat, 0).otherwise(1)
    return _manifest(rows, source, breed, F.lit(None).cast("array<double>"), _first("boxes", "bndbox"), n_dogs, reason, F.concat_ws("/", F.lit(source), "file"))


def scan_folders_by_count(spark: SparkSession, images: str, notes: str, source: str = "tsinghua") -> DataFrame:
    """Folders <n>-<id>-<breed> of *.jpg and *.jpeg with annotations <file>.xml that hold body and head boxes, both validated."""
    rows = _images(spark, images, "*.{jpg,jpeg}", file_name(F.col("path")))
    rows = _annotated(rows, _notes(spark, notes, F.regexp_replace(file_name(F.col("path")), r"\.xml$", "")))
    body, head = _first("boxes", "bodybndbox"), _first("boxes", "headbndbox")
    count = F.coalesce(F.size(F.filter("boxes", lambda b: b["kind"] == "bodybndbox")), F.lit(0))
    reason = first_reason(F.col("error"), body, head, F.col("width"), F.col("height"))
    return _manifest(rows, source, after_dashes(F.col("folder"), 3), body, head, F.greatest(count, F.lit(0)), reason, F.concat_ws("/", F.lit(source), "folder", "file"))


def coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(images, annotations) of a labels document, annotations with their place (idx) in it; flags that no annotation has come out null."""
    note = "struct<image_id:bigint,bbox:array<double>,IsGroupOf:string,IsDepiction:string>"
    doc = spark.read.schema(f"images array<struct<id:bigint,file_name:string,width:int,height:int>>, annotations array<{note}>").json(path, multiLine=True)
    return doc.select(F.inline("images")), doc.select(F.posexplode("annotations").alias("idx", "a")).select("a.*", "idx")


def orientation(data: bytes | BinaryIO | None) -> int:
    """The orientation tag of a JPEG, 1 to 8; 1 where there is none. Of an open file only the segments' heads and the tags are read."""
    source = io.BytesIO(data or b"") if data is None or isinstance(data, (bytes, bytearray)) else data
    if source.read(2) != b"\xff\xd8":
        return 1
    at = 2
    while True:
        source.seek(at)
        head = source.read(10)
        if len(head) < 4 or head[0] != 0xFF or head[1] == 0xDA:
            return 1
        size = struct.unpack(">H", head[2:4])[0]
        if head[1] == 0xE1 and head[4:10] == b"Exif\0\0":
            tags = source.read(max(size - 8, 0))
            order = "<" if tags[:2] == b"II" else ">"
            try:
                first = struct.unpack(f"{order}I", tags[4:8])[0]
                for k in range(struct.unpack(f"{order}H", tags[first : first + 2])[0]):
                    entry = tags[first + 2 + 12 * k : first + 14 + 12 * k]
                    if struct.unpack(f"{order}H", entry[:2])[0] == 0x0112:
                        value = struct.unpack(f"{order}H", entry[8:10])[0]
                        return value if 1 <= value <= 8 else 1
            except struct.error:
                return 1
        at += 2 + size


def upright(image: np.ndarray, tag: int) -> np.ndarray:
    """The pixels turned and mirrored as the orientation tag asks."""
    if tag in (2, 4, 5, 7):
        image = image[:, ::-1]
    return np.rot90(image, {3: 2, 4: 2, 5: 1, 6: 3, 7: 3, 8: 1}.get(tag, 0))


_PIXELS = T.StructType([T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("rgb", T.BinaryType())])


def _opened(path: str) -> BinaryIO:
    """A file of the shared storage, for reading here and there."""
    source, at = pyarrow.fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", re.sub("^file:/+", "file:///", path)))
    return source.open_input_file(at)


@F.pandas_udf(_PIXELS)
def _decoded(path: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series) -> pd.DataFrame:
    rows = []
    for at, h, w, n, raw in zip(path, height, width, channels, data):
        if n not in (1, 3, 4) or not raw:
            rows.append((None, None, None))
            continue
        with _opened(at) as source:
            turn = orientation(source)
        x = np.frombuffer(raw, np.uint8).reshape(h, w, n)
        x = upright(np.repeat(x, 3, 2) if n == 1 else x[:, :, 2::-1], turn)
        rows.append((x.shape[0], x.shape[1], np.ascontiguousarray(x).tobytes()))
    return pd.DataFrame(rows, columns=["height", "width", "rgb"])


def pixels(spark: SparkSession, root: str, paths: list[str] | None = None) -> DataFrame:
    """(path, height, width, rgb): decoded images, upright, channels in the order red, green, blue; nulls where an image can't be decoded.

    ``paths``, if given, are the only files that are read. Files are decoded once; of each only the segments' heads are read again, for the
    orientation, by the task that has its pixels: nothing is joined or shuffled.
    """
    reader = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "false")
    rows = reader.load(root if paths is None else paths).select("image.*")
    rows = rows.select(F.regexp_replace("origin", "^file:/+", "file:/").alias("path"), "height", "width", "nChannels", "data")  # as the other readers spell it
    return rows.select("path", _decoded("path", "height", "width", "nChannels", "data").alias("p")).select("path", "p.*")


def low_folder(spark: SparkSession, root: str) -> str:
    """The first folder below ``root`` whose name begins with "low", in any case, and has no "annot" in it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    names = sorted(f.getPath().getName() for f in found if f.isDirectory())
    for name in names:
        if name.lower().startswith("low") and "annot" not in name.lower():
            return f"{root.rstrip('/')}/{name}"
    raise FileNotFoundError(f"no folder of small images in {root}")


def scan_all(spark: SparkSession, raw: str) -> DataFrame:
    """One manifest of the three corpora below ``raw``, each laid out as its publishers do."""
    low = low_folder(spark, f"{raw}/tsinghua")
    parts = [
        scan_folders_by_id(spark, f"{raw}/stanford/Images", f"{raw}/stanford/Annotation"),
        scan_flat(spark, f"{raw}/oxford/images", f"{raw}/oxford/annotations/xmls"),
        scan_folders_by_count(spark, low, f"{raw}/tsinghua/annotations/Low-Annotations"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
