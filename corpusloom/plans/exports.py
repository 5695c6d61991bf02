"""What is exported where: crops, label lines, removal lists, as tables; writing them is the sinks' work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.geometry import crop, label_line, xywh_to_xyxy
from corpusloom.functions.names import CAT_LABEL, before_last_underscore, file_name, folder_name, stem
from corpusloom.operators.detections import accepted, plain_annotations, strict_join
from corpusloom.operators.quality import listed_rows

# Splits of the detection export by corpus folder.
DETECTION_SPLITS = {"open_images/train": "train", "open_images/validation": "val", "coco/validation": "test"}


def crops(manifest: DataFrame) -> DataFrame:
    """(image_id, image_path, part, target, crop): body and head crops of the listed rows that have such a box."""
    rows = listed_rows(manifest)
    parts = F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.col(f"{p}_bbox").alias("box")) for p in ("body", "head")])).alias("c")
    boxes = rows.select("image_id", "image_path", "split", "canonical_breed", "width", "height", parts).filter(F.size("c.box") == 4)
    target = F.concat_ws("/", F.concat(F.lit("breed_"), "c.part"), "split", "canonical_breed", F.concat(stem(file_name(F.col("image_path"))), F.lit(".jpg")))
    return boxes.select("image_id", "image_path", F.col("c.part").alias("part"), target.alias("target"), crop(F.col("c.box"), F.col("width"), F.col("height")).alias("crop"))


def cat_copies(manifest: DataFrame) -> DataFrame:
    """(image_id, image_path, target) of cats with a split: originals, uncropped."""
    rows = manifest.filter((F.col("canonical_breed") == CAT_LABEL) & F.col("split").isNotNull())
    return rows.select("image_id", "image_path", F.concat_ws("/", F.lit("ood"), "split", F.lit("cat"), file_name(F.col("image_path"))).alias("target"))


def _labelled(rows: DataFrame, lines: Column, folder: Column) -> DataFrame:
    """(image_id, image_path, target, rel_path, text): where the image and the label file of each row with a line go in the labelled tree."""
    name = file_name(F.col("image_path"))
    rows = rows.withColumn("lines", lines).filter(F.size("lines") > 0)
    target = F.concat_ws("/", "source", F.lit("images"), folder, name).alias("target")
    path = F.concat_ws("/", "source", F.lit("labels"), folder, F.concat(stem(name), F.lit(".txt"))).alias("rel_path")
    return rows.select("image_id", "image_path", target, path, F.array_join("lines", "\n").alias("text"))


def _line(kind: int, box: str) -> Column:
    return F.when(F.size(box) == 4, label_line(kind, F.col(box), F.col("width"), F.col("height")))


def label_files(manifest: DataFrame) -> DataFrame:
    """(image_id, image_path, target, rel_path, text): image and label file of each usable row with a box, a line per box, body first.

    Oxford's rows have heads only; their bodies come from ``pseudo_label_files``.
    """
    rows = manifest.filter(F.col("usable") & ~F.col("source").eqNullSafe("oxford"))
    return _labelled(rows, F.array_compact(F.array(_line(0, "body_bbox"), _line(1, "head_bbox"))), folder_name(F.col("image_path")))


def pseudo_label_files(manifest: DataFrame, pseudo: DataFrame) -> DataFrame:
    """The same of Oxford's rows, whose body is the pseudo box where that needs no review; the folder is the breed in the file's name. KeyError for a box of no such row."""
    rows = manifest.filter(F.col("usable") & (F.col("source") == "oxford"))
    rows = strict_join(accepted(pseudo).select("image_id", "pseudo_body_bbox"), rows, "image_id")
    lines = F.array_compact(F.array(_line(0, "pseudo_body_bbox"), _line(1, "head_bbox")))
    return _labelled(rows, lines, before_last_underscore(file_name(F.col("image_path"))))


def annotation_label_files(images: DataFrame, annotations: DataFrame, corpus: str, present: DataFrame | None = None) -> DataFrame:
    """(image_path, target, rel_path, text) of ``images`` (id, file_name, width, height) with plain ``annotations``, a line per box in their order.

    ``present`` (file_name), if given, are the files there are; others are left out. KeyError for an annotation of no image.
    """
    boxes = strict_join(plain_annotations(annotations).withColumnRenamed("image_id", "id"), images, "id").withColumn("box", xywh_to_xyxy(F.col("bbox")))
    if present is not None:
        boxes = boxes.join(present.select("file_name").distinct(), "file_name", "left_semi")
    lines = boxes.groupBy("id", "file_name").agg(F.sort_array(F.collect_list(F.struct("idx", _line(0, "box").alias("line")))).alias("lines"))  # the boxes of one image
    target, path = F.concat_ws("/", F.lit(corpus), F.lit("images"), "file_name"), F.concat_ws("/", F.lit(corpus), F.lit("labels"), F.concat(stem(F.col("file_name")), F.lit(".txt")))
    return lines.select(F.concat(F.lit("data/"), "file_name").alias("image_path"), target.alias("target"), path.alias("rel_path"), F.array_join(F.array_compact(F.col("lines.line")), "\n").alias("text"))


def removals(dropped: DataFrame) -> DataFrame:
    """(image_id, rel_path): image and label file of each dropped image in the labelled tree."""
    parts = F.split("image_id", "/")
    name = F.element_at(parts, -1)
    folder = F.when(F.size(parts) == 3, parts[1]).otherwise(before_last_underscore(name))
    both = F.array(F.concat_ws("/", parts[0], F.lit("images"), folder, name), F.concat_ws("/", parts[0], F.lit("labels"), folder, F.concat(stem(name), F.lit(".txt"))))
    return dropped.filter("image_id IS NOT NULL").select("image_id", F.explode(both).alias("rel_path"))


def detection_files(images: DataFrame, labels: DataFrame) -> DataFrame:
    """``images`` (corpus, name) that have a label (corpus, stem), with the split of their corpus."""
    table = F.create_map(*[F.lit(x) for kv in DETECTION_SPLITS.items() for x in kv])
    rows = images.withColumn("stem", stem(F.col("name"))).join(labels.select("corpus", "stem"), ["corpus", "stem"], "left_semi")
    return rows.withColumn("split", F.try_element_at(table, F.col("corpus"))).filter("split IS NOT NULL")
