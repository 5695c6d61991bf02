"""Detected boxes: filtering, the best per image, pseudo boxes, annotation filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The class looked for, confidence for inference and for pseudo boxes, and below which a box needs review.
DOG_CLASS, CONFIDENCE, PSEUDO_CONFIDENCE, REVIEW_BELOW = 16, 0.25, 0.1, 0.5


def wanted(detections: DataFrame, confidence: float = CONFIDENCE) -> DataFrame:
    """Rows of the class looked for with at least this confidence; null class or confidence is not wanted."""
    return detections.filter((F.col("class_id") == DOG_CLASS) & (F.col("conf") >= confidence))


def by_confidence(detections: DataFrame) -> DataFrame:
    """(image_id, detections): structs (conf, idx, bbox) per image, most confident first, equals in order of idx."""
    entry = F.struct((-F.col("conf")).alias("k"), "idx", "conf", "bbox")
    rows = F.sort_array(F.collect_list(entry))
    return detections.groupBy("image_id").agg(F.transform(rows, lambda d: F.struct(d["conf"].alias("conf"), d["idx"].alias("idx"), d["bbox"].alias("bbox"))).alias("detections"))


def best(detections: DataFrame) -> DataFrame:
    """(image_id, conf, bbox, n_det) of each image: its most confident box, the smallest idx of equals. No sort, no collected lists."""
    first = F.min(F.struct((-F.col("conf")).alias("k"), "idx", "bbox"))
    return detections.groupBy("image_id").agg(first.alias("b"), F.count(F.lit(1)).alias("n_det")).select("image_id", (-F.col("b.k")).alias("conf"), F.col("b.bbox").alias("bbox"), "n_det")


def pseudo_boxes(images: DataFrame, detections: DataFrame) -> DataFrame:
    """(image_id, pseudo_body_bbox, conf, n_det, needs_review) of every image: the best box, one decimal; no detection gives a null box and 0."""
    found = best(wanted(detections, PSEUDO_CONFIDENCE))
    rows = images.select("image_id").distinct().join(found, "image_id", "left")
    conf = F.coalesce("conf", F.lit(0.0))
    box = F.transform("bbox", lambda x: F.bround(x, 1))
    return rows.select("image_id", box.alias("pseudo_body_bbox"), conf.alias("conf"), F.coalesce("n_det", F.lit(0)).cast("int").alias("n_det"), (conf < REVIEW_BELOW).alias("needs_review"))


def pseudo_summary(pseudo: DataFrame) -> DataFrame:
    """Counts over pseudo boxes, and the mean confidence to three digits."""
    count = lambda c: F.count(F.when(c, True))
    return pseudo.agg(
        F.count(F.lit(1)).alias("total"),
        count(F.col("n_det") > 0).alias("detected"),
        count(F.col("n_det") == 0).alias("no_detection"),
        count(F.col("needs_review")).alias("needs_review"),
        count(F.col("n_det") > 1).alias("multi"),
        F.round(F.avg("conf"), 3).alias("mean_conf"),
    )


def accepted(pseudo: DataFrame) -> DataFrame:
    """Pseudo boxes that need no review."""
    return pseudo.filter(~F.col("needs_review") & F.col("pseudo_body_bbox").isNotNull())


def _truthy(c: Column) -> Column:
    return F.coalesce(c.cast("boolean"), F.lit(False))


def plain_annotations(annotations: DataFrame) -> DataFrame:
    """Annotations that are neither a group nor a depiction; a missing flag is false."""
    return annotations.filter(~_truthy(F.col("IsGroupOf")) & ~_truthy(F.col("IsDepiction")))


def strict_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join that fails, naming one, if a key of ``left`` is not in ``right``."""
    lost = left.join(right, key, "left_anti").select(key).limit(1).collect()
    if lost:
        raise KeyError(f"no row for {key} = {lost[0][0]}")
    return left.join(right, key)
