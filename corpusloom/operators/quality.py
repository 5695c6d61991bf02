"""Validation and status of manifest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.geometry import box_fault
from corpusloom.operators.skew import skew_join


def first_reason(error: Column, body: Column, head: Column, width: Column, height: Column) -> Column:
    """Why a row is not usable: a corrupt image, then no body box (null or empty), then a bad body box, then a bad head box; else null."""
    return F.coalesce(error, F.when(body.isNull() | (F.size(body) == 0), "missing_annotation"), box_fault(body, width, height), box_fault(head, width, height))


def hash_targets(manifest: DataFrame) -> DataFrame:
    """Rows whose image is hashed: the usable ones, and cats kept for rejection tests."""
    return manifest.filter(F.col("usable") | (F.col("exclusion_reason") == "cat_ood_only"))


def listed_rows(manifest: DataFrame) -> DataFrame:
    """Rows of the frozen set that have a split."""
    return manifest.filter(F.col("in_mvp25") & F.col("split").isNotNull())


def mark_dropped(manifest: DataFrame, keepers: DataFrame) -> DataFrame:
    """``manifest`` with the rows of ``keepers`` (image_id, dup_keep_id) dropped.

    Reasons that are there already stay; other dropped rows become exact_duplicate. All dropped rows are unusable
    and name their keeper; a row that is not dropped names none.
    """
    keep = keepers.select("image_id", F.col("dup_keep_id").alias("__keep"))
    joined = skew_join(manifest.drop("dup_keep_id"), keep, "image_id", "left")
    dropped = F.col("__keep").isNotNull()
    return joined.withColumns(
        {
            "exclusion_reason": F.when(dropped & F.col("usable"), "exact_duplicate").otherwise(F.col("exclusion_reason")),
            "usable": F.col("usable") & ~dropped,
            "dup_keep_id": F.col("__keep"),
        }
    ).drop("__keep")
