"""Duplicate groups and their keepers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.names import source_of
from corpusloom.operators.components import components
from corpusloom.operators.skew import skew_join
from corpusloom.session import Scratch

# Corpora in the order in which their files are kept; others come last, as 9.
KEEP_ORDER = ("oxford", "stanford", "tsinghua")
# Distance up to which a pair is an exact duplicate, and up to which it shares a group.
EXACT_DISTANCE, GROUP_DISTANCE = 5, 10


def priority(image_id: Column) -> Column:
    """The rank of an image's corpus among the keepers."""
    return F.coalesce(*[F.when(source_of(image_id) == s, F.lit(i)) for i, s in enumerate(KEEP_ORDER)], F.lit(9))


def md5_edges(manifest: DataFrame) -> DataFrame:
    """(a, b): each image of a usable row linked with the smallest of its md5; stars, so a group of n gives n - 1 edges."""
    rows = manifest.filter(F.col("usable") & F.col("md5").isNotNull() & F.col("image_id").isNotNull()).select("md5", "image_id")
    least = rows.groupBy("md5").agg(F.min("image_id").alias("a"), F.max("image_id").alias("z")).filter("a <> z").select("md5", "a")
    return skew_join(rows, least, "md5").select("a", F.col("image_id").alias("b")).filter("a <> b").distinct()


def pair_edges(pairs: DataFrame, distance: int) -> DataFrame:
    """(a, b) of ``pairs`` (id_a, id_b, hamming) up to a distance."""
    return pairs.filter(F.col("hamming") <= distance).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))


def exact_groups(manifest: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """(image_id, component) of images that are exact duplicates of others, by md5 or distance."""
    edges = md5_edges(manifest).unionByName(pair_edges(pairs, EXACT_DISTANCE))
    return components(edges, scratch).select(F.col("id").alias("image_id"), "component")


def keepers(groups: DataFrame) -> DataFrame:
    """(image_id, dup_keep_id) of every member of ``groups`` (image_id, component) but the keeper: best corpus, then smallest id."""
    ranked = groups.withColumn("__order", F.struct(priority(F.col("image_id")).alias("p"), F.col("image_id").alias("id")))
    best = ranked.groupBy("component").agg(F.min("__order")["id"].alias("dup_keep_id"))
    return skew_join(groups, best, "component").filter("image_id <> dup_keep_id").select("image_id", "dup_keep_id")


def group_ids(manifest: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """(image_id, group_id) of every image of ``manifest``: the smallest id linked with it by pairs up to GROUP_DISTANCE, dropped images bridging; else its own."""
    linked = components(pair_edges(pairs, GROUP_DISTANCE), scratch).select(F.col("id").alias("image_id"), "component")
    images = manifest.select("image_id").distinct()
    return images.join(linked, "image_id", "left").select("image_id", F.coalesce("component", "image_id").alias("group_id"))
