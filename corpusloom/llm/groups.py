"""Problem 1: pairwise matches consolidated into groups.

Method: a two-dimensional grid. Vertices are hashed into B blocks and an edge lies in the cell of its
two blocks; a task runs union-find over one cell. A vertex then meets the representatives it got in
the cells of its row and column (2B - 1 at most, however many links it has), takes the smallest as
its parent, and the representatives that met are the edges of the next, much smaller, grid. That is
repeated until no two representatives meet (``operators.components.connected``). Here ids are brought to one spelling and numbered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.components import connected
from corpusloom.operators.skew import skew_join
from corpusloom.session import Scratch


def image_key(column: str | Column) -> Column:
    """An image id without what spelling may change: outer blanks, separators, leading folders, letter case."""
    c = F.col(column) if isinstance(column, str) else column
    c = F.regexp_replace(c, r"^\s+|\s+$", "")
    c = F.regexp_replace(c, r"[\\/]+", "/")
    return F.lower(F.regexp_replace(c, r"(?i)^(\./|/|data/raw/)+", ""))


def consolidate(pairs: DataFrame, known: DataFrame, scratch: Scratch, low: int = 0, high: int = 10) -> DataFrame:
    """(image_id, group_id) of each image of ``known`` with a link in ``pairs``.

    A row of ``pairs`` (id_a, id_b, hamming) is a link if its distance is ``low`` to ``high`` and its ids,
    however spelled, name two different images of ``known``. Null ids and distances, unknown ids and
    rows of a file with itself link nothing; rows may repeat in either order. ``known`` may repeat
    images and have null ids. Other columns of either table are not read. Ids equal but for spelling
    would count as one image, spelled the smallest way.
    """
    ends = pairs.filter(F.col("hamming").between(low, high)).select(image_key("id_a").alias("ka"), image_key("id_b").alias("kb"))
    ends = ends.filter("ka <> kb").select(F.least("ka", "kb").alias("ka"), F.greatest("ka", "kb").alias("kb")).distinct()
    ends = scratch.put(ends, "ends")
    named = ends.select(F.explode(F.array("ka", "kb")).alias("key")).distinct()
    images = known.select("image_id", image_key("image_id").alias("key")).groupBy("key").agg(F.min("image_id").alias("image_id"))
    images = images.join(named, "key", "left_semi")  # a row a key on either side
    # sorted by image_id, so that the smallest number of a group is its smallest id
    images = scratch.put(images.orderBy("image_id").withColumn("vid", F.monotonically_increasing_id()), "images")
    n = ends.count()
    edges = skew_join(ends, images.select(F.col("key").alias("ka"), F.col("vid").alias("u")), "ka", rows=n)
    edges = skew_join(edges, images.select(F.col("key").alias("kb"), F.col("vid").alias("v")), "kb", rows=n)
    labels = connected(edges.select("u", "v"), scratch)
    out = labels.join(images.select(F.col("vid").alias("v"), "image_id"), "v")
    roots = images.select(F.col("vid").alias("root"), F.col("image_id").alias("group_id"))
    return skew_join(out.select("image_id", "root"), roots, "root", rows=2 * n).select("image_id", "group_id")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every linked image with the smallest image id of its group."""
    return consolidate(spark.read.parquet(f"{sf}/phash_pairs.parquet"), spark.read.parquet(f"{sf}/master_manifest.parquet"), Scratch(spark, "p1"))


QUERIES = {"p1_found": p1_found}

_KEY = r"lower(regexp_replace(regexp_replace(regexp_replace({}, '^\s+|\s+$', '', 'g'), '[\\/]+', '/', 'g'), '^(\./|/|data/raw/)+', '', 'i'))"

ORACLES = {
    "p1_found": f"""
WITH RECURSIVE images AS (SELECT DISTINCT image_id, {_KEY.format("image_id")} AS k FROM master_manifest),
e AS (
  SELECT DISTINCT a.image_id AS x, b.image_id AS y
  FROM phash_pairs p JOIN images a ON a.k = {_KEY.format("p.id_a")} JOIN images b ON b.k = {_KEY.format("p.id_b")}
  WHERE p.hamming BETWEEN 0 AND 10 AND a.image_id <> b.image_id),
both_ways AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
reach AS (
  SELECT x AS image_id, x AS other FROM both_ways
  UNION
  SELECT r.image_id, w.y FROM reach r JOIN both_ways w ON w.x = r.other)
SELECT image_id, min(other) AS group_id FROM reach GROUP BY image_id"""
}
