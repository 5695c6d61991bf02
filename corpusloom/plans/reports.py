"""Inventories and summaries of the manifest, pairs and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.names import CAT_LABEL, source_of


def inventory(manifest: DataFrame) -> DataFrame:
    """Per source: images, different breeds, rows with either box, usable rows. Empty boxes count as boxes; a null source is left out."""
    return (
        manifest.filter("source IS NOT NULL")
        .groupBy("source")
        .agg(
            F.count("image_id").alias("images"),
            F.count_distinct("original_breed").alias("breeds"),
            F.count("body_bbox").alias("with_body_bbox"),
            F.count("head_bbox").alias("with_head_bbox"),
            F.sum(F.col("usable").cast("int")).alias("usable"),
        )
    )


def exclusions(manifest: DataFrame) -> DataFrame:
    """Unusable rows per source and reason; rows without either are left out."""
    return manifest.filter("NOT usable AND source IS NOT NULL AND exclusion_reason IS NOT NULL").groupBy("source", "exclusion_reason").agg(F.count(F.lit(1)).alias("n"))


def top_breeds(manifest: DataFrame, n: int = 40) -> DataFrame:
    """The ``n`` largest groups of usable rows by source and breed; equals in order of the keys."""
    rows = manifest.filter("usable AND source IS NOT NULL AND original_breed IS NOT NULL").groupBy("source", "original_breed").agg(F.count(F.lit(1)).alias("n"))
    return rows.orderBy(F.desc("n"), "source", "original_breed").limit(n)


def split_table(manifest: DataFrame) -> DataFrame:
    """Per breed of the frozen set: rows in test, train and val, their total, and train's share in per cent to one digit."""
    rows = manifest.filter(F.col("in_mvp25") & F.col("canonical_breed").isNotNull() & F.col("split").isNotNull())
    wide = rows.groupBy("canonical_breed").pivot("split", ["test", "train", "val"]).agg(F.count(F.lit(1))).na.fill(0)
    total = F.col("test") + F.col("train") + F.col("val")
    return wide.withColumn("total", total).filter("total > 0").withColumn("train_pct", F.bround(F.col("train") / F.col("total") * 100, 1))


def pair_summary(pairs: DataFrame) -> DataFrame:
    """Pairs up to distance 10: all, up to 5, 6 to 8, 9 to 10, and those across corpora."""
    count = lambda c: F.count(F.when(c, True))
    h = F.col("hamming")
    return pairs.filter(h.between(0, 10)).agg(
        F.count(F.lit(1)).alias("total"), count(h <= 5).alias("sure"), count(h.between(6, 8)).alias("likely"), count(h.between(9, 10)).alias("doubtful"), count(F.col("cross_dataset")).alias("crossing")
    )


def crossing_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs across corpora by both corpora."""
    return pairs.filter("cross_dataset").groupBy("src_a", "src_b").agg(F.count(F.lit(1)).alias("n"))


def with_sources(pairs: DataFrame) -> DataFrame:
    """``pairs`` with the corpora its ids begin with, and whether they differ."""
    out = pairs.withColumn("src_a", source_of(F.col("id_a"))).withColumn("src_b", source_of(F.col("id_b")))
    return out.withColumn("cross_dataset", F.col("src_a") != F.col("src_b"))


def markdown(rows: DataFrame, limit: int = 1000) -> str:
    """A small table as Markdown, ``limit`` rows at most."""
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows.limit(limit).collect()])


def inventory_report(manifest: DataFrame) -> str:
    """What the corpora hold, why rows are excluded, and the largest breeds."""
    parts = ["# Inventory", markdown(inventory(manifest).orderBy("source")), "## Exclusions", markdown(exclusions(manifest).orderBy("source", "exclusion_reason")), "## Largest breeds", markdown(top_breeds(manifest))]
    return "\n\n".join(parts) + "\n"


def dedup_report(groups: DataFrame, dropped: DataFrame, removed: int | None = None) -> str:
    """How many groups of duplicates (image_id, component) there are, what was dropped (image_id, dup_keep_id), by corpus, and how many files were removed."""
    by_source = dropped.groupBy(source_of(F.col("image_id")).alias("source")).agg(F.count(F.lit(1)).alias("dropped")).orderBy(F.desc("dropped"), "source")
    counts = [f"groups: {groups.select('component').distinct().count()}", f"dropped images: {dropped.count()}"] + ([] if removed is None else [f"removed files: {removed}"])
    return "\n\n".join(["# Duplicates", "\n".join(f"- {c}" for c in counts), "## Dropped by source", markdown(by_source)]) + "\n"


def split_report(manifest: DataFrame) -> str:
    """The rows of the frozen set by breed and split, and the cats."""
    listed = manifest.agg(F.count(F.when(F.col("in_mvp25"), True)).alias("listed"), F.count(F.when(F.col("canonical_breed") == CAT_LABEL, True)).alias("cats")).first()
    return "\n\n".join(["# Splits", f"- images: {listed['listed']}\n- cats: {listed['cats']}", markdown(split_table(manifest).orderBy("canonical_breed"))]) + "\n"
