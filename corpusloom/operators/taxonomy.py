"""Labels brought to canonical breeds, and the frozen taxonomy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.names import CAT_PREFIX, DROP, breed_number, canonical


def with_taxonomy(manifest: DataFrame) -> DataFrame:
    """``manifest`` with canonical_breed, breed_id and in_mvp25, whatever it had before. A null label has none."""
    name = canonical(F.col("original_breed"))
    out = manifest.withColumn("canonical_breed", name).withColumn("breed_id", breed_number(F.col("canonical_breed")))
    return out.withColumn("in_mvp25", F.coalesce(F.col("breed_id").isNotNull() & F.col("usable"), F.lit(False)))


def taxonomy(manifest: DataFrame) -> DataFrame:
    """(source, original_label, canonical_label, breed_id, action, n_images): every label but cats', usable rows or not."""
    rows = manifest.filter(~F.col("original_breed").startswith(CAT_PREFIX)).groupBy("source", F.col("original_breed").alias("original_label")).agg(F.count(F.lit(1)).alias("n_images"))
    named = rows.withColumn("canonical_label", canonical(F.col("original_label")))
    number = breed_number(F.col("canonical_label"))
    action = F.when(F.col("canonical_label") == DROP, "drop").when(number.isNull(), "not_mvp").otherwise("mvp25")
    return named.select("source", "original_label", "canonical_label", number.alias("breed_id"), action.alias("action"), "n_images")
