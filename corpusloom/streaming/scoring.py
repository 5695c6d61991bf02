"""Streaming variants: stateless scoring of arriving embeddings, and windowed counts of the outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.plans.scoring import TEMPERATURE, THRESHOLD, TOP_K, Scorer, predict

#: Columns of an arriving embedding.
ARRIVING = T.StructType([T.StructField("key", T.StringType()), T.StructField("arrived_at", T.TimestampType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])


def arriving(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """A stream of the Parquet files that come into ``folder``."""
    return spark.readStream.schema(ARRIVING).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def predictions(stream: DataFrame, scorer: Scorer, threshold: float = THRESHOLD, top_k: int = TOP_K, temperature: float = TEMPERATURE) -> DataFrame:
    """The predictions of a stream: row-local, so without state."""
    return predict(stream, scorer, threshold, top_k, temperature).drop("embedding")


def outcome_counts(predicted: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Predictions per window and best label ('unknown' if rejected); rows later than ``late`` are dropped."""
    label = F.when(F.col("unknown"), "unknown").otherwise(F.col("topk")[0]["label"])
    return (
        predicted.withWatermark("arrived_at", late)
        .groupBy(F.window("arrived_at", width).alias("window"), label.alias("label"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg("max_sim").alias("mean_sim"))
    )
