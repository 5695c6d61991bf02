"""Readers of compressed array files, for moving existing results over; no pickled objects are loaded."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from corpusloom.plans.prototype import Prototypes
from corpusloom.schemas import EMBEDDING

#: Rows of a file that a worker hands over at once.
BATCH = 4096


def _read(spark: SparkSession, paths: list[str], names: tuple[str, ...], columns: list[str], schema) -> DataFrame:  # noqa: ANN001
    """The rows of the arrays ``names`` of each file, side by side; a task a file, which every worker sees. The driver reads nothing."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path in frame["path"]:
                with np.load(path, allow_pickle=False) as arrays:
                    parts = [arrays[n] for n in names]
                for at in range(0, len(parts[0]), BATCH):
                    yield pd.DataFrame({c: list(p[at : at + BATCH].tolist() if p.ndim == 1 else p[at : at + BATCH]) for c, p in zip(columns, parts)})

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths), "path")
    return files.mapInPandas(run, schema)


def embeddings(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, label, embedding) of files with the arrays embeddings, labels and paths."""
    return _read(spark, list(paths), ("paths", "labels", "embeddings"), ["path", "label", "embedding"], EMBEDDING)


def prototypes(spark: SparkSession, path: str) -> Prototypes:
    """The classes and the mean of a file with the arrays breeds, prototypes and global_mean."""
    classes = _read(spark, [path], ("breeds", "prototypes"), ["label", "prototype"], "label string, prototype array<double>")

    def mean(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in frame["path"]:
                with np.load(at, allow_pickle=False) as arrays:
                    yield pd.DataFrame({"global_mean": [arrays["global_mean"].astype(float)]})

    return Prototypes(classes, spark.createDataFrame([(path,)], "path string").mapInPandas(mean, "global_mean array<double>"), None)
