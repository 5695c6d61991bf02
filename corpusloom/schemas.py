"""Declared schemas of the tables that pass between stages; stages write new tables and never overwrite their input."""

from __future__ import annotations

from pyspark.sql import types as T

BOX = T.ArrayType(T.DoubleType())

MANIFEST = T.StructType(
    [
        T.StructField("image_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("image_path", T.StringType()),
        T.StructField("original_breed", T.StringType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("body_bbox", BOX),
        T.StructField("head_bbox", BOX),
        T.StructField("n_dogs", T.IntegerType()),
        T.StructField("usable", T.BooleanType()),
        T.StructField("exclusion_reason", T.StringType()),
        T.StructField("md5", T.StringType()),
    ]
)

DETECTION = T.StructType([T.StructField("bbox", T.StructType([T.StructField(c, T.DoubleType()) for c in ("x1", "y1", "x2", "y2")])), T.StructField("conf", T.DoubleType())])

EMBEDDING = T.StructType([T.StructField("path", T.StringType()), T.StructField("label", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])

PREDICTION = T.StructType(
    [
        T.StructField("unknown", T.BooleanType()),
        T.StructField("max_sim", T.DoubleType()),
        T.StructField("topk", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("pct", T.DoubleType())]))),
    ]
)
