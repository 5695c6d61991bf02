"""corpusloom: Spark-first curation and embedding analytics for labelled media collections.

Sub-packages
------------
functions   column expressions (vectors, geometry, text), all evaluated in the JVM
operators   DataFrame -> DataFrame building blocks (validation, dedup, joins, splits, skew handling)
plans       whole queries composed of operators (prototypes, scoring, evaluation, curation)
sources     readers and writers for the file layouts the engine understands
streaming   stateless and windowed Structured Streaming variants
"""

__version__ = "0.1.0"
