"""Vector functions over array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for a zero vector, null for vectors of different length."""
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(F.size(a) != F.size(b), F.lit(None).cast("double")).when(norm == 0, 0.0).otherwise(_dot(a, b) / norm)


def mean_pool(vectors: DataFrame, keys: list[str], vector_col: str = "embedding") -> DataFrame:
    """Element-wise mean by key; sums are combined before the shuffle."""
    parts = vectors.select(*keys, F.posexplode(vector_col).alias("_at", "_value")).groupBy(*keys, "_at").agg(F.avg(F.col("_value").cast("double")).alias("_value"))
    return parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_value"))), lambda x: x["_value"]).alias(vector_col))
