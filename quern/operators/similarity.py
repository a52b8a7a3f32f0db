"""Vectors beside text: normalisation, similarity filters and fusion of two score sets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.errors import QueryError

LEAST_SIMILARITY = 0.8


def normalized(v: Column) -> Column:
    """Unit length in single precision; null for empty, zero or non-finite vectors."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when((F.size(v) > 0) & (norm > 0) & (norm < float("inf")), F.transform(v, lambda x: (x.cast("double") / norm).cast("float")))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, in index order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(query: list[float], size: int | None = None) -> list[float]:
    norm = math.sqrt(sum(x * x for x in query))
    if not query or not math.isfinite(norm) or norm == 0 or size is not None and len(query) != size:
        raise QueryError("invalid_vector", "empty, zero, non-finite or of another length")
    return [x / norm for x in query]


def similar(df: DataFrame, column: str, query: list[float], least: float = LEAST_SIMILARITY) -> DataFrame:
    """Rows with cosine similarity of ``least`` or more, as ``similarity``."""
    if column not in df.columns:
        raise QueryError("unknown_vector_field", column)
    q = F.array(*(F.lit(x).cast("float") for x in unit(query)))
    return df.withColumn("similarity", dot(normalized(F.col(column)), q)).where(F.col("similarity") >= least)


def fused(text: DataFrame, vector: DataFrame, pk: str, weight: float = 0.5) -> DataFrame:
    """pk and score: (1 - weight) * text + weight * vector, each side divided by its largest score."""
    if not 0 <= weight <= 1:
        raise QueryError("invalid_vector_weight", str(weight))

    def scaled(side: DataFrame, name: str) -> DataFrame:
        most = side.agg(F.max("score").alias("_m"))  # one row
        return side.crossJoin(F.broadcast(most)).select(pk, F.when(F.col("_m") > 0, F.col("score") / F.col("_m")).otherwise(0.0).alias(name))

    if weight in (0, 1):
        return (vector if weight else text).select(pk, "score")
    both = scaled(text, "t").join(scaled(vector, "v"), pk, "full")
    return both.select(pk, (F.lit(1 - weight) * F.coalesce("t", F.lit(0.0)) + F.lit(weight) * F.coalesce("v", F.lit(0.0))).alias("score"))
