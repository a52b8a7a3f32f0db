"""Counts of a matched set by value, range or flag."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.errors import QueryError
from quern.operators.where import refuse_marked


def _column(df: DataFrame, field: str):
    if field not in df.columns:
        raise QueryError("unknown_facet_field", field)
    refuse_marked(df.schema, field, "invalid_facet_field")
    kind = df.schema[field].dataType
    if isinstance(kind, T.StructType | T.MapType | T.BinaryType):
        raise QueryError("invalid_facet_field", field)
    if isinstance(kind, T.ArrayType):
        return F.explode(field)
    return F.when(~F.isnan(field), F.col(field)) if isinstance(kind, T.DoubleType | T.FloatType) else F.col(field)


def values(df: DataFrame, field: str, limit: int = 10, offset: int = 0, by: str = "desc") -> DataFrame:
    """value, count: by count, then value; every non-null array element counts."""
    found = df.select(_column(df, field).alias("value")).where("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("count"))
    ordered = found.orderBy(F.col("count").asc() if by == "asc" else F.col("count").desc(), "value")
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def ranges(df: DataFrame, field: str, bounds: list[tuple[float, float]]) -> DataFrame:
    """low, high, count of inclusive ranges that may overlap, in one pass; empty ranges count 0."""
    if not bounds:
        raise QueryError("invalid_facet_definition", field)
    rows = df.select(_column(df, field).alias("v"))
    counted = rows.agg(*(F.count_if(F.col("v").between(a, b)).alias(f"c{i}") for i, (a, b) in enumerate(bounds)))
    stack = F.array(*(F.struct(F.lit(float(a)).alias("low"), F.lit(float(b)).alias("high"), F.col(f"c{i}").alias("count")) for i, (a, b) in enumerate(bounds)))
    return counted.select(F.inline(stack))


def flags(df: DataFrame, field: str) -> DataFrame:
    """value, count for both truth values, always."""
    counted = df.select(_column(df, field).alias("v")).agg(F.count_if("v").alias("t"), F.count_if(~F.col("v")).alias("f"))
    stack = F.array(F.struct(F.lit(True).alias("value"), F.col("t").alias("count")), F.struct(F.lit(False).alias("value"), F.col("f").alias("count")))
    return counted.select(F.inline(stack))
