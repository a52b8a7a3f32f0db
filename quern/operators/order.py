"""Ordering, pages, distinct rows and cursors. Nulls stand last in either direction; the key breaks ties."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.errors import QueryError
from quern.operators.where import refuse_marked, where

MOST_ROWS, MOST_SPARSE, MOST_OFFSET = 100, 5000, 100_000


def keys(df: DataFrame, order: list[tuple[str, str]], pk: str) -> list[Column]:
    """Sort keys of ``[(field, "asc" or "desc"), ...]`` and the primary key."""
    out = []
    for name, way in order:
        if name not in df.columns:
            raise QueryError("unknown_order_field", name)
        refuse_marked(df.schema, name, "unknown_order_field")
        c = _number(df, name)
        out.append(c.asc_nulls_last() if way == "asc" else c.desc_nulls_last())
    return [*out, F.col(pk).asc_nulls_last()]


def _number(df: DataFrame, name: str) -> Column:
    """A column whose NaN is null."""
    return F.when(~F.isnan(name), F.col(name)) if dict(df.dtypes)[name] in ("double", "float") else F.col(name)


def clamped(limit: int | None, offset: int | None, sparse: bool = True) -> tuple[int, int]:
    most, usual = (MOST_SPARSE, 100) if sparse else (MOST_ROWS, 10)
    return min(max(usual if limit is None else limit, 1), most), min(max(offset or 0, 0), MOST_OFFSET)


def page(df: DataFrame, order: list[tuple[str, str]], pk: str, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """One page: a top-k per task, never a global sort."""
    limit, offset = clamped(limit, offset)
    out = df.orderBy(*keys(df, order, pk))
    return (out.offset(offset) if offset else out).limit(limit)


def first_of(df: DataFrame, field: str, order: list[tuple[str, str]], pk: str) -> DataFrame:
    """The first row of every value of ``field`` in the order given; nulls are one value."""
    if field not in df.columns:
        raise QueryError("unknown_distinct_field", field)
    rank = F.row_number().over(Window.partitionBy(_number(df, field)).orderBy(*keys(df, order, pk)))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def cursor(field: str, way: str, value, key) -> str:
    raw = json.dumps([field, way, value, key], separators=(",", ":")).encode()
    return base64.urlsafe_b64encode(raw).decode().rstrip("=")


def after(df: DataFrame, pk: str, token: str, condition: dict | None = None) -> DataFrame:
    """Rows behind a cursor's (value, key), of those that the caller's filter lets through; ties on the value are not lost."""
    if condition:
        df = where(df, condition)
    field, way, value, key = json.loads(base64.urlsafe_b64decode(token + "=" * (-len(token) % 4)))
    if field not in df.columns:
        raise QueryError("unknown_order_field", field)
    c = _number(df, field)
    if value is None:
        return df.where(c.isNull() & (F.col(pk) > key))
    return df.where((c > value if way == "asc" else c < value) | c.isNull() | (c == value) & (F.col(pk) > key))


def behind(df: DataFrame, order: list[tuple[str, str]], pk: str, row: dict) -> DataFrame:
    """Rows that stand behind ``row`` in an order of several fields: a condition on the columns alone, which reaches the scan."""
    beyond, same = F.lit(False), F.lit(True)
    for name, way in [*order, (pk, "asc")]:
        c, value = _number(df, name), row[name]
        if value is not None:  # behind a null stands nothing
            beyond |= same & ((c > value if way == "asc" else c < value) | c.isNull())
        same &= c.isNull() if value is None else c == value
    return df.where(beyond)
