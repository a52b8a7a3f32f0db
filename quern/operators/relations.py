"""References between tables: expansion, derived fields, cascades and enforcement."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def expand(df: DataFrame, key: str, other: DataFrame, other_key: str, name: str) -> DataFrame:
    """The referenced row as a struct column; null where the reference leads nowhere."""
    packed = other.select(F.col(other_key).alias("_ref"), F.struct(*other.columns).alias(name))
    return df.join(packed, df[key] == F.col("_ref"), "left").drop("_ref")


def derived(df: DataFrame, key: str, other: DataFrame, other_key: str, **columns: Column) -> DataFrame:
    """New columns from a row and the row it refers to (``other``'s columns are in reach)."""
    joined = df.join(other, df[key] == other[other_key], "left")
    return joined.select(*(df[c] for c in df.columns), *(c.alias(n) for n, c in columns.items()))


def dependents(df: DataFrame, key: str, before: DataFrame, after: DataFrame, other_key: str, value: str) -> DataFrame:
    """Rows of ``df`` whose referenced ``value`` changed, with the old and the new one."""
    old = before.select(F.col(other_key).alias("_k"), F.col(value).alias("old_value"))
    new = after.select(F.col(other_key).alias("_n"), F.col(value).alias("new_value"))
    changed = old.join(new, F.col("_k") == F.col("_n"), "full").where(~F.col("old_value").eqNullSafe(F.col("new_value")))
    changed = changed.select(F.coalesce("_k", "_n").alias("_ref"), "old_value", "new_value")
    return df.join(changed, df[key] == F.col("_ref")).drop("_ref")


def enforce(df: DataFrame, key: str, deleted: DataFrame, deleted_key: str, action: str, default=None) -> DataFrame:
    """``df`` after rows it refers to went: ``cascade`` drops, ``set_null`` clears, ``set_default`` puts ``default``; ``restrict`` and ``no_action`` give the offenders."""
    gone = deleted.select(F.col(deleted_key).alias("_ref")).distinct()
    if action == "cascade":
        return df.join(gone, df[key] == F.col("_ref"), "left_anti")
    if action in ("restrict", "no_action"):
        return df.join(gone, df[key] == F.col("_ref"), "left_semi")
    hit = df.join(gone, df[key] == F.col("_ref"), "left")
    instead = F.lit(default if action == "set_default" else None)
    return hit.withColumn(key, F.when(F.col("_ref").isNull(), F.col(key)).otherwise(instead)).drop("_ref")


def own_derived(df: DataFrame, **columns: tuple[Callable, str, list[str]]) -> DataFrame:
    """New columns from functions of a row's own fields: (function, type, names of its arguments). A value that fails is absent (null).

    A failure is any exception, and a value that does not fit the type. What Columns can say should be said with Columns and
    ``try_`` functions; this is for Python functions, over Arrow batches.
    """
    out = {}
    for name, (f, kind, given) in columns.items():
        out[name] = F.arrow_udf(_or_absent(f, to_arrow_type(T._parse_datatype_string(kind))), kind)(*map(F.col, given))
    return df.withColumns(out)


def _or_absent(f: Callable, kind: pa.DataType) -> Callable:
    def one(row: tuple):
        try:
            return pa.scalar(f(*row), kind).as_py()
        except Exception:  # a derived value that fails is absent, whatever failed
            return None

    def each(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            columns = batch if isinstance(batch, tuple) else (batch,)
            yield pa.array([one(row) for row in zip(*(c.to_pylist() for c in columns))], kind)

    return each
