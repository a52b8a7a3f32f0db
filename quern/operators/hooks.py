"""User functions around operators: steps before and after, and embedders of text."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from quern.errors import QueryError

STEPS = ("list", "get", "create", "update", "delete", "sync")


class Hooks:
    """Functions from rows to rows that run before or after an operation, in the order in which they were added."""

    def __init__(self) -> None:
        self.known: dict[tuple[str, str], list[Callable[[DataFrame], DataFrame]]] = {}

    def add(self, when: str, step: str, fn: Callable[[DataFrame], DataFrame]) -> None:
        if when not in ("before", "after") or step not in STEPS:
            raise QueryError("invalid_hook", f"{when} {step}")
        self.known.setdefault((when, step), []).append(fn)

    def run(self, step: str, rows: DataFrame, operation: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``operation`` between its hooks; a hook that raises refuses it before anything is written."""
        for fn in self.known.get(("before", step), []):
            rows = fn(rows)
        rows = operation(rows)
        for fn in self.known.get(("after", step), []):
            rows = fn(rows)
        return rows


def embedded(df: DataFrame, text: str, embed: Callable[[list[str]], list[list[float]]], size: int, name: str = "embedding") -> DataFrame:
    """``df`` with the vectors that a batch function gives for its texts (null for null); one of another size or not finite is refused."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        given = texts.dropna()
        found = embed(given.tolist()) if len(given) else []
        for v in found:
            if len(v) != size or not all(abs(x) < float("inf") for x in v):
                raise QueryError("invalid_vector", f"not {size} finite components")
        return pd.Series(found, index=given.index, dtype=object).reindex(texts.index).map(lambda v: v if isinstance(v, list) else None)

    return df.withColumn(name, run(F.col(text)))
