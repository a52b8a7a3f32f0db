"""Sort keys between two others, so that a row can be put anywhere without renumbering its neighbours."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quern.errors import QueryError

DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def between(before: str | None, after: str | None) -> str:
    """The key halfway between two keys, read as fractions in base 62 (None: the lowest, the highest end)."""
    low, high = before or "", after
    for key in (low, high or ""):
        if key.strip(DIGITS) or key.endswith(DIGITS[0]):
            raise QueryError("invalid_sort_key", key)
    if high is not None and low >= high:
        raise QueryError("invalid_sort_key_range", f"{low} does not sort before {high}")
    size = max(len(low), len(high or "")) + 1
    value = lambda k: sum(DIGITS.index(c) * 62 ** (size - 1 - i) for i, c in enumerate(k))
    middle = (value(low) + (62**size if high is None else value(high))) // 2
    out = ""
    for _ in range(size):
        middle, d = divmod(middle, 62)
        out = DIGITS[d] + out
    return out.rstrip(DIGITS[0])


@F.pandas_udf(StringType())
def key_between(before: pd.Series, after: pd.Series) -> pd.Series:
    """``between`` for two columns, nulls being the ends."""
    return pd.Series([between(a, b) for a, b in zip(before, after, strict=True)])
