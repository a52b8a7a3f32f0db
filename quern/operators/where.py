"""The filter language: nested conditions over declared columns, compiled to one Column.

``{"price": {"gte": 10}, "or": [{"status": ["F", "O"]}, {"not": {"tags": {"contains_all": ["x"]}}}]}``:
siblings are joined by and. A bare value means eq, a bare list means in, a bare null matches nothing.
Empty ``and``, ``or`` and ``in`` match nothing; ``not_in`` needs a value; ``not`` also passes rows
that lack the field. NaN is absent: it matches nothing but ``not``. Predicates stay bare where a null filters a row out anyway, so that they reach
the Parquet scan; only under an odd number of ``not`` is a null made false.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.errors import QueryError
from quern.functions import geo
from quern.functions.scalars import all_of, any_of

DEEPEST = 10
ORDERED = {"gt": "__gt__", "gte": "__ge__", "lt": "__lt__", "lte": "__le__"}
ON_SCALARS = {"eq", "in", "not_in", "between", *ORDERED}
ON_ARRAYS = ON_SCALARS | {"contains_any", "contains_all"}


def _field(schema: T.StructType, path: str) -> T.DataType:
    if path in schema.names:
        return schema[path].dataType
    kind: T.DataType = schema
    for name in path.split("."):
        if not isinstance(kind, T.StructType) or name not in kind.names:
            raise QueryError("unknown_filter_field", path)
        kind = kind[name].dataType
    return kind


def marked(df: DataFrame, column: str, **marks) -> DataFrame:
    """``df`` with marks in a column's metadata: ``vector`` (its dimension) or ``carried`` (kept beside the rows, not to be queried)."""
    return df.withMetadata(column, df.schema[column].metadata | marks)


def refuse_marked(schema: T.StructType, path: str, code: str) -> None:
    """Carried fields may not be queried at all; vectors have no order, no equality and no facets."""
    marks = schema[name].metadata if (name := path.split(".")[0]) in schema.names else {}
    if marks.get("carried"):
        raise QueryError("carried_field_not_queryable", path)
    if marks.get("vector"):
        raise QueryError(code, f"{path} is a vector")


def _fits(kind: T.DataType, value) -> bool:
    if isinstance(kind, T.StringType):
        return isinstance(value, str)
    if isinstance(kind, T.BooleanType):
        return isinstance(value, bool)
    if isinstance(kind, T.NumericType):
        return isinstance(value, int | float) and not isinstance(value, bool)
    return True


def _is_point(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType) and {"lat", "lon"} <= set(kind.names)


def _geo(c: Column, op: str, spec) -> Column:
    lat, lon = c["lat"], c["lon"]
    if not isinstance(spec, dict):
        raise QueryError("invalid_geo_filter", op)
    if op == "radius":
        hit = geo.within(lat, lon, *spec["center"], spec["value"], spec.get("unit", "m"))
    elif op == "polygon":
        hit = geo.in_polygon(lat, lon, spec["points"])
    else:
        raise QueryError("invalid_filter_operation", op)
    return hit if spec.get("inside", True) else lat.isNotNull() & lon.isNotNull() & ~hit


def _leaf(path: str, kind: T.DataType, op: str, value) -> Column:
    c = F.col(path)
    if _is_point(kind):
        return _geo(c, op, value)
    array = isinstance(kind, T.ArrayType)
    if op not in (ON_ARRAYS if array else ON_SCALARS):
        raise QueryError("invalid_filter_operation", f"{op} on {path}")
    listed = op in ("in", "not_in", "contains_any", "contains_all", "between")
    if listed and not isinstance(value, list | tuple) or op == "between" and len(value) != 2:
        raise QueryError("invalid_filter_operation", f"{op} needs a list")
    element = kind.elementType if array else kind
    for v in value if listed else [value]:
        if v is not None and not _fits(element, v):
            raise QueryError("invalid_filter_operation", f"{op} on {path} with {v!r}")
    if not listed and value is None:
        return F.lit(False)

    def each(test) -> Column:
        return F.exists(c, lambda x: F.coalesce(test(x), F.lit(False))) if array else test(c)

    known = [v for v in value if v is not None] if listed else value
    # NaN is greater than any number for Spark; the bare comparison still reaches the scan.
    number = (lambda x: ~F.isnan(x)) if isinstance(element, T.DoubleType | T.FloatType) else None
    if op == "eq":
        return each(lambda x: x == known)
    if op in ("in", "contains_any"):
        return each(lambda x: x.isin(*known)) if known else F.lit(False)
    if op == "not_in":
        there = c.isNotNull() & number(c) if number and not array else c.isNotNull()
        return there & ~each(lambda x: x.isin(*known)) if known else there
    if op == "contains_all":
        return all_of([each(lambda x, v=v: x == v) for v in known]) if known else c.isNotNull()
    if op == "between":
        return each(lambda x: x.between(*value))
    if number and op in ("gt", "gte"):
        return each(lambda x: getattr(x, ORDERED[op])(known) & number(x))
    return each(lambda x: getattr(x, ORDERED[op])(known))


def compiled(where: dict, schema: T.StructType, negated: bool = False, depth: int = 0) -> Column:
    """One boolean Column; null means no match unless ``negated``, where it cannot occur."""
    if depth > DEEPEST:
        raise QueryError("invalid_filter_operation", "nested too deeply")
    parts: list[Column] = []
    for key in sorted(where):
        value = where[key]
        if key in ("and", "or"):
            inner = [compiled(w, schema, negated, depth + 1) for w in value]
            parts.append(all_of(inner) if key == "and" else any_of(inner))
        elif key == "not":
            inner = compiled(value, schema, not negated, depth + 1)
            parts.append(~F.coalesce(inner, F.lit(False)))
        else:
            kind = _field(schema, key)
            refuse_marked(schema, key, "invalid_filter_operation")
            spec = value if isinstance(value, dict) else {"in": list(value)} if isinstance(value, list | tuple) else {"eq": value}
            for op in sorted(spec):
                leaf = _leaf(key, kind, op, spec[op])
                parts.append(F.coalesce(leaf, F.lit(False)) if negated else leaf)
    return all_of(parts) if parts else F.lit(True)


def where(df: DataFrame, condition: dict) -> DataFrame:
    """Rows that match."""
    return df.where(compiled(condition, df.schema))
