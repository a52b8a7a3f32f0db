"""References to stored files, kept as JSON: key, size and mime, and optionally sha256, name, store and a map of metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.scalars import issues

SHA256 = r"^[0-9a-fA-F]{64}\z"


def file_reference(text: Column) -> Column:
    """The reference as a struct with ``metadata`` as a map of strings; null for what is no object. Values of other kinds are null."""
    v = F.try_parse_json(text)
    get = lambda name, kind="string": F.try_variant_get(v, f"$.{name}", kind).alias(name)
    out = F.struct(get("key"), get("size", "double"), get("mime"), get("sha256"), get("name"), get("store"), get("metadata", "map<string,string>"))
    return F.when(F.schema_of_variant(v).startswith("OBJECT<"), out)


def file_issues(text: Column, path: str) -> Column:
    """(path, message) of everything that a reference breaks; a null column is no reference and breaks nothing.

    ``key`` and ``mime`` must be non-empty text and ``size`` a number from 0; ``sha256`` 64 hex digits, ``name`` text,
    ``store`` non-empty text and ``metadata`` an object of texts, each only if present (a JSON null is present).
    """
    v = F.try_parse_json(text)
    part = lambda name: F.try_variant_get(v, f"$.{name}", "variant")
    shape = lambda name: F.coalesce(F.schema_of_variant(part(name)), F.lit("NONE"))
    full = lambda name: (shape(name) == "STRING") & (F.try_variant_get(v, f"$.{name}", "string") != "")
    absent = lambda name: part(name).isNull()
    is_object = F.coalesce(F.schema_of_variant(v), F.lit("NONE")).startswith("OBJECT<") | text.isNull()
    size = F.try_variant_get(v, "$.size", "double")
    sized = shape("size").rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*|TINYINT|SMALLINT|INT)\z") & (size >= 0) & (size < float("inf"))
    pairs = F.map_entries(F.try_variant_get(v, "$.metadata", "map<string,variant>"))
    plain = shape("metadata").startswith("OBJECT<") & F.coalesce(F.forall(pairs, lambda e: F.schema_of_variant(e["value"]) == "STRING"), F.lit(True))
    inner = lambda ok: text.isNull() | ~is_object | ok
    return issues(
        [
            (path, is_object, "not a file reference"),
            (f"{path}.key", inner(full("key")), "must be a non-empty text"),
            (f"{path}.size", inner(F.coalesce(sized, F.lit(False))), "must be a number from 0"),
            (f"{path}.mime", inner(full("mime")), "must be a non-empty text"),
            (f"{path}.sha256", inner(absent("sha256") | ((shape("sha256") == "STRING") & F.try_variant_get(v, "$.sha256", "string").rlike(SHA256))), "must be 64 hex digits"),
            (f"{path}.name", inner(absent("name") | (shape("name") == "STRING")), "must be a text"),
            (f"{path}.store", inner(absent("store") | full("store")), "must be a non-empty text"),
            (f"{path}.metadata", inner(absent("metadata") | plain), "must be an object of texts"),
        ]
    )
