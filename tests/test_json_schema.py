"""JSON input schemas: issues by path, defaults, schemas that are refused."""

import json

import pytest

from quern.errors import QueryError
from quern.functions.json_schema import issues, with_defaults

SCHEMA = {
    "name": {"type": "string", "min_length": 2, "max_length": 4}, "n": {"type": "integer", "minimum": 1, "enum": [1, 2, 3, 9], "optional": True}, "on": {"type": "boolean", "optional": True, "default": True},
    "edits": {"type": "array", "max_items": 2, "optional": True, "items": {"type": "object", "properties": {"find": {"type": "string"}, "to": {"type": "number", "optional": True, "maximum": 5}}}},
    "free": {"type": "object", "optional": True, "additional": True, "properties": {"a b": {"type": "integer"}}, "default": {"a b": 7}},
}
CASES = {
    '{"name": "abc"}': [],
    '{"name": "a", "n": 0}': [("name", "min_length"), ("n", "enum"), ("n", "minimum")],
    '{"name": "😀😀😀"}': [("name", "max_length")],
    '{"name": 5, "n": "x", "on": 1}': [("name", "type"), ("n", "type"), ("on", "type")],
    '{"n": 1.5, "name": null}': [("name", "required"), ("n", "integer"), ("n", "enum")],
    '{"name": "abc", "edits": [{"find": "x"}, {"to": 9}, 3, {"find": "y", "zz": 1}]}': [("edits", "max_items"), ("edits.1.find", "required"), ("edits.1.to", "maximum"), ("edits.2", "type"), ("edits.3.zz", "unknown")],
    '{"name": "abc", "edits": {}}': [("edits", "type")],
    '{"name": "abc", "free": {"a b": 1, "more": [1]}, "toString": 1}': [("toString", "unknown")],
    '{"name": "abc", "free": {}}': [("free.a b", "required")],
    "[1]": [("", "type")],
    "{": [("", "invalid_json")],
    None: [("name", "required")],
}


def test_issues(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(CASES)], "i int, t string")
    got = {r["i"]: [(x["path"], x["code"]) for x in r["x"]] for r in df.select("i", issues(df["t"], SCHEMA).alias("x")).collect()}
    assert got == dict(enumerate(CASES.values()))
    assert df.select(issues(df["t"], SCHEMA, additional=True).alias("x")).where("exists(x, y -> y.path = 'toString')").isEmpty()


def test_defaults(spark):
    df = spark.createDataFrame([('{"name": "abc", "on": null}',), ('{"name": "abc", "on": false, "free": {"a b": 1}}',), ("[1]",), ("{",)], "t string")
    got = [r["t"] for r in df.select(with_defaults(df["t"], SCHEMA).alias("t")).collect()]
    assert [json.loads(t) for t in got[:3]] == [{"name": "abc", "on": True, "free": {"a b": 7}}, {"name": "abc", "on": False, "free": {"a b": 1}}, [1]] and got[3] == "{"


@pytest.mark.parametrize("bad", [{"x": {"type": "date"}}, {"x": {}}, {"x": {"type": "string", "minimum": 1}}, {"x": {"type": "array"}}, {"x": {"type": "object", "properties": {"y": 1}}}])
def test_refused_schemas(bad):
    with pytest.raises(QueryError, match="invalid_schema"):
        issues("t", bad)
