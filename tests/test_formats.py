"""Values as text, references to files, fields from a row's own fields, ids minted and rows checked at creation."""

import datetime

import pytest
from pyspark.sql import functions as F

from quern.errors import QueryError
from quern.functions import files, formats, scalars
from quern.operators import relations, writes

DAY = 86_400_000


def _one(spark, rows, ddl, column):
    return [r[0] for r in spark.createDataFrame(rows, ddl).select(column).collect()]


def test_numbers_and_money(spark):
    values = [(0.0,), (None,), (1234.5,), (-0.005,), (1234567.125,), (-12.5,)]
    assert _one(spark, values, "v double", formats.number(F.col("v"))) == ["0", "0", "1,234.5", "-0.01", "1,234,567.13", "-12.5"]
    assert _one(spark, values, "v double", formats.currency(F.col("v"))) == ["$0.00", "$0.00", "$1,234.50", "-$0.01", "$1,234,567.13", "-$12.50"]
    assert _one(spark, [(1999.5,)], "v double", formats.currency(F.col("v"), "JPY")) == ["¥2,000"]
    assert _one(spark, [(5.0,)], "v double", formats.currency(F.col("v"), "CHF")) == ["CHF\u00a05.00"]
    assert _one(spark, [(100.0,), (-1000.5,)], "v double", formats.currency(F.col("v"), html=True)) == ['<span class="symbol">$</span>100', '-<span class="symbol">$</span>1,000<span class="decimal">.</span><span class="fraction">50</span>']
    assert _one(spark, [("$1,234.5 each",), ("1.2.3",), ("none",), ("",), (None,)], "s string", formats.number_in(F.col("s"))) == [1234.5, 1.2, None, None, None]


def test_storage_units(spark):
    sizes = [(None,), (0,), (499,), (500,), (999_999,), (1_000_000,), (1_550_000,), (23_400_000,), (1_250_000_000,), (23_000_000_000,), (1_234_500_000_000,), (1_234_567_000_000_000,)]
    assert _one(spark, sizes, "n long", formats.storage(F.col("n"))) == ["0 kB", "0 kB", "0 kB", "1 kB", "1,000 kB", "1 MB", "1.6 MB", "23 MB", "1.3 GB", "23 GB", "1.23 TB", "1,234.57 TB"]


def test_phone_numbers(spark):
    texts = [("5551234567",), ("1 (555) 123-4567",), ("+1.555.123.4567",), ("2 555 123 4567",), ("911",), ("",), (None,)]
    assert _one(spark, texts, "s string", formats.phone(F.col("s"))) == ["(555) 123-4567", "+1 (555) 123-4567", "+1 (555) 123-4567", "2 555 123 4567", "911", "", ""]


def test_dates(spark):
    now = datetime.datetime(2024, 5, 6, 15, 4)
    times = [(datetime.datetime(2024, 5, 6, 9, 5), now), (datetime.datetime(2024, 1, 2, 9, 5), now), (datetime.datetime(2021, 1, 2, 9, 5), now), (None, now)]
    assert _one(spark, times, "t timestamp, n timestamp", formats.date(F.col("t"), F.col("n"))) == ["9:05 AM", "Jan 2", "1/2/21", ""]


@pytest.mark.parametrize(("past", "want"), [(0, "now"), (499, "now"), (500, "1s ago"), (59_999, "60s ago"), (-5_000, "in 5s"), (60_000, "1min ago"), (-3_600_000, "in 1h"), (DAY, "yesterday"), (-DAY, "tomorrow"), (3 * DAY, "3d ago"), (30 * DAY, "last mo."), (-75 * DAY, "in 3mo"), (365 * DAY, "last yr."), (-800 * DAY, "in 2y"), (None, None)])
def test_times_ago(spark, past, want):
    assert _one(spark, [(past,)], "p long", formats.ago(F.lit(10**12) - F.col("p"), F.lit(10**12))) == [want]


@pytest.mark.parametrize(
    ("text", "broken"),
    [
        (None, []),
        ("no json", ["f"]),
        ("null", ["f"]),
        ("[]", ["f"]),
        ('"x"', ["f"]),
        ("{}", ["f.key", "f.size", "f.mime"]),
        ('{"key": "k", "size": 0, "mime": "m"}', []),
        ('{"key": 1, "size": true, "mime": ""}', ["f.key", "f.size", "f.mime"]),
        ('{"key": "k", "size": "3", "mime": "m"}', ["f.size"]),
        ('{"key": "k", "size": -0.5, "mime": "m", "sha256": "' + "aF" * 32 + '"}', ["f.size"]),
        ('{"key": "k", "size": 1, "mime": "m", "sha256": "' + "aF" * 32 + '\\n"}', ["f.sha256"]),
        ('{"key": "k", "size": 1e3, "mime": "m", "sha256": null, "name": null, "store": null, "metadata": null}', ["f.sha256", "f.name", "f.store", "f.metadata"]),
        ('{"key": "k", "size": 1, "mime": "m", "name": "", "store": "", "metadata": {}}', ["f.store"]),
        ('{"key": "k", "size": 1, "mime": "m", "metadata": {"a": "1", "b": 2}}', ["f.metadata"]),
        ('{"key": "k", "size": 1, "mime": "m", "metadata": {"a": null}}', ["f.metadata"]),
        ('{"key": "k", "size": 1, "mime": "m", "metadata": ["a"]}', ["f.metadata"]),
    ],
)
def test_file_references(spark, text, broken):
    row = spark.createDataFrame([(text,)], "f string").select(files.file_issues(F.col("f"), "f").alias("i")).first()
    assert [i["path"] for i in row["i"]] == broken


def test_metadata_is_a_map(spark):
    rows = [('{"key": "k", "size": 12, "mime": "m", "metadata": {"a": "1", "b c": ""}}',), ('{"key": "k"}',), ("[1]",), (None,)]
    refs = _one(spark, rows, "f string", files.file_reference(F.col("f")))
    assert refs[0]["metadata"] == {"a": "1", "b c": ""} and refs[0]["size"] == 12 and refs[0]["name"] is None
    assert refs[1]["metadata"] is None and refs[2:] == [None, None]


def test_a_derived_field_that_fails_is_absent(spark):
    rows = spark.createDataFrame([(1, "a", [1, 2]), (2, None, []), (None, "c", None)], "n long, s string, a array<long>")
    out = relations.own_derived(rows, up=(lambda s: s.upper(), "string", ["s"]), first=(lambda a, n: a[0] + n, "long", ["a", "n"]), wrong=(lambda n: {"n": n}, "long", ["n"]), big=(lambda n: 2**70 * n, "long", ["n"]))
    assert [tuple(r)[3:] for r in out.collect()] == [("A", 2, None, None), (None, None, None, None), ("C", None, None, None)]
    assert relations.own_derived(rows.limit(0), up=(str.upper, "string", ["s"])).collect() == []


def test_minted_ids_stay_and_sort_by_time(spark):
    rows = spark.createDataFrame([(None, 1_700_000_000_000 + k) for k in range(50)] + [("own", 5)], "id string, ms long")
    made = writes.minted(rows, "id", F.col("ms"))
    first, again = ([tuple(r) for r in made.collect()] for _ in range(2))
    ids = {i: ms for i, ms in first if i != "own"}
    assert sorted(first) == sorted(again) and len(ids) == 50 and ("own", 5) in first
    assert [ids[i] for i in sorted(ids)] == sorted(ids.values()) and all(len(i) == 24 for i in ids)
    back = made.where("id <> 'own'").select("ms", scalars.time_of_prefix(F.col("id")).alias("t")).where("ms <> t")
    assert back.isEmpty() and _one(spark, [("short",), (None,), ("12-45678",)], "s string", scalars.time_of_prefix(F.col("s"))) == [None] * 3


def test_rows_that_break_a_rule_are_refused(spark):
    rows = spark.createDataFrame([(1, 5), (2, -1), (3, None)], "id long, n long")
    rules = [("n", F.col("n") >= 0, "must not be negative"), ("id", F.col("id") < 3, "is too large")]
    with pytest.raises(QueryError) as e:
        writes.checked(rows, rules)
    assert e.value.status == 422 and "n must not be negative (1)" in str(e.value) and "id is too large (1)" in str(e.value)
    assert writes.checked(rows.where("id = 1"), rules).count() == 1
