"""Registered queries on tables beyond the size at which a limit once cut them off, against their SQL."""

from collections import Counter

import duckdb
import pytest
from test_queries import TABLES, plain

from quern import log_queries, queries, search_queries, write_queries  # noqa: F401  (they register their queries)


@pytest.fixture(scope="module")
def many(sf, tmp_path_factory):
    """A folder with 120,000 orders, those of ``sf`` with shifted keys."""
    at = tmp_path_factory.mktemp("many")
    duckdb.execute(f"COPY (SELECT * REPLACE (o_orderkey + i * 1500 AS o_orderkey) FROM '{sf}/orders.parquet', range(80) r(i)) TO '{at}/orders.parquet' (FORMAT parquet)")
    return str(at)


def same(spark, folder, name, tables=TABLES):
    got, db = queries.QUERIES[name](spark, folder), duckdb.connect()
    for t in tables:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    cur = db.execute(queries.ORACLES[name])
    names = [d[0] for d in cur.description]
    want = Counter(tuple(plain(v) for _, v in sorted(zip(names, row, strict=True))) for row in cur.fetchall())
    return bool(want) and Counter(tuple(plain(row[c]) for c in sorted(got.columns)) for row in got.collect()) == want


def test_an_operation_on_thousands_of_rows_is_undone(spark, many):
    assert same(spark, many, "revert_operation", ["orders"])


def test_a_transaction_of_thousands_of_rows(spark, many):
    assert same(spark, many, "transaction_ops", ["orders"])


def test_storage_past_a_terabyte_is_text_as_in_its_sql(spark, many):
    assert same(spark, many, "format_values", ["orders"])


def test_typos_are_found_in_a_dictionary_past_the_guard(spark, sf, monkeypatch):
    monkeypatch.setattr("quern.plans.store.DICTIONARY_GUARD", 10)
    assert same(spark, sf, "stored_prefix_typo")
