"""Every registered query against the SQL that must give the same rows."""

import math
from collections import Counter

import duckdb
import pytest

from quern import log_queries, queries, search_queries, write_queries  # noqa: F401  (they register their queries)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return db


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.mark.parametrize("name", queries.ORACLES)
def test_same_rows(spark, sf, duck, name):
    got = queries.QUERIES[name](spark, sf)
    cur = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    want = Counter(tuple(plain(v) for _, v in sorted(zip(names, row, strict=True))) for row in cur.fetchall())
    rows = Counter(tuple(plain(row[c]) for c in sorted(got.columns)) for row in got.collect())
    assert rows == want and (rows or name in ("anti_fk",))
