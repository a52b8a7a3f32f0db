"""NaN in a table's doubles is absent: filters, order, cursors, first rows and facets."""

import pytest

from quern.operators import facets, order
from quern.operators.where import where
from quern.sources.tables import table


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("nan"))
    nan = float("nan")
    spark.createDataFrame([(1, 5.0, 1.0, 1), (2, nan, nan, 1), (3, None, None, 1), (4, 9.0, 2.0, 2), (5, nan, 3.0, 2)], "id long, price double, small float, k long").write.parquet(f"{at}/t.parquet")
    return table(spark, at, "t")


def ids(df):
    return [r["id"] for r in df.collect()]


@pytest.mark.parametrize(("condition", "want"), [({"price": {"gt": 6}}, [4]), ({"price": {"gte": 5}}, [1, 4]), ({"price": {"not_in": [5.0]}}, [4]), ({"small": {"gt": 1}}, [4, 5]), ({"not": {"price": {"gt": 6}}}, [1, 2, 3, 5])])
def test_where(rows, condition, want):
    assert sorted(ids(where(rows, condition))) == want


def test_order_and_facets(rows):
    assert rows.columns == ["id", "price", "small", "k"] and rows.where("isnan(price) or isnan(small)").count() == 0
    assert ids(order.page(rows, [("price", "desc")], "id", limit=5)) == [4, 1, 2, 3, 5]
    assert ids(order.page(order.after(rows, "id", order.cursor("price", "desc", 9.0, 4)), [("price", "desc")], "id", limit=1)) == [1]
    assert sorted(ids(order.first_of(rows, "k", [("price", "desc")], "id"))) == [1, 4]
    assert [r["count"] for r in facets.ranges(rows, "price", [(0, 6), (6, float("inf"))]).collect()] == [1, 1]
