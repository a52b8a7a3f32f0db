"""Live results: what a change does to the result of a query, without running the query again.

A ``LiveQuery`` holds the result of a filter, or one ordered page of it, for some version of a ``VersionedTable``. ``advance``
reads the rows that changed since, and gives what they do to the result: rows that ``enter``, ``leave`` or ``change``. Applied
one after another, these give the result of the last version. A filter without a limit needs the changed rows alone. A page is
merged with those of the changed rows that match; only when rows may have to move up from behind the page's old end does it
look there, by a cursor that reaches the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.errors import QueryError
from quern.operators import order as O
from quern.operators.where import where
from quern.sources.durable import written
from quern.sources.versions import VersionedTable


def deltas(old: DataFrame, new: DataFrame, pk: str) -> DataFrame:
    """delta (enter, leave, change) and the new row, or the old one of those that leave."""
    columns = [c for c in new.columns if c != pk]
    a = old.select(F.col(pk).alias("_a"), F.struct(*columns).alias("_old"))
    b = new.select(F.col(pk).alias("_b"), F.struct(*columns).alias("_new"))
    kind = F.when(F.col("_a").isNull(), "enter").when(F.col("_b").isNull(), "leave").otherwise("change")
    rows = a.join(b, F.col("_a") == F.col("_b"), "full").where(~F.col("_old").eqNullSafe(F.col("_new")))
    row = F.when(F.col("_b").isNull(), F.col("_old")).otherwise(F.col("_new"))
    return rows.select(kind.alias("delta"), F.coalesce("_b", "_a").alias(pk), *(row[c].alias(c) for c in columns))


def folded(result: DataFrame, delta: DataFrame, pk: str) -> DataFrame:
    """A result with deltas applied."""
    stay = result.join(delta.select(pk), pk, "left_anti").select(*result.columns)
    return stay.unionByName(delta.where("delta <> 'leave'").select(*result.columns))


class LiveQuery:
    """``condition`` of the filter language over a versioned table; ``order`` and ``limit``: a page of the result."""

    def __init__(self, table: VersionedTable, path: str, condition: dict, order: list[tuple[str, str]] | None = None, limit: int | None = None, fields: list[str] | None = None):
        self.table, self.path, self.condition, self.order, self.pk = table, path.rstrip("/"), condition, order or [], table.pk
        if limit is not None and not 0 < limit <= O.MOST_SPARSE:
            raise QueryError("invalid_limit", str(limit))
        self.limit, self.refills = limit, 0
        every = table.read().columns
        for f in [*(fields or []), *(n for n, _ in self.order)]:
            if f not in every or f == "delta":
                raise QueryError("unknown_field", f)
        self.fields = list(dict.fromkeys([self.pk, *(fields or every), *(n for n, _ in self.order)]))

    def _seen(self) -> list[int]:
        fs, at = self.table._fs(self.path)
        done = lambda s: fs.exists(self.table._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(at) if s.getPath().getName().isdigit() and done(s)) if fs.exists(at) else []

    @property
    def version(self) -> int:
        """The table's version that the result is of; -1 before the first."""
        return (self._seen() or [-1])[-1]

    def result(self) -> DataFrame:
        """The result as of ``version``: for a page its rows, stored; else the filter over that version."""
        version = self.version
        if self.limit is None:
            return where(self.table.read(version), self.condition).select(*self.fields)
        return self.table.spark.read.parquet(f"{self.path}/{version:012d}")

    def _store(self, version: int, page: DataFrame | None) -> None:
        page = page if page is not None else self.table.spark.range(0)
        page.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{version:012d}")  # a page at most

    def _page(self, rows: DataFrame) -> DataFrame:
        return rows.orderBy(*O.keys(rows, self.order, self.pk)).limit(self.limit)

    def start(self) -> DataFrame:
        """The whole result of the last version, as rows that enter."""
        version = self.table.version
        rows = where(self.table.read(version), self.condition).select(*self.fields)
        rows = written(self._page(rows)) if self.limit else rows
        self._store(version, rows if self.limit else None)
        return rows.select(F.lit("enter").alias("delta"), *self.fields)

    def advance(self) -> DataFrame:
        """Deltas from ``version`` to the table's last one, which becomes ``version``."""
        last, to = self.version, self.table.version
        if last < 0:
            return self.start()
        before, after = self.table.changed(last, to)
        if self.limit is None:
            out = deltas(where(before, self.condition).select(*self.fields), where(after, self.condition).select(*self.fields), self.pk)
            out = written(out)
            self._store(to, None)
            return out
        page = self.result()
        touched = written(before.select(self.pk).union(after.select(self.pk)).distinct())
        stay = page.join(touched, self.pk, "left_anti").select(*self.fields)
        come = where(after, self.condition).select(*self.fields)
        new = written(self._page(stay.unionByName(come)))
        if (old := page.count()) == self.limit and old:
            edge = page.orderBy(*O.keys(page, self.order, self.pk)).tail(1)[0]
            if new.count() < self.limit or not O.behind(new, self.order, self.pk, edge.asDict()).isEmpty():
                self.refills += 1  # of what lies behind the old end the unchanged rows are missing
                behind = O.behind(where(self.table.read(to), self.condition), self.order, self.pk, edge.asDict()).select(*self.fields)
                behind = behind.join(touched, self.pk, "left_anti").select(*self.fields)
                new = written(self._page(new.unionByName(self._page(behind)).dropDuplicates([self.pk])))
        out = written(deltas(page, new, self.pk))
        self._store(to, new)
        return out


def follow(live: LiveQuery, commits: DataFrame, sink, checkpoint: str) -> StreamingQuery:
    """Advance ``live`` with every batch of a stream that announces commits; ``sink(deltas, batch number)`` gets what came of it."""

    def push(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            sink(live.advance(), number)

    return commits.writeStream.foreachBatch(push).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
