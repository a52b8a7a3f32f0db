"""Bounds and limits of the sync feed, and the upkeep of the change log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.durable import written

MOST_TOMBSTONES = 10_000


def bounds(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """oldest, newest over several tables (name -> rows, stamp); zero and empty tables count for nothing."""
    parts = None
    for rows, stamp in tables.values():
        part = rows.agg(F.min(F.nullif(F.col(stamp), F.lit(0))).alias("oldest"), F.max(stamp).alias("newest"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.agg(F.min("oldest").alias("oldest"), F.max(F.nullif("newest", F.lit(0))).alias("newest"))


def deferred(page: DataFrame, table: DataFrame, ceiling: int) -> DataFrame:
    """The page, or none of it while the table holds more than ``ceiling`` rows."""
    size = table.limit(ceiling + 1).agg(F.count(F.lit(1)).alias("_size"))  # one row
    return page.crossJoin(F.broadcast(size)).where(F.col("_size") <= ceiling).drop("_size")


def resumed(low: int, seen_version: int | None, version: int) -> int:
    """Where a reader goes on: from the start once the configuration has changed."""
    return low if seen_version == version else 0


def capped(tombstones: DataFrame, pk: str, stamp: str, most: int = MOST_TOMBSTONES) -> tuple[DataFrame, bool]:
    """Tombstones, less the oldest half once there are more than ``most``; and whether readers must start anew."""
    if tombstones.limit(most + 1).count() <= most:
        return tombstones, False
    n = tombstones.count()
    # The stamp in the middle, from counts a stamp: first the range of stamps that holds it, then a window over that range.
    by = written(tombstones.groupBy(stamp).agg(F.count(F.lit(1)).alias("_n")).repartitionByRange(stamp).withColumn("_part", F.spark_partition_id()))
    rest = n // 2
    for r in by.groupBy("_part").agg(F.sum("_n").alias("n")).orderBy("_part").collect():  # one row a range
        part = r["_part"]
        if r["n"] >= rest:
            break
        rest -= r["n"]
    upto = F.sum("_n").over(Window.partitionBy("_part").orderBy(stamp))
    edge = by.where(F.col("_part") == part).withColumn("_upto", upto).where(F.col("_upto") >= rest).agg(F.min(stamp)).first()[0]
    older = tombstones.where(F.col(stamp) < edge).count()
    rest = n // 2 - older
    tied = tombstones.where(F.col(stamp) == edge).orderBy(pk).limit(rest).select(F.col(pk).alias("_gone"))
    kept = tombstones.where(F.col(stamp) >= edge).join(tied, (F.col(pk) == F.col("_gone")) & (F.col(stamp) == edge), "left_anti")
    return kept, True


def retained(log: DataFrame, table: str, stamp: str, days: dict[str, int], now: int) -> DataFrame:
    """The change log without what is older than its table keeps (days; 0 or unnamed: for ever)."""
    keep = F.lit(True)
    for name, n in days.items():
        if n:
            keep &= (F.col(table) != name) | (F.col(stamp) >= now - n * 86_400_000)
    return log.where(keep)


def payload(df: DataFrame, blobs: tuple[str, ...] = (), vectors: tuple[str, ...] = ()) -> Column:
    """A row as it enters the history: without vectors, and with a mark in place of each blob."""
    marked = F.struct(F.lit(True).alias("__blob_omitted"))
    return F.to_json(F.struct(*((F.when(F.col(c).isNotNull(), marked) if c in blobs else F.col(c)).alias(c) for c in df.columns if c not in vectors)))


def operation(log: DataFrame, name: str) -> DataFrame:
    """The changes of one operation, oldest first."""
    return log.where(F.col("operation_id") == name).orderBy("created_at", "entity_id", "field")


def scoped(log: DataFrame, actor: str | None, name: str | None) -> DataFrame:
    """Changes that are written on someone's behalf."""
    return log.withColumns({"actor": F.lit(actor).cast("string"), "operation_id": F.lit(name).cast("string")})


def released(before: DataFrame, after: DataFrame, pk: str, key: str) -> DataFrame:
    """File keys that no row holds as before: of deleted rows, and of rows whose key changed."""
    old = before.where(F.col(key).isNotNull()).select(pk, F.col(key).alias("_old"))
    new = after.select(pk, F.col(key).alias("_new"))
    return old.join(new, pk, "left").where(~F.col("_old").eqNullSafe(F.col("_new"))).select(pk, F.col("_old").alias("file_key"))
