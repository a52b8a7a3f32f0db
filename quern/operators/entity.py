"""Versioned entities: merges, field-level change log, undo, and the incremental sync feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.errors import QueryError
from quern.sources.durable import written

CHANGES = "entity_id long, field string, op string, previous string, value string, operation_id string, created_at long"


def clock(df: DataFrame, proposed: str, order: str, partition: str | None = None) -> Column:
    """Strictly increasing stamps, each the larger of what is proposed and the last stamp + 1."""
    w = Window.partitionBy(partition) if partition else Window.partitionBy()
    place = F.row_number().over(w.orderBy(order))
    return F.max(F.col(proposed) - place).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) + place


def clocked(df: DataFrame, proposed: str, order: list[str], out: str = "stamp") -> DataFrame:
    """``df`` with the stamps of one clock over all rows, in no single task: rows are dealt by ranges of ``order`` (distinct, not null).

    Within a range a row's stamp less its place is the running maximum of what is proposed less the place. Ranges pass on how
    many rows they hold and their maximum, two numbers each.
    """
    dealt = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    w = Window.partitionBy("_part").orderBy(*order)
    rows = dealt.withColumn("_place", F.row_number().over(w))
    lead, before, floor = [], 0, None
    for r in rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.max(F.col(proposed) - F.col("_place")).alias("most")).orderBy("_part").collect():  # one row a range
        lead.append((r["_part"], before, floor))
        floor = r["most"] - before if floor is None else max(floor, r["most"] - before)
        before += r["n"]
    known = df.sparkSession.createDataFrame(lead, "_part int, _before long, _floor long")
    own = F.max(F.col(proposed) - F.col("_place")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_own", own).join(F.broadcast(known), "_part")  # one row a range
    stamp = F.greatest(F.col("_own") - F.col("_before"), F.col("_floor")) + F.col("_place") + F.col("_before")
    return rows.select(*df.columns, stamp.cast("long").alias(out))


def merge(table: DataFrame, patch: DataFrame, pk: str, cleared: str | None = None) -> DataFrame:
    """``table`` with the non-null fields of ``patch``; fields named in the array ``cleared`` become null; new keys are added."""
    fields = [c for c in table.columns if c != pk]
    p = patch.select(F.col(pk).alias("_pk"), *(F.col(c).alias(f"_{c}") for c in fields if c in patch.columns), *([F.col(cleared).alias("_cleared")] if cleared else []))
    joined = table.join(p, table[pk] == F.col("_pk"), "full")

    def field(c: str) -> Column:
        new = F.coalesce(f"_{c}", c) if c in patch.columns else F.col(c)
        return (F.when(~F.coalesce(F.array_contains("_cleared", c), F.lit(False)), new) if cleared else new).alias(c)

    return joined.select(F.coalesce(pk, "_pk").alias(pk), *map(field, fields))


def removed(table: DataFrame, keys: DataFrame, pk: str) -> DataFrame:
    return table.join(keys.select(pk), pk, "left_anti")


def changes(before: DataFrame, after: DataFrame, pk: str, skip: tuple[str, ...] = ("updated_at",)) -> DataFrame:
    """pk, op (create, update, delete), field, previous, value: one row for each field that differs, values as text."""
    fields = [c for c in before.columns if c != pk and c not in skip]
    a = before.select(F.col(pk).alias("_a"), *(F.col(c).cast("string").alias(f"a_{c}") for c in fields))
    b = after.select(F.col(pk).alias("_b"), *(F.col(c).cast("string").alias(f"b_{c}") for c in fields))
    joined = a.join(b, F.col("_a") == F.col("_b"), "full")
    op = F.when(F.col("_a").isNull(), "create").when(F.col("_b").isNull(), "delete").otherwise("update")
    each = F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"a_{c}").alias("previous"), F.col(f"b_{c}").alias("value")) for c in fields))
    rows = joined.select(F.coalesce("_a", "_b").alias(pk), op.alias("op"), F.inline(F.filter(each, lambda x: ~x["previous"].eqNullSafe(x["value"]))))
    return rows


def history(log: DataFrame, entity: int, limit: int = 50, before: int | None = None) -> DataFrame:
    """Changes of one entity (``before`` a time), newest first."""
    own = log.where(F.col("entity_id") == entity)
    own = own if before is None else own.where(F.col("created_at") < before)
    return own.orderBy(F.desc("created_at"), F.desc("field")).limit(max(1, min(limit, 1000)))


def since(log: DataFrame, at: int, limit: int = 500, table: str | None = None, operation: str | None = None) -> DataFrame:
    """Changes at or after a time, oldest first; of one ``table`` (a column of the log), of one operation."""
    rows = log.where(F.col("created_at") >= max(at, 0))
    rows = rows.where(F.col("table") == table) if table is not None else rows
    rows = rows.where(F.col("operation_id") == operation.strip()) if operation and operation.strip() else rows
    return rows.orderBy("created_at", "entity_id", "field").limit(max(1, min(limit, 5000)))


def undo(log: DataFrame, operation: str, blobs: tuple[str, ...] = (), most: int | None = 5000) -> DataFrame:
    """What restores the state before an operation: entity_id, action (delete, recreate, restore), field, value.

    Refused where the operation changed one of ``blobs`` (fields whose contents the log does not hold) or more than ``most``
    entities (None: any number); an operation that the log does not know gives 404.
    """
    own = log.where(F.col("operation_id") == operation)
    found = own.agg(F.count_distinct("entity_id").alias("n"), F.coalesce(F.bool_or(F.col("field").isin(list(blobs))), F.lit(False)).alias("blob")).first()
    if not found["n"]:
        raise QueryError("operation_not_found", operation, 404)
    if found["blob"]:
        raise QueryError("revert_blob_unsupported", operation)
    if most is not None and found["n"] > most:
        raise QueryError("operation_too_large", f"at most {most} entities")
    first = F.min_by(F.struct("previous", "op"), "created_at")
    per_field = own.groupBy("entity_id", "field").agg(first.alias("f"))
    ops = own.groupBy("entity_id").agg(F.min_by("op", "created_at").alias("first_op"))
    action = F.when(F.col("first_op") == "create", "delete").when(F.col("first_op") == "delete", "recreate").otherwise("restore")
    return per_field.join(ops, "entity_id").select("entity_id", action.alias("action"), "field", F.col("f.previous").alias("value"))


def sync_page(rows: DataFrame, stamp: str, low: int, high: int, limit: int, way: str = "asc") -> DataFrame:
    """A page of the feed: (low, high] ascending or [low, high) descending; equal stamps are never split."""
    c = F.col(stamp)
    window = rows.where((c > low) & (c <= high) if way == "asc" else (c >= low) & (c < high))
    key = c.asc() if way == "asc" else c.desc()
    edge = window.select(stamp).orderBy(key).limit(limit)
    edge = edge.agg((F.max(stamp) if way == "asc" else F.min(stamp)).alias("_edge"))  # one row
    return window.crossJoin(F.broadcast(edge)).where(c <= F.col("_edge") if way == "asc" else c >= F.col("_edge")).drop("_edge")


def feed(rows: DataFrame, tombstones: DataFrame, pk: str) -> DataFrame:
    """Rows and tombstones as one feed: pk, stamp, kind (created, updated, deleted)."""
    kind = F.when(F.col("created_at") == F.col("updated_at"), "created").otherwise("updated")
    live = rows.select(pk, F.col("updated_at").alias("stamp"), kind.alias("kind"))
    return live.unionByName(tombstones.select(pk, F.col("deleted_at").alias("stamp"), F.lit("deleted").alias("kind")))


def coalesced(captured: DataFrame) -> DataFrame:
    """Captured changes (seq, entity_id, op, before) folded to one row an entity: created, existed, before, changes.

    With a column ``stamped`` also ``last_before`` and ``stamped``, as the last change left them.
    """
    last = [F.max_by(F.struct(F.col("before").alias("v")), "seq")["v"].alias("last_before"), F.max_by("stamped", "seq").alias("stamped")] if "stamped" in captured.columns else []
    return captured.groupBy("entity_id").agg(
        *last,
        F.bool_or(F.col("op") == "insert").alias("created"),
        (F.min_by("op", "seq") != "insert").alias("existed"),
        F.min_by("before", "seq").alias("before"),
        F.count(F.lit(1)).alias("changes"),
    )
