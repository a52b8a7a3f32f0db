"""Logs of replicated documents: listings, the floor of acknowledgements, what a compaction would do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def updates(log: DataFrame, doc: str, seq: str, after: int = 0, upto: int | None = None) -> DataFrame:
    """The updates of a log behind ``after`` and up to ``upto``, in order of document and place."""
    rows = log.where(F.col(seq) > after)
    return (rows if upto is None else rows.where(F.col(seq) <= upto)).orderBy(doc, seq)


def floor(peers: DataFrame, doc: str, acked: str, seen: str, now: int, ttl: int) -> DataFrame:
    """doc, floor: the least place that all peers heard of within ``ttl`` have acknowledged."""
    return peers.where(F.lit(now) - F.col(seen) <= ttl).groupBy(doc).agg(F.min(acked).alias("floor"))


def places(frontiers: DataFrame, log: DataFrame, checkpoints: DataFrame, doc: str) -> DataFrame:
    """doc, frontier, seq: a frontier's place by its checkpoint, else by the first update that reached it; null if neither knows it."""
    known = lambda d, name: d.groupBy(doc, "frontier").agg(F.min("seq").alias(name))
    found = frontiers.join(known(checkpoints, "_c"), [doc, "frontier"], "left").join(known(log, "_u"), [doc, "frontier"], "left")
    return found.select(doc, "frontier", F.coalesce("_c", "_u").alias("seq"))


def compaction(log: DataFrame, floors: DataFrame, snapshots: DataFrame, doc: str, threshold: int, forever: DataFrame | None = None) -> DataFrame:
    """doc, boundary, discarded, freed, dropped_snapshots, skipped: what compacting each document's log would do.

    The boundary is the head, or the floor if that lies before it; updates up to it go, and so do unpinned snapshots that
    cover less. Skipped: ``retention_forever``, ``below_threshold``, ``peer_floor`` (a peer still needs all of it), or
    ``would_grow`` (the new snapshot, as large as the last one or as the log, takes more than is freed).
    """
    heads = log.groupBy(doc).agg(F.max("seq").alias("head"), F.sum("bytes").alias("bytes"))
    plan = heads.join(floors, doc, "left").withColumn("boundary", F.least("head", F.coalesce("floor", "head")))
    cut = log.join(plan.select(doc, "boundary"), doc).where(F.col("seq") <= F.col("boundary")).groupBy(doc).agg(F.count(F.lit(1)).alias("discarded"), F.sum("bytes").alias("log_freed"))
    old = snapshots.join(plan.select(doc, "boundary"), doc).where(~F.col("pinned") & (F.col("covers_seq") < F.col("boundary")))
    old = old.groupBy(doc).agg(F.count(F.lit(1)).alias("dropped_snapshots"), F.sum("bytes").alias("snap_freed"))
    last = snapshots.groupBy(doc).agg(F.max_by("bytes", "covers_seq").alias("last_bytes"))
    rows = plan.join(cut, doc, "left").join(old, doc, "left").join(last, doc, "left")
    freed = F.coalesce("log_freed", F.lit(0)) + F.coalesce("snap_freed", F.lit(0))
    keep = F.lit(False)
    if forever is not None:
        rows = rows.join(forever.select(doc, F.lit(True).alias("_forever")), doc, "left")
        keep = F.coalesce("_forever", F.lit(False))
    size = F.coalesce("last_bytes", "bytes")
    skipped = (
        F.when(keep, "retention_forever").when(F.col("bytes") < threshold, "below_threshold")
        .when(F.coalesce("discarded", F.lit(0)) == 0, "peer_floor").when(size > freed, "would_grow")
    )
    return rows.select(doc, "boundary", F.coalesce("discarded", F.lit(0)).alias("discarded"), freed.alias("freed"), F.coalesce("dropped_snapshots", F.lit(0)).alias("dropped_snapshots"), skipped.alias("skipped"))
