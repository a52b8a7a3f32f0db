"""Durable cuts of a lineage, and small sides whose size is checked before they are broadcast."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.errors import QueryError

#: Most bytes of a table that is sent to every executor.
BROADCAST_BYTES = 16 << 20
#: Bytes of an Arrow batch that Python tasks take, unless the session says otherwise.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Seconds between two such calls.
TIDY_SECONDS = 4.0
_kept: dict[str, SparkSession] = {}
_tidied = 0.0


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share: ``spark.checkpoint.dir``. Only a local master may do without one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise QueryError("no_shared_folder", "set spark.checkpoint.dir to a folder that all machines share", 500)
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def bounded(spark: SparkSession) -> None:
    """Bound the Arrow batches of Python tasks in bytes, so that long rows do not make large batches."""
    if spark.sparkContext.getConf().get(_BATCH) is None:
        spark.conf.set(_BATCH, BATCH_BYTES)


def new_path(spark: SparkSession, kind: str = "part") -> str:
    """A path of its own under the shared folder; ``release`` deletes it, at the latest when Python ends."""
    path = f"{shared_folder(spark)}/quern/{spark.sparkContext.applicationId}/{kind}-{uuid.uuid4().hex}"
    _kept[path] = spark
    return path


def _tidy(spark: SparkSession) -> None:
    """What led to earlier tables is garbage once they are written: let Spark's cleaner drop its shuffle files, now and then."""
    global _tidied
    if time.monotonic() - _tidied > TIDY_SECONDS:
        gc.collect()
        spark._jvm.System.gc()
        _tidied = time.monotonic()


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut of the lineage that outlives executors."""
    spark = df.sparkSession
    bounded(spark)
    path = new_path(spark)
    df.write.option("compression", codec).parquet(path)
    _tidy(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def delete(path: str) -> None:
    """Delete a path under the shared folder."""
    spark = _kept.pop(path, None)
    if spark is not None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def dropped(df: DataFrame | None) -> None:
    """Delete what ``written`` wrote for ``df``, once nothing will read it again."""
    if df is not None and hasattr(df, "_written"):
        delete(df._written)


def release() -> None:
    """Delete all that this process's operators wrote: for when their results have been saved or shown."""
    for path in list(_kept):
        with contextlib.suppress(Exception):  # the session may have ended
            delete(path)


atexit.register(release)


def put_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a small file through Spark's file system layer."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(at)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def octets(df: DataFrame, column: str) -> int:
    """Bytes of text in a column, from one scan of it."""
    return df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("n")).first()["n"]


def tasks(spark: SparkSession, least: int = 1) -> int:
    """Partitions of a shuffle, as the session sets it."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def beside(table: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """A written table as the small side of a join: broadcast if its values are small, else shuffled as any other."""

    def size(c: str, kind: str):
        if kind in ("string", "binary"):
            return F.coalesce(F.octet_length(c), F.lit(0))
        return F.coalesce(F.size(c), F.lit(0)) * 16 if kind.startswith("array") else F.lit(8)

    total = table.agg(F.coalesce(F.sum(sum((size(c, k) for c, k in table.dtypes), F.lit(16))), F.lit(0)).alias("n")).first()["n"]
    return F.broadcast(table) if total <= most else table


def by_key(rows: DataFrame, table: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with a ``table`` of one row a key, whose column ``count`` tells how many rows the key has.

    Keys above a task's fair share are few (fewer than four a task, whatever the data), so they are broadcast and
    their rows stay where they are; all other keys meet by a shuffle. ``count`` itself is dropped.
    """
    spark = rows.sparkSession
    fair = max(1000, total // (4 * tasks(spark)))
    hot = table.where(F.col(count) > fair).drop(count)
    cold = table.where(F.col(count) <= fair).drop(count)
    names = F.broadcast(hot.select(F.col(key).alias("_hot")))
    rest = rows.join(names, F.col(key) == F.col("_hot"), "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(cold, key))
