"""Versioned tables: transactions that commit as a whole, or leave no trace, and refuse what another commit has overtaken.

A table's rows are dealt into buckets by a hash of the key. A commit reads and writes only the buckets that its operations
touch: new folders for these, then one small manifest that names the folder of every bucket. The manifest of version n can be
made only once (a hard link on local disks, a rename that never replaces elsewhere), so of two commits on the same version one
is first; the other goes on from there if they touch different buckets, and is refused with 409 if not. Folders without a
manifest are invisible: a write that dies leaves the old version as it was. Readers keep the version they began with.

The file system must offer hard links or an atomic rename; keys are not null. Every commit also stores what changed, field by
field, and the tombstones of rows that went; stamps rise strictly from commit to commit. A replayed operation id gives the
version that it made and changes nothing.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.errors import QueryError
from quern.operators import entity, writes
from quern.sources.durable import put_bytes

BUCKETS = 64
MOST_TRIES = 50
STAMPS = ("created_at", "updated_at")
CHANGES = "op string, field string, previous string, value string, operation string, version long, created_at long"


def now_ms() -> int:
    return time.time_ns() // 1_000_000


class VersionedTable:
    """A table at ``path`` (of Spark's file systems), keyed by ``pk``."""

    def __init__(self, spark: SparkSession, path: str, now: Callable[[], int] = now_ms):
        self.spark, self.path, self.now = spark, path.rstrip("/"), now
        self._jvm = spark._jvm
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()
        first = self._manifest(self.version)
        self.pk, self.buckets = first["pk"], first["n_buckets"]

    @classmethod
    def create(cls, spark: SparkSession, path: str, rows: DataFrame, pk: str, buckets: int = BUCKETS, now: Callable[[], int] = now_ms) -> VersionedTable:
        """A new table with ``rows`` as version 0; refused with 409 if one stands there or a key comes twice."""
        self = cls.__new__(cls)
        self.spark, self.path, self.now, self.pk, self.buckets = spark, path.rstrip("/"), now, pk, buckets
        self._jvm, self._conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
        if self._versions():
            raise QueryError("table_exists", path, 409)
        if not rows.groupBy(pk).count().where("count > 1").isEmpty():
            raise QueryError("entity_exists", "a key comes twice", 409)
        stamp = now()
        rows = rows.withColumns({c: F.lit(stamp) for c in STAMPS})
        folders = self._put(rows, f"data/{uuid.uuid4().hex}", range(buckets))
        first = {"version": 0, "operation": None, "pk": pk, "n_buckets": buckets, "clock": stamp, "schema": rows.schema.json(), "buckets": folders, "touched": list(range(buckets)), "changes": None, "tombstones": None}
        if not self._link(first):
            raise QueryError("table_exists", path, 409)
        return self

    # Files

    def _fs(self, path: str):
        at = self._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self._conf), at

    def _versions(self) -> list[int]:
        fs, at = self._fs(f"{self.path}/_versions")
        return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(at) if s.getPath().getName().endswith(".json")) if fs.exists(at) else []

    def _manifest(self, version: int) -> dict:
        fs, at = self._fs(f"{self.path}/_versions/{version:012d}.json")
        if not fs.exists(at):
            raise QueryError("unknown_version", str(version), 404)
        stream = fs.open(at)
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def _link(self, manifest: dict) -> bool:
        """Make the manifest of a version that has none; False if another was first."""
        name = f"{self.path}/_versions/{manifest['version']:012d}.json"
        put_bytes(self.spark, temp := f"{self.path}/_versions/.{uuid.uuid4().hex}", json.dumps(manifest).encode())
        fs, source = self._fs(temp)
        target = self._jvm.org.apache.hadoop.fs.Path(name)
        try:
            if fs.getUri().getScheme() == "file":
                as_path = lambda p: self._jvm.java.nio.file.Paths.get(self._jvm.java.net.URI.create("file://" + p.toUri().getPath()))
                self._jvm.java.nio.file.Files.createLink(as_path(target), as_path(source))
            else:
                kinds = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
                never = self.spark.sparkContext._gateway.new_array(kinds, 1)
                never[0] = kinds.NONE
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf).rename(source, target, never)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        finally:
            fs.delete(source, False)
        return True

    def _bucket(self, key: Column | str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _put(self, rows: DataFrame, folder: str, buckets) -> dict[str, str]:
        """Write rows by bucket; the folder of each bucket that has rows."""
        rows.withColumn("_bucket", self._bucket(self.pk)).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        fs, _ = self._fs(self.path)
        there = lambda b: fs.exists(self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}/_bucket={b}"))
        return {str(b): f"{folder}/_bucket={b}" for b in buckets if there(b)}

    # Reading

    @property
    def version(self) -> int:
        found = self._versions()
        if not found:
            raise QueryError("unknown_table", self.path, 404)
        return found[-1]

    def _rows(self, manifest: dict, buckets=None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(manifest["schema"]))
        folders = [f"{self.path}/{f}" for b, f in manifest["buckets"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version (the last one)."""
        return self._rows(self._manifest(self.version if version is None else version))

    def get(self, key) -> DataFrame:
        """The row of a key, from its bucket only; refused with 404 where there is none."""
        manifest = self._manifest(self.version)
        kind = next(f for f in json.loads(manifest["schema"])["fields"] if f["name"] == self.pk)["type"]
        (bucket,) = self.spark.range(1).select(self._bucket(F.lit(key).cast(kind))).first()
        return writes.get(self._rows(manifest, {bucket}), self.pk, key)

    def _logs(self, kind: str, after: int, schema: str) -> DataFrame:
        folders = [m[kind] for m in map(self._manifest, [v for v in self._versions() if v > after]) if m[kind]]
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], schema)

    def _key_ddl(self) -> str:
        return f"`{self.pk}` {T.StructType.fromJson(json.loads(self._manifest(self.version)['schema']))[self.pk].dataType.simpleString()}"

    def changes(self, after: int = 0) -> DataFrame:
        """Field-level changes of the commits behind a version."""
        return self._logs("changes", after, f"{self._key_ddl()}, {CHANGES}")

    def tombstones(self, after: int = 0) -> DataFrame:
        """Keys that went, with ``deleted_at``, since a version."""
        return self._logs("tombstones", after, f"{self._key_ddl()}, deleted_at long")

    def changed(self, low: int, high: int) -> tuple[DataFrame, DataFrame]:
        """Rows as of ``low`` that are gone or others as of ``high``, and rows of ``high`` that are new or others; only touched buckets are read."""
        a, b = self._manifest(low), self._manifest(high)
        moved = {int(k) for k in a["buckets"].keys() | b["buckets"].keys() if a["buckets"].get(k) != b["buckets"].get(k)}
        before, after = self._rows(a, moved), self._rows(b, moved)
        packed = lambda df: df.select(F.col(self.pk).alias("_pk"), F.struct(*(c for c in before.columns if c != "updated_at")).alias("_row"))
        other = lambda x, y: x.join(packed(y), F.col(self.pk) == F.col("_pk"), "left").where(~F.coalesce(F.struct(*(c for c in before.columns if c != "updated_at")).eqNullSafe(F.col("_row")), F.lit(False))).select(*x.columns)
        return other(before, after), other(after, before)

    def history(self) -> list[dict]:
        """version, operation, clock, touched buckets of every commit."""
        return [{k: m[k] for k in ("version", "operation", "clock", "touched")} for m in map(self._manifest, self._versions())]

    # Writing

    def begin(self) -> Transaction:
        return Transaction(self, self.version)

    def vacuum(self, keep: int = 10, hours: float = 24.0) -> int:
        """Drop all but the last ``keep`` versions, and folders that none of these names and no write of the last hours made; how many folders went."""
        versions = self._versions()
        kept = [self._manifest(v) for v in versions[-max(keep, 1) :]]
        used = {f.split("/")[1] for m in kept for f in [*m["buckets"].values(), m["changes"], m["tombstones"]] if f}
        for v in versions[: -max(keep, 1)]:
            fs, at = self._fs(f"{self.path}/_versions/{v:012d}.json")
            fs.delete(at, False)
        gone, before = 0, now_ms() - int(hours * 3_600_000)
        for kind in ("data", "changes", "tombstones"):
            fs, at = self._fs(f"{self.path}/{kind}")
            for s in fs.listStatus(at) if fs.exists(at) else []:
                if s.getPath().getName() not in used and s.getModificationTime() <= before:
                    fs.delete(s.getPath(), True)
                    gone += 1
        return gone


class Transaction:
    """Operations in order, on one version; nothing is written before ``commit``."""

    def __init__(self, table: VersionedTable, base: int):
        self.table, self.base, self.ops = table, base, []

    def create(self, rows: DataFrame) -> Transaction:
        self.ops.append(("create", rows))
        return self

    def update(self, patch: DataFrame) -> Transaction:
        """A patch of columns; a null leaves the value as it is."""
        self.ops.append(("update", patch))
        return self

    def merge(self, patches: DataFrame, column: str = "patch") -> Transaction:
        """A JSON merge patch a row: an absent field stays, an explicit null clears."""
        self.ops.append(("merge", patches.select(self.table.pk, F.col(column).alias("patch"))))
        return self

    def delete(self, keys: DataFrame) -> Transaction:
        self.ops.append(("delete", keys))
        return self

    def commit(self, operation: str | None = None, rules: dict[str, Column] | None = None, most: int | None = writes.MOST_OPS) -> int:
        """All operations as one new version, whose number is given; or a refusal, and no new version.

        ``rules``: conditions that all rows touched must meet (null passes). ``most``: rows of operations at most (None: any).
        """
        t = self.table
        if operation is not None:
            for m in t.history():
                if m["operation"] == operation:
                    return m["version"]
        if most is not None and sum(rows.limit(most + 1).count() for _, rows in self.ops) > most:
            raise QueryError("operation_too_large", f"at most {most} rows")
        keys = [rows.select(t._bucket(t.pk).alias("b"), F.col(t.pk).isNull().alias("bare")).distinct() for _, rows in self.ops]
        found = [r for k in keys for r in k.collect()]  # a row a bucket and kind
        if any(r["bare"] for r in found):
            raise QueryError("invalid_key", "a key is null")
        mine = {r["b"] for r in found}
        made = None
        for _ in range(MOST_TRIES):
            last = t.version
            for v in range(self.base + 1, last + 1):
                if mine & set(t._manifest(v)["touched"]):
                    self._drop(made)
                    raise QueryError("conflict", f"version {v} touched the same rows", 409)
            manifest = t._manifest(last)
            if made is None or made["clock"] <= manifest["clock"]:  # stamps rise from version to version
                self._drop(made)
                made = self._made(manifest, mine, operation, rules)
            new = {k: v for k, v in manifest["buckets"].items() if int(k) not in mine} | made["buckets"]
            if t._link(made | {"version": last + 1, "buckets": new}):
                return last + 1
        raise QueryError("busy", "too many commits at once", 503)

    def _made(self, manifest: dict, mine: set[int], operation: str | None, rules: dict[str, Column] | None) -> dict:
        """Write the new buckets, changes and tombstones; what the manifest says of them."""
        t, name = self.table, uuid.uuid4().hex
        stamp = max(t.now(), manifest["clock"] + 1)
        before = t._rows(manifest, mine)
        after, gone = writes.transaction(before, self.ops, t.pk, F.lit(stamp), most=None)
        after = after.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in before.schema))
        if rules:
            broken = after.where("updated_at = " + str(stamp)).select(*((~F.coalesce(c, F.lit(True))).alias(n) for n, c in rules.items()))
            found = broken.agg(*(F.bool_or(n).alias(n) for n in rules)).first()
            if bad := [n for n in rules if found[n]]:
                raise QueryError("validation_failed", ", ".join(bad), 422)
        try:
            folders = t._put(after, f"data/{name}", mine)
            stored = t._rows(manifest | {"buckets": folders})
            log = entity.changes(before, stored, t.pk, STAMPS).withColumns({"operation": F.lit(operation), "version": F.lit(manifest["version"] + 1).cast("long"), "created_at": F.lit(stamp)})
            log.coalesce(max(1, len(mine) // 8)).write.parquet(f"{t.path}/changes/{name}")
            if gone is not None:
                gone.select(t.pk, F.col("deleted_at").cast("long")).coalesce(1).write.parquet(f"{t.path}/tombstones/{name}")
        except AnalysisException as e:
            raise QueryError("invalid_operation", str(e).splitlines()[0]) from e
        return manifest | {"operation": operation, "clock": stamp, "buckets": folders, "touched": sorted(mine), "changes": f"changes/{name}", "tombstones": f"tombstones/{name}" if gone is not None else None}

    def _drop(self, made: dict | None) -> None:
        """Delete what a commit wrote that did not become a version."""
        for kind in ("data", "changes", "tombstones") if made else ():
            fs, at = self.table._fs(f"{self.table.path}/{kind}/{made['changes'].split('/')[1]}")
            fs.delete(at, True)
