"""References to objects outside of the tables: files under a folder, read by name when a row asks for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stored(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """name (path below the folder), length, changed, content of the files; content is read only where it is selected."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(root).toString().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    plain = lambda c: F.regexp_replace(c, "^[a-z]+:/+", "/")  # noqa: E731  (schemes are written with one to three strokes)
    name = F.substring(plain(F.col("path")), F.length(plain(F.lit(root))) + 2, F.lit(1 << 20))
    return files.select(name.alias("name"), "length", F.col("modificationTime").alias("changed"), "content")


def resolved(rows: DataFrame, reference: str, objects: DataFrame, out: str = "object", content: bool = True) -> DataFrame:
    """Every row with its object as a struct; null where the reference is null or names nothing."""
    fields = ["name", "length", "changed", *(["content"] if content else [])]
    packed = objects.select(F.col("name").alias("_name"), F.struct(*fields).alias(out))
    return rows.drop(out).join(packed, F.col(reference) == F.col("_name"), "left").drop("_name")
