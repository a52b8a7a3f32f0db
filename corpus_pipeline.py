"""The corpus pipeline: language ID, near-duplicate removal, passage removal, mixing and tokenization.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns the
columns of ``docs``; the last one returns token ids. Null or empty columns, repeated rows, empty
tables and extra columns are treated as each operator's module says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe_codec, language_id, mixing, ngram_join, substring_dedup
from quern.llm.spark import beside, written

#: Least share of a document that its main language must hold.
LEAST_SHARE = 0.5
ORACLE_SQL: str | None = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a main language stay; ``lang`` becomes the predicted one.

    Two folds by a hash of the text: each is judged by a model of the other, so no document by a model that saw it.
    """
    fold = F.pmod(F.xxhash64("text"), F.lit(2))
    parts = [language_id.identify(docs.where(fold == k), language_id.learn(docs.where(fold != k).select("text", "lang"))) for k in (0, 1)]
    found = parts[0].unionByName(parts[1]).where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SHARE))
    return found.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component the row with the smallest doc_id (then text hash) stays; documents without words stay too."""
    rows = written(ngram_join.join(docs))
    groups = rows.where("n_shingles > 0").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id", "tie")).alias("one"))
    words = groups.select(F.col("one.doc_id").alias("_id"), F.col("one.tie").alias("_tie"))
    bare = rows.where("n_shingles = 0").select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"))
    stay = written(words.union(bare).distinct())
    keyed = docs.withColumns({"_doc": F.col("doc_id").cast("long"), "_hash": F.xxhash64("text")})
    kept = keyed.join(beside(stay), F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_tie")))
    again = rows.groupBy("doc_id", "tie").count().where("count > 1").limit(1).count()
    kept = kept.dropDuplicates(["_doc", "_hash"]) if again else kept  # only then is the text shuffled
    return kept.select(*docs.columns)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stood earlier in the corpus go; a document that nothing is left of goes with them."""
    found = substring_dedup.dedup_text(docs).where("n_removed < n_words or n_words = 0")
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    found = found.withColumn("text", text)
    found = found.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else found
    return found.select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weigh 5, 2, 1, repeating; each document stands as often as the mix takes it."""
    return mixing.mixed(docs, mixing.cycle(5, 2, 1)).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, and whether they decode to its text."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    back = bpe_codec.encode(docs, path, back=True)
    return back.select("doc_id", "source", "lang", "n_tokens", "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [("language_id", language), ("ngram_join", near_duplicates), ("substring_dedup", passages), ("mixing", mixture), ("bpe_codec", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = written(docs) if k + 1 < len(STAGES) else docs
    return docs
