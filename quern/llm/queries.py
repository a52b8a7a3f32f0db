"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import string

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import alignment, ball_tree, bpe_codec, divergence, fingerprints, html_extract, language_id, mixing, ngram_join, projections, quality, substring_dedup, token_files
from quern.llm.spark import new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(parts: int, held: int) -> F.Column:
    """Whether crc32 of doc_id as text leaves ``held``; a null doc_id is in no held-out fold."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == held, F.lit(False))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by a classifier that saw no label of the held-out fold."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").where(~_fold(5, 0)).select("doc_id", "quality")
    rows = quality.score(docs, quality.train(docs, labels))
    return rows.select("doc_id", _fold(5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document, decode the ids, and give digests of both."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    back = bpe_codec.encode(docs, path, back=True)
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document under links of Jaccard similarity 0.75 or more on 5-word shingles."""
    return ngram_join.join(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, removed words and a digest of the kept words of every document, windows of 20 words."""
    rows = substring_dedup.dedup_text(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op5_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest integer inner products of every 20th vector with all others."""
    return ball_tree.top(_table(spark, sf_dir, "embeddings"), every=20, k=20)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every document's ids to token files, read the files back, and give counts and checksums."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    path = new_path(spark, "tokens")
    token_files.write(docs, path, public_tokenizers.path("word_bpe_49k.json"), end=2, vocabulary=49_408)
    return token_files.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, for source weights 5, 2, 1, repeating."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rows, sizes, quotas = mixing.mix(docs, mixing.cycle(5, 2, 1))
    known = spark.createDataFrame([(s, sizes[s], quotas[s]) for s in sizes], "name string, source_size long, target double")
    rows = rows.withColumn("source", F.element_at("sources", 1))
    out = rows.join(F.broadcast(known), rows["source"].eqNullSafe(known["name"]), "left")  # one row a source
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows outside the held-out fold."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.learn(docs.where(~_fold(4, 2)).select("text", "lang"))
    rows = language_id.identify(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", _fold(4, 2).alias("held_out"), "lang_pred", "score")


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op10_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors that the projected search finds for every 20th vector."""
    return projections.nearest(_table(spark, sf_dir, "embeddings"), every=20, k=20)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the tokens of two tokenizers end together in every document, and how usual its linked pairs of ids are."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.summary(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of an edit of it, and how alike they are."""
    return fingerprints.with_next(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the sources of each language diverge from each other, and their leading terms."""
    return divergence.audit(_table(spark, sf_dir, "documents").select("text", "lang", "source"))


QUERIES = {"op1_quality": op1_quality, "op2_bpe_codec": op2_bpe_codec, "op3_ngram_join": op3_ngram_join, "op4_substring_dedup": op4_substring_dedup, "op5_ball_tree": op5_ball_tree, "op6_token_files": op6_token_files, "op7_mixing": op7_mixing, "op8_language_id": op8_language_id, "op9_html_extract": op9_html_extract, "op10_projections": op10_projections, "op11_alignment": op11_alignment, "op12_fingerprints": op12_fingerprints, "op13_divergence": op13_divergence}
_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase
ORACLES: dict[str, str] = {
    "op13_divergence": rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
t AS (SELECT r, lang, source, term, count(*)::HUGEINT AS n FROM w GROUP BY ALL),
kept AS (SELECT lang, term, sum(n)::HUGEINT AS total FROM t GROUP BY ALL HAVING count(*) >= 3),
c AS (SELECT lang, source, term, sum(n)::HUGEINT AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS n FROM kept GROUP BY lang),
g AS (SELECT lang, source, coalesce(sum(c.n), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.n + v.v) AS p, 1 + (1000000000::HUGEINT * (total + 1)) // (v.n + v.v) AS q
      FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term)
QUALIFY part = 'pair' OR rank <= 200""",
}
