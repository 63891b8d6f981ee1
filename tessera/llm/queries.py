"""The queries of this subpackage's operators, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embeddings, langid, packing, quality, simhash, suffix_dedup, token_counts, toxicity, warc
from .common import held_out, table


TOKENIZER = "byte_bpe_50k.json"


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return counted.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).drop("edited")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)
    return found.select("vec_id", "n_links", "component_id", "kept")


def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    derived = warc.derive(warc.responses(table(spark, sf_dir, "pages")))
    return derived.withColumn("block_sha256", F.sha2(F.col("block").cast("binary"), 256)).drop("block")


def op5_quality_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), end_id=1, window=2048)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=50)
    return kept.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs.filter(~held_out()), labels.filter(~held_out()))
    scored = toxicity.rate_documents(docs, model, threshold=0.3)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.train(docs.filter(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


_QUERIES: list[Callable[[SparkSession, str], DataFrame]] = [op1_simhash, op2_token_counts, op3_embedding_dedup, op4_warc_derivatives, op5_quality_bands, op6_packing, op7_suffix_dedup, op8_bpe, op9_toxicity, op10_language_id]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


_EMBEDDING_SQL = """
WITH RECURSIVE usable AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS u, b.vec_id AS v FROM usable a JOIN usable b
      ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
    SELECT vec_id AS node, vec_id AS root FROM embeddings
    UNION SELECT links.v, reach.root FROM reach JOIN links ON links.u = reach.node
), counted AS (SELECT u, COUNT(*) AS n FROM links GROUP BY u),
lowest AS (SELECT node, MIN(root) AS root FROM reach GROUP BY node)
SELECT vec_id, CAST(COALESCE(n, 0) AS BIGINT) AS n_links, root AS component_id, vec_id = root AS kept
FROM embeddings JOIN lowest ON node = vec_id LEFT JOIN counted ON u = vec_id
"""


def oracle_sql() -> dict[str, str]:
    """SQL can express the embedding links; the tests compare the other queries with brute force."""
    return {"op3_embedding_dedup": _EMBEDDING_SQL}
