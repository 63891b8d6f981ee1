"""The corpus pipeline: STAGES over documents, each written as Parquet and reread as the next one's input.

Language ID, toxicity, SimHash near-dedup, suffix-array dedup, packing. Every stage takes (spark, docs, sf_dir) and
works on all that the stage before kept; all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import langid, packing, simhash, suffix_dedup, toxicity
from tessera.llm.common import checkpoint_dir, cut, held_out, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_LANGUAGE_SCORE = 0.4


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty texts too) and those whose language stays in doubt."""
    model = langid.train(docs.filter(~held_out()))
    found = langid.identify(docs.select(*COLUMNS), model, keep=COLUMNS)
    return found.filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*COLUMNS)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the model calls toxic; it learns from the labels of those at hand."""
    labels = table(spark, sf_dir, "labels")
    model = toxicity.train(docs.filter(~held_out()), labels.filter(~held_out()))
    return toxicity.rate_documents(docs.select(*COLUMNS), model, keep=COLUMNS).filter("predicted = 0").select(*COLUMNS)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-copies (five-word shingles, similarity 0.8) the document with the smallest doc_id stays.

    A row is known by its doc_id and its text, so rows that share an id, or have none, are judged by their own text; of
    rows that repeat both, one stays.
    """
    groups = cut(simhash.similar_groups(docs, words=5, similarity=0.8))
    key = ["doc_id", "text_hash"]
    gone = groups.filter(~F.col("kept")).select(*key).distinct()
    again = groups.filter("kept").groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").select(*key)
    named = docs.select(*COLUMNS, F.xxhash64("text").alias("text_hash"))
    left = without(named, gone, key)
    if not again.isEmpty():
        twice = left.join(again.withColumnsRenamed({k: f"again_{k}" for k in key}), (F.col("doc_id").eqNullSafe(F.col("again_doc_id"))) & (F.col("text_hash") == F.col("again_text_hash")), "left_semi")
        left = without(left, again, key).unionByName(twice.dropDuplicates(key))
    return left.select(*COLUMNS)


def without(rows: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """The rows whose key is not in another table; null ids are alike."""
    other = gone.withColumnsRenamed({k: f"gone_{k}" for k in key})
    return rows.join(other, F.col("doc_id").eqNullSafe(F.col("gone_doc_id")) & (F.col("text_hash") == F.col("gone_text_hash")), "left_anti")


def no_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the 50-byte strings that a document with a smaller doc_id has too; characters cut in two go whole.

    Every document stays, with an empty text if nothing is left of it.
    """
    kept = suffix_dedup.remove_repeats(docs, length=50, keep=("lang", "source"), as_text=True)
    return kept.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into windows of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1, window=2048)


STAGES = [
    ("language_id", known_language),
    ("toxicity", not_toxic),
    ("simhash_near_dedup", no_near_copies),
    ("suffix_array_dedup", no_repeated_passages),
    ("packing", packed),
]

#: No stage of this pipeline is expressible in SQL: it is tested stage by stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, one after another, through Parquet in the shared folder.

    A stage's table is deleted once the next one's is written; the last one's stays, as the result is read from it.
    """
    docs = table(spark, sf_dir, "documents")
    base, before = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = f"{base}/{k}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                gone = spark._jvm.org.apache.hadoop.fs.Path(before)
                gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
            before = path
    return docs
