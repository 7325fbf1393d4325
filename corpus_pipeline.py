"""Corpus preparation: quality rules, near-duplicates, decontamination, personal data, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next stage's docs.
All stages but the last return the columns of documents; other columns stay as they are. Rows with a null doc_id are judged like
others. Near-duplicate removal tells rows by id and text: different texts under one id are judged apart, of rows with one id and
text one stays. Null and empty texts fail the quality rules; where a stage gets them, all of them are near-duplicates of each other
(one stays), they are never contaminated, they have no personal data and no tokens. Empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import bpe, decontaminate, pii, quality, simhash
from seqloom.llm.common import discarded, fresh_path, stored, table


#: Row keys (16 bytes each) that may be broadcast, so that the texts stay in place; with more, they are merged by key.
BROADCAST_KEYS = 500_000


def _small(keys: DataFrame) -> DataFrame:
    """``keys``, a stored table, to be broadcast if it has few rows, and else merged, whatever size Spark expects."""
    return F.broadcast(keys) if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else keys.hint("merge")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that pass the base rule and are no outliers of their language and source."""
    fitted = quality.estimates(stored(quality.counted(docs), "counts"))
    return quality.kept_documents(docs, fitted)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each component of near-duplicates: that with the smallest id (nulls last), then the smallest row key."""
    key = decontaminate.row_key(docs)
    groups = simhash.near_duplicates(docs.select(key.alias("doc_id"), "text")).select("doc_id", "component_id").distinct()
    ids = docs.select(key.alias("key"), F.col("doc_id").alias("id")).groupBy(F.col("key").alias("doc_id")).agg(F.min("id").alias("id"), F.count("*").alias("n"))
    ranked = groups.join(ids.hint("merge"), "doc_id").groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "doc_id", "n")).alias("best"))
    best = stored(ranked.select(F.col("best.doc_id").alias("key"), F.col("best.n").alias("n")), "best")
    left = docs.join(_small(best), key == best["key"], "left_semi")
    return left.dropDuplicates(["doc_id", "text"]) if best.where("n > 1").limit(1).count() else left


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop contaminated documents."""
    judged = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    gone = stored(judged.where("contaminated").select("key").distinct(), "contaminated")
    return docs.join(_small(gone), decontaminate.row_key(docs) == gone["key"], "left_anti")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts by the name of its kind."""
    return pii.masked(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    import public_tokenizers

    return bpe.digests(bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("quality", quality_rules), ("simhash", near_duplicates), ("decontamination", decontamination), ("pii", personal_data), ("bpe", tokens)]

#: SQL has neither robust estimates, XXH64 nor BPE; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(discarded(spark, path))
    return docs
