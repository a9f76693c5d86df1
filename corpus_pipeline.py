"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept: rows whose language is rejected go, equal texts leave one row, near
duplicates leave one, personal data is replaced in the text, and what remains is
tokenised and packed.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import exact_dedup, language_id, near_dedup, packing, pii
from tracelake.llm.common import shared_path
from tracelake.llm.queries import vocabulary


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicate(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``n_chars`` follows the text where it was the text's length, or missing."""
    counted = docs.withColumn("n_chars", F.when(F.col("n_chars") != F.char_length("text"), F.col("n_chars")))
    redacted = pii.redact(counted)
    return redacted.withColumn("n_chars", F.coalesce(F.col("n_chars"), F.char_length("text").cast("long"))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.digests(docs, vocabulary())


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("pii", redact_personal_data),
    ("best_fit_packing", pack_sequences),
]

#: SQL can't express language identification and the trained span classifier; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
