"""From raw documents to token ids: quality rules, exact dedup, near-dedup, source mixing, byte-level BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from partloom.llm import bpe, exact_dedup, mixing, near_dedup, quality
from partloom.llm._common import documents, new_folder, remove_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    return quality.keep_good(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 or more, directly or through others, the one with the least doc_id stays."""
    return near_dedup.keep_one_of_each(docs, numerator=80, denominator=100)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources take part by weight; a document comes as often as the mix takes it."""
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256, decoded_sha256 of each document of the mix."""
    return bpe.encode_decode(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("near-dedup", near_copies),
    ("source mixing", source_mix),
    ("byte-level BPE", token_ids),
]

#: Near-duplicate groups, the mix's seeded order and BPE can't be expressed in SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; each but the last is written to the shared folder and read again, as later stages read their input several times. What the next stage's output replaces is removed."""
    docs, folder = documents(spark, sf_dir), new_folder(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            remove_folder(spark, f"{folder}/{i - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
