"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

Documents that a quality rule rejects go; lines that other documents hold first go; one document of
each near-duplicate group stays; documents that repeat a benchmark item go; every document left gets the
rate at which the domains meet their target weights.

Each stage keeps the columns of documents (the last one adds its own) and defines its results for null ids and texts,
empty and very long texts, ties, repeated rows and empty tables as its operator does; a document whose text
has become empty is one with an empty text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelrow.llm import decontamination, line_dedup, mixing, quality_rules, simhash_dedup
from keelrow.session import scratch_path

# bits of 64 in which the fingerprints of near-duplicates may differ
NEAR_BITS = 8


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs, _table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # the number of characters follows the text
    left = line_dedup.drop_repeated_lines(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    return left.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # five words and a similarity of 0.8, verified; at 0.8 two fingerprints differ in about 10 bits, at 0.95 in about 5
    return simhash_dedup.drop_near_duplicates(docs, radius=NEAR_BITS, width=5, similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_leaking(docs, _table(spark, sf_dir, "benchmark"))


def weigh(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, _table(spark, sf_dir, "labels"))


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing to target weights", weigh),
]

# the classifier and the descent of the last stage cannot be said in SQL: the tests follow them by brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
