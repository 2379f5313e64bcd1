"""Corpus pipeline: quality rules, near-copies, personal data, source mix, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but the last return the
columns of documents; the mix repeats documents that it takes twice, and cuts the one in which a source's target ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import mixing, nearcopies, packing, pii, queries, rules


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return rules.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts at 5-word Jaccard similarity 0.8 or more stays: SimHash's links, verified,
    then an exact search for what these leave apart."""
    return nearcopies.representatives(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Validated values become pseudonyms."""
    return pii.pseudonymised(docs, queries.key(spark))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequences and offsets."""
    return packing.packed(docs, queries.vocabulary())


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("pii_pseudonyms", personal_data),
    ("source_mix", source_mix),
    ("best_fit_packing", pack),
]

#: Fingerprints, keyed permutations and packing aren't SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
