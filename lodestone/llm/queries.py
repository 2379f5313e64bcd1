"""One query for each operator, with its production parameters, over whole tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, fingerprint, mixing, packing, pii, rules, secrets, simhash, tokencount, toxicity
from .shared import documents

#: Where the vocabulary file of the public tokenizer lies; a parameter, never copied.
VOCABULARY = "word_bpe_49k.json"


def vocabulary() -> str:
    if at := os.environ.get("LODESTONE_VOCABULARY"):
        return at
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


#: Key of the synthetic tables' pseudonyms, used where the session names none; it protects nothing.
EXAMPLE_KEY = "key for synthetic tables only"


def key(spark: SparkSession) -> bytes:
    """The session's secret, spark.lodestone.pii.key."""
    return spark.conf.get("spark.lodestone.pii.key", EXAMPLE_KEY).encode()


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edits(documents(spark, sf_dir))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir), vocabulary())


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.counts(documents(spark, sf_dir), vocabulary())


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.spans(documents(spark, sf_dir)))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rendered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.planned(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return rows.select("_row.doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), mixing.taken().alias("taken"), mixing.shards_of().alias("shards"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.verdicts(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return pii.pseudonymised(docs, key(spark), count="n_values").select("doc_id", "text", "n_values")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = toxicity.scored(docs, toxicity.model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score", predicted, "spans")


QUERIES = {
    f.__name__: f
    for f in (op1_fingerprints, op2_secret_scan, op3_best_fit_packing, op4_chat, op5_token_counts, op6_source_mix, op7_quality_rules, op8_pii, op9_toxicity, op10_simhash)
}
#: SQL where it can say the whole query; the others are tested against brute force in tests/llm.
ORACLES: dict[str, str] = {"op4_chat": chat.ORACLE, "op7_quality_rules": rules.oracle()}
