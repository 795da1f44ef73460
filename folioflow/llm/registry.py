"""The registered queries of this subpackage: each applies one operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, byte_bpe, decontaminate, hard_negatives, hash_forest, jaccard_join, language, licenses, line_dedup, pii, prefix_trie, secrets, token_counts

VOCABULARY = "word_bpe_49k.json"
RANKS = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedupe_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_forest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_texts(table(spark, sf_dir, "documents"), VOCABULARY)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", language.held_out())
    model = language.fit(docs.where(~F.col("held_out")))
    found = language.identify(docs.select("doc_id", "text", "held_out"), model)
    return found.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), VOCABULARY)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents")).drop("version")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digest_texts(table(spark, sf_dir, "documents"), RANKS)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, h = prefix_trie.rule()
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"), base=base, h=h)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, hard_negatives.relabelled())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_hash_forest": op2_hash_forest,
        "op3_benchmark_leaks": op3_benchmark_leaks,
        "op4_personal_data": op4_personal_data,
        "op5_bpe_codec": op5_bpe_codec,
        "op6_language_id": op6_language_id,
        "op7_token_counts": op7_token_counts,
        "op8_secret_scan": op8_secret_scan,
        "op9_license_scan": op9_license_scan,
        "op10_jaccard_join": op10_jaccard_join,
        "op11_byte_bpe": op11_byte_bpe,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_hard_negatives": op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_benchmark_leaks": decontaminate.ORACLE,
        "op8_secret_scan": secrets.oracle(),
        "op9_license_scan": licenses.oracle(),
        "op10_jaccard_join": jaccard_join.ORACLE,
        "op12_prefix_trie": prefix_trie.ORACLE,
        "op13_hard_negatives": hard_negatives.ORACLE,
    }
