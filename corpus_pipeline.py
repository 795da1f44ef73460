"""The corpus pipeline: five stages over ``documents``, each written as a table and read again by the next.

1. language: documents whose language is rejected go.
2. line dedup: lines that repeat an earlier document go; so do documents of which nothing is left.
3. near duplicates: of each group of documents that link, directly or not, one row stays: that with the least key (null is
   the last), then the least hash of its text, then the least of the other columns. Texts without words all stay.
4. decontamination: documents that hold a test item go.
5. tokens: ids of the texts, and the texts that these decode to.

Each stage but the last returns the columns of ``documents``; further columns, whatever their names, are left out at once.

Edge cases: a row with a null text has no language and goes first, and so do texts without letters, empty ones among them; a null
key stays a key, after all others where an order matters. Repeated rows (equal key and text) are one document to line dedup,
which gives all of them the same lines, and near-duplicate removal leaves one of them. Ties there go as said above. Very
long texts are taken whole in every stage. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioflow.llm import bpe, decontaminate, jaccard_join, language, line_dedup
from folioflow.store import Steps

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
VOCABULARY = "word_bpe_49k.json"
#: Near duplicates: shingles of five words, a similarity of 0.8.
SHINGLE, PERCENT = 5, 80
#: A text without this has no shingles and is a near duplicate of nothing.
WORD = r"[^\x20\x09-\x0D]"


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.fit(docs.where(~language.held_out()))
    return language.identify(docs.select(*COLUMNS), model).where(~F.col("lang_rejected")).select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = line_dedup.dedupe_lines(docs.select(*COLUMNS))
    left = found.where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    return left.select(*[F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in COLUMNS])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    stay = jaccard_join.leaders(docs, k=SHINGLE, percent=PERCENT).select(F.struct("no_key", "key", "version").alias("_own"))
    own = F.struct(F.col("doc_id").isNull().alias("no_key"), F.col("doc_id").alias("key"), F.xxhash64("text").alias("version"))
    some = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    # rows that repeat key and text become one before they are shuffled
    once = docs.where(some).groupBy(own.alias("_own")).agg(F.min(F.struct("doc_id", "lang", "source", "n_chars", "text")).alias("_row"))
    return once.join(stay, "_own", "left_semi").select("_row.*").select(*COLUMNS).unionByName(docs.where(~some))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(docs.select(*COLUMNS), VOCABULARY, decoded="decoded").withColumn("n_tokens", F.size("ids").cast("long"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language_stage),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("tokens", token_stage),
]

#: SQL can't express the centroids, the alignment or the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; every stage's result but the last is written to the shared folder, and goes when the
    next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    with Steps(spark) as steps:
        for name, stage in STAGES[:-1]:
            docs = steps.cut(stage(spark, docs, sf_dir), name)
            if before is not None:
                steps.drop(before)
            before = docs
        steps.keep(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
