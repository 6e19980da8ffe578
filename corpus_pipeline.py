"""From raw documents to tokens: five stages, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents, and no others: extra columns are left behind. No stage fails at nulls in any column,
empty or very long texts, repeated rows or an empty table; what each does with them is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudloom.llm import bpe, decontamination, neardup, pii, quality, storage
from cloudloom.llm.queries import PII_KEY, table, vocabulary

#: Near copies are linked from a similarity of 0.8 on.
NEAR_PERCENT = 80
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts get the score of an empty text; repeated rows are judged alike; null doc_ids and other nulls don't matter.
    """
    return quality.keep_good(docs.select(COLUMNS), table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest doc_id.

    Null texts, and texts without words, are copies of nothing and stay; so do rows with a null doc_id. Rows that repeat a doc_id stay or go
    together.
    """
    return neardup.deduplicate(docs.select(COLUMNS), NEAR_PERCENT)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Null and empty texts hold none and stay; repeated rows are judged alike. Without items all documents stay.
    """
    found = decontamination.mark(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.where("not contaminated").select(COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by surrogates; n_chars follows the text where something is replaced.

    Null and empty texts stay as they are; equal entities get equal surrogates in all rows, repeated ones too.
    """
    found = pii.replace(docs.select(COLUMNS), PII_KEY)
    changed = F.when(F.col("n_entities") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", changed).select(COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document (little-endian unsigned 32-bit), and whether they decode to its text.

    Null texts count as empty and have no ids; one row for each input row, repeated ones too.
    """
    found = bpe.encode_decode(docs.select(COLUMNS), *vocabulary())
    same = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "utf-8")
    return found.select("doc_id", "lang", "source", (F.length("token_ids") / 4).cast("long").alias("n_tokens"), "token_ids", same.alias("round_trip"))


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII", pii_stage),
    ("byte-level BPE", token_stage),
]

#: SQL can't express the trained classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents of ``sf_dir``."""
    docs = before = table(spark, sf_dir, "documents")
    scratch = storage.Scratch(spark)
    for name, stage in STAGES:
        with storage.scope(spark) as kept:  # a stage's own scratch tables go with it
            docs = scratch.settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            kept.append(docs)
        if name != STAGES[0][0]:
            scratch.drop(before)
        before = docs
    return docs
