"""The corpus pipeline: documents through the stages below, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewatch.llm import contextual_pii, decontaminate, line_rules, pieces, signature_join
from casewatch.llm.common import free_prefix, row_key, stored, table
from casewatch.session import tune


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that many documents of a source share."""
    return line_rules.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id; a row that repeats a document stays once.

    A document is an id with a text: it goes into the search under a key of both, so of two texts under one id only
    the one that repeats another document leaves. A null id comes after all others; documents without words repeat
    nothing; empty tables give none; columns keep whatever names they have.
    """
    key = free_prefix(docs) + "row"
    keyed = docs.withColumn(key, row_key("doc_id", "text"))
    groups = signature_join.near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"))
    groups = groups.select(F.col("doc_id").alias(key), "component_id").distinct()
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(key).alias("key"))
    stays = groups.join(keyed.select(key, "doc_id").distinct(), key).groupBy("component_id").agg(F.min(order)["key"].alias(key))
    return keyed.join(stays, key, "left_semi").dropDuplicates([key]).select(*[F.col(f"`{c}`") for c in docs.columns])


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return contextual_pii.redacted(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every kept document, decoded again and compared."""
    return pieces.digest(docs)


STAGES = [
    ("quality rules", quality), ("near duplicates", near_duplicates), ("decontamination", benchmark_free),
    ("personal data", personal_data), ("sentencepiece", encode_pieces),
]
ORACLE_SQL = None  # similarity joins, alignment and Viterbi search are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = table(tune(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
