"""Review flow: raw review rows to cleaned, keyed and flagged reviews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewatch import constants as K
from casewatch.functions import text as X
from casewatch.operators.dedupe import keep_first
from casewatch.sources.columns import first_col

OUTPUT = [
    "review_id", "drug_name", "drug_norm", "condition", "review_text", "rating", "word_count",
    "source", "has_ae_mention",
]


def target_reviews(raw: DataFrame, targets: Sequence[str] = K.TARGET_DRUGS) -> DataFrame:
    """Rows whose drug name holds a target word; ``drug_norm`` is the first such word."""
    drug = first_col(raw, K.REVIEW_DRUG_COLUMNS, required=True)
    named = raw.withColumn("drug_norm", X.first_target(F.col(drug).cast("string"), targets))
    return named.where(F.col("drug_norm").isNotNull())


def readable_reviews(df: DataFrame, min_words: int = K.MIN_REVIEW_WORDS) -> DataFrame:
    """Cleaned text and word count; keeps text of more than ``min_words`` words.

    A plain filter would be pushed below the cleaning and repeat it for the condition, so
    each row makes a list of one cleaned entry, which the condition empties.
    """
    text = first_col(df, K.REVIEW_TEXT_COLUMNS, required=True)
    entries = F.transform(
        F.array(X.clean_html(F.col(text).cast("string"))),
        lambda t: F.struct(t.alias("review_text_clean"), X.word_count(t).alias("word_count")),
    )
    kept = F.filter(
        entries, lambda e: (e["review_text_clean"] != "") & (e["word_count"] > min_words)
    )
    return df.select("*", F.inline(kept))


def build_reviews(
    raw: DataFrame, targets: Sequence[str] = K.TARGET_DRUGS, stems: Sequence[str] = K.EVENT_STEMS,
    min_words: int = K.MIN_REVIEW_WORDS,
) -> DataFrame:
    """Filter to targets, clean, key, flag, one row per review id."""
    df = readable_reviews(target_reviews(raw, targets), min_words)
    drug = first_col(df, K.REVIEW_DRUG_COLUMNS, required=True)
    clean = F.col("review_text_clean")
    condition = F.col("condition").cast("string") if "condition" in df.columns else F.lit(None).cast("string")
    # whole numbers arrive as '9' or '9.0'
    rating = F.col("rating").try_cast("double").try_cast("int") if "rating" in df.columns else F.lit(None).cast("int")
    rows = df.select(
        X.review_id(F.col(drug).cast("string"), clean).alias("review_id"),
        F.col(drug).cast("string").alias("drug_name"), "drug_norm", condition.alias("condition"),
        clean.alias("review_text"), rating.alias("rating"), "word_count", "source",
        X.mentions_event(clean, stems).alias("has_ae_mention"),
    )
    return keep_first(rows, ["review_id"]).select(*OUTPUT)


def unprocessed(
    reviews: DataFrame, results: DataFrame, limit: int | None = None, only: DataFrame | None = None
) -> DataFrame:
    """Event-mentioning reviews without a result; ``only`` narrows to listed ids, ``limit`` takes the first by id."""
    todo = reviews.where("has_ae_mention").join(results.select("review_id"), "review_id", "left_anti")
    if only is not None:
        todo = todo.join(only.select("review_id"), "review_id", "left_semi")
    todo = todo.select("review_id", "review_text", "drug_norm", *[c for c in todo.columns if c == "_hash"])
    return todo if limit is None else todo.orderBy("review_id").limit(limit)


def review_distribution(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("drug_norm").agg(
        F.count(F.lit(1)).alias("total_reviews"), F.count_if("has_ae_mention").alias("ae_reviews")
    )


def mention_coverage(mentions: DataFrame) -> DataFrame:
    """Per label: mentions, and reviews with at least one.

    Mentions are first summed per (label, review), so no distinct count has to hold all
    reviews of a frequent label.
    """
    per_review = mentions.groupBy("entity_label", "review_id").agg(F.count(F.lit(1)).alias("n"))
    return per_review.groupBy("entity_label").agg(
        F.sum("n").alias("total_entities"), F.count(F.lit(1)).alias("reviews_covered")
    )
