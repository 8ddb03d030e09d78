"""Evaluation of results against labels, and row checks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewatch import constants as K
from casewatch.functions.scoring import comma_list, set_f1


def scored_rows(
    labels: DataFrame, results: DataFrame, baseline: DataFrame | None = None
) -> DataFrame:
    """Labels joined to results with one F1 per row for drugs, reactions and baseline drugs.

    ``baseline`` (review_id, baseline_drugs) holds the drugs a dictionary or tagger found.
    """
    named = labels.where(F.col("drugs_gt").isNotNull() & (F.col("drugs_gt") != ""))
    joined = named.select("review_id", "drugs_gt", "reactions_gt", "severity_gt").join(
        results.select("review_id", "extracted_drugs", "extracted_reactions", "meddra_pts", "severity"),
        "review_id",
    )
    if baseline is not None:
        joined = joined.join(baseline.select("review_id", "baseline_drugs"), "review_id", "left")
        found = F.coalesce("baseline_drugs", F.array().cast("array<string>"))
        base = set_f1(comma_list(F.col("drugs_gt")), found)
    else:
        base = F.lit(0.0)
    same = F.lower(F.coalesce("severity_gt", F.lit("nan"))) == F.lower(F.coalesce("severity", F.lit("none")))
    return joined.select(
        "review_id", set_f1(comma_list(F.col("drugs_gt")), F.col("extracted_drugs")).alias("drug_f1"),
        set_f1(comma_list(F.col("reactions_gt")), F.col("extracted_reactions")).alias("reaction_f1"),
        base.alias("baseline_f1"), same.alias("severity_correct"),
        F.size("extracted_reactions").alias("n_reactions"), F.size("meddra_pts").alias("n_mapped"),
    )


def labelled(reviews: DataFrame, labels: DataFrame, results: DataFrame) -> DataFrame:
    """The reviews that ``scored_rows`` will rate: only these need a baseline tagger."""
    named = labels.where(F.col("drugs_gt").isNotNull() & (F.col("drugs_gt") != ""))
    for ids in (named, results):
        reviews = reviews.join(ids.select("review_id"), "review_id", "left_semi")
    return reviews


def evaluation(scored: DataFrame) -> DataFrame:
    """Macro averages over the scored rows as one row."""
    reactions, mapped = F.sum("n_reactions"), F.sum("n_mapped")
    return scored.agg(
        F.count(F.lit(1)).alias("n_evaluated"),
        F.round(F.avg("drug_f1"), 3).alias("drug_extraction_f1"),
        F.round(F.avg("reaction_f1"), 3).alias("reaction_extraction_f1"),
        F.round(F.avg(F.col("severity_correct").cast("int")), 3).alias("severity_accuracy"),
        F.round(F.when(reactions > 0, mapped / reactions).otherwise(0.0), 3).alias("meddra_mapping_accuracy"),
        F.round(F.avg("baseline_f1"), 3).alias("baseline_drug_f1"),
    )


def baseline_drugs(mentions: DataFrame, label: str = "CHEMICAL") -> DataFrame:
    """Distinct mentions of one label per review, as the baseline for drugs."""
    one_each = mentions.where(F.col("entity_label") == label).select(
        "review_id", F.lower("entity_text").alias("drug")
    ).distinct()
    return one_each.groupBy("review_id").agg(F.collect_set("drug").alias("baseline_drugs"))


def label_summary(labels: DataFrame) -> DataFrame:
    """Label rows per severity, with and without reactions."""
    empty = F.coalesce("reactions_gt", F.lit("")) == ""
    severity = F.coalesce("severity_gt", F.lit(""))
    return labels.agg(
        F.count(F.lit(1)).alias("n_labels"),
        *[F.count_if(severity == s).alias("n_" + s.replace("-", "_")) for s in K.SEVERITIES],
        F.count_if(~empty).alias("with_reactions"), F.count_if(empty).alias("without_reactions"),
    )


# Allowed values per record kind, as SQL conditions a valid row meets.
CHECKS = {
    "review": {
        "review_id": "review_id IS NOT NULL", "rating": "rating BETWEEN 1 AND 10",
        "word_count": "word_count >= 0", "drug_name": "drug_name IS NOT NULL",
        "review_text": "review_text IS NOT NULL",
    },
    "label": {
        "review_id": "review_id IS NOT NULL",
        "severity_gt": "severity_gt IN ('serious', 'non-serious', 'unknown')",
        "label_confidence": "label_confidence BETWEEN 0 AND 1",
    },
    "extraction": {
        "severity": "severity IN ('serious', 'non-serious', 'unknown')",
        "parse_method": "parse_method IN ('json', 'regex_fallback', 'failed')",
    },
    "result": {
        "signal_flag": "signal_flag IS NULL OR signal_flag IN ('high', 'medium', 'low', 'noise')",
        "extraction_confidence": "extraction_confidence BETWEEN 0 AND 1",
    },
    "metrics": {
        "precision": "precision BETWEEN 0 AND 1", "recall": "recall BETWEEN 0 AND 1",
        "f1": "f1 BETWEEN 0 AND 1",
    },
}
# Values of columns a row may leave out.
DEFAULTS = {
    "review": {"has_ae_mention": False},
    "label": {"labeled_by": "manual", "label_confidence": 1.0},
    "extraction": {"severity": "unknown", "raw_llm_output": "", "parse_method": "failed"},
    "result": {"needs_human_review": False},
    "metrics": {"support": 0, "entity_type": "drugs"},
}


def with_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Add missing columns and fill nulls with defaults."""
    def value(name: str, default) -> Column:
        return F.coalesce(name, F.lit(default)) if name in df.columns else F.lit(default)

    return df.withColumns({n: value(n, d) for n, d in defaults.items()})


def check_rows(df: DataFrame, checks: Mapping[str, str]) -> DataFrame:
    """Add ``broken``: the names of the checks a row fails; empty for a valid row."""
    failed = [F.when(~F.coalesce(F.expr(rule), F.lit(False)), F.lit(name)) for name, rule in checks.items()]
    return df.withColumn("broken", F.array_compact(F.array(*failed)))


def split_rows(df: DataFrame, checks: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected); the rejected rows keep ``broken``."""
    checked = check_rows(df, checks)
    return checked.where(F.size("broken") == 0).drop("broken"), checked.where(F.size("broken") > 0)
