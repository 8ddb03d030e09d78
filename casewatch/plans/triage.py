"""Triage flow: raw model outputs to confidence, route, mapped terms, signals and flag.

Attempts are rows, not a loop: a report is decided by the first of its attempts that is
confident enough, goes to human review when the last allowed attempt is not, and waits
while attempts are missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewatch import constants as K
from casewatch.functions.parsing import parse_outputs
from casewatch.functions.scoring import extraction_confidence, signal_flag
from casewatch.operators.dedupe import keep_first
from casewatch.operators.lookup import map_terms, signal_lookup
from casewatch.operators.names import Vocabulary, known_drug_count

RESULT_COLUMNS = [
    "review_id", "drug_norm", "extracted_drugs", "extracted_reactions", "meddra_pts",
    "mapping_scores", "prr_signals", "severity", "extraction_confidence", "signal_flag",
    "needs_human_review", "agent_trace",
]
SIGNAL_TYPE = (
    "array<struct<drug:string,reaction:string,prr:double,ror:double,chi2:double,"
    "n_cases:bigint,masking_warning:boolean>>"
)


def score_outputs(
    outputs: DataFrame, vocabulary: Vocabulary = K.DRUG_KEYWORDS, raw: str = "raw"
) -> DataFrame:
    """Parse raw outputs and rate them: adds drugs, reactions, severity, method, confidence.

    The vocabulary part of the confidence is an expression over the drug array; nothing is
    exploded or regrouped.
    """
    read = parse_outputs(outputs, raw, "_out")
    none = F.array().cast("array<string>")
    parts = read.select(
        *outputs.columns, F.col("_out").isNotNull().alias("parsed"),
        F.coalesce("_out.drugs", none).alias("drugs"),
        F.coalesce("_out.reactions", none).alias("reactions"),
        F.col("_out.severity").alias("_severity"), F.coalesce("_out.method", F.lit("failed")).alias("method"),
    )
    confidence = extraction_confidence(
        F.col("parsed"), F.col("drugs"), F.col("reactions"), F.col("_severity"),
        known_drug_count(F.col("drugs"), vocabulary),
    )
    return parts.select(
        *outputs.columns, "parsed", "drugs", "reactions",
        F.coalesce("_severity", F.lit("unknown")).alias("severity"), "method",
        confidence.alias("confidence"),
    )


def _attempt_trace(t: Column) -> Column:
    """The two entries one attempt leaves: extraction and validation."""
    stage = F.when(t["attempt"] > 1, "EXTRACTION_RETRY").otherwise("EXTRACTION")
    named = F.array_join(F.slice(t["drugs"], 1, 3), ",")
    cached = F.coalesce(t["cached"], F.lit(False))
    drugs = (
        F.when(~t["parsed"] | (cached & (named == "")), "none").otherwise(named)
    )
    number, conf = t["attempt"].cast("string"), t["confidence"].cast("string")
    return F.array(
        F.concat(stage, F.lit(":"), number, F.when(cached, ",cached=True").otherwise(""),
                 F.lit(",conf="), conf, F.lit(",drugs="), drugs),
        F.concat(F.lit("VALIDATION:conf="), conf, F.lit(",retries="), number),
    )


def route_attempts(
    scored: DataFrame, id_col: str = "report_id", min_confidence: float = K.MIN_CONFIDENCE,
    max_attempts: int = K.MAX_ATTEMPTS,
) -> DataFrame:
    """One row per report: route (map_terms, flag_human, extract), deciding attempt, trace.

    An attempt counts only once all earlier numbers are there, so the decision does not depend on
    the order of arrival; a report that lacks its first attempt waits with null fields. Attempts beyond the allowed number do not count and one row per attempt number is kept,
    so a report never gathers more than ``max_attempts`` rows.
    """
    allowed = scored.where(F.col("attempt").between(1, max_attempts))
    extra = {"cached": F.lit(False), "drug_norm": F.lit(None).cast("string")}
    allowed = allowed.withColumns({c: v for c, v in extra.items() if c not in allowed.columns})
    fields = [
        "attempt", "confidence", "drugs", "reactions", "severity", "drug_norm", "parsed", "cached",
    ]
    one_each = keep_first(allowed.select(id_col, *fields), [id_col, "attempt"])
    tries = one_each.groupBy(id_col).agg(
        F.sort_array(F.collect_list(F.struct(*fields))).alias("_tries")
    ).withColumn("_tries", F.filter("_tries", lambda t, i: t["attempt"] == i + 1))
    passed = F.filter("_tries", lambda t: t["confidence"] >= min_confidence)
    decided = tries.withColumn("_passed", F.get(passed, F.lit(0)))
    final = F.coalesce("_passed", F.get("_tries", F.size("_tries") - 1))
    decided = decided.withColumn("_final", final)
    used = F.filter("_tries", lambda t: t["attempt"] <= F.col("_final.attempt"))
    route = (
        F.when(F.col("_passed").isNotNull(), "map_terms")
        .when(F.size("_tries") >= max_attempts, "flag_human").otherwise("extract")
    )
    return decided.select(
        id_col, route.alias("route"), *(F.col(f"_final.{f}").alias(f) for f in fields[:6]),
        F.flatten(F.transform(used, _attempt_trace)).alias("agent_trace"),
    )


def triage(
    outputs: DataFrame, term_map: DataFrame, signals: DataFrame,
    vocabulary: Vocabulary = K.DRUG_KEYWORDS, id_col: str = "report_id",
    min_confidence: float = K.MIN_CONFIDENCE, max_attempts: int = K.MAX_ATTEMPTS,
) -> DataFrame:
    """Decided reports as result rows; reports that still wait for attempts are left out.

    ``outputs`` has (id, attempt, raw) and may have drug_norm and cached. Flagged reports
    keep their last extraction, have empty lists for terms, scores and signals, and no
    signal flag.
    """
    routed = route_attempts(
        score_outputs(outputs, vocabulary), id_col, min_confidence, max_attempts
    ).where("route != 'extract'")
    flagged = F.col("route") == "flag_human"
    # flagged reports are not mapped: their lists stay empty through both joins
    none = F.array().cast("array<string>")
    ready = routed.withColumn("_reactions", F.when(flagged, none).otherwise(F.col("reactions")))
    terms = map_terms(ready, term_map, id_col, "_reactions")
    found = signal_lookup(terms, signals, id_col)

    prrs = F.col("prr_signals.prr")
    flag = signal_flag(prrs)
    any_input = (F.size("drugs") > 0) & (F.size("meddra_pts") > 0)
    map_entry = F.when(
        F.size("reactions") > 0,
        F.concat(
            F.lit("MAPPING:reactions="), F.size("reactions").cast("string"), F.lit(",top_pt="),
            F.get("meddra_pts", F.lit(0)), F.lit(",top_score="),
            F.get("mapping_scores", F.lit(0)).cast("string"),
        ),
    ).otherwise("MAPPING:no_reactions_to_map")
    check_entry = F.when(
        any_input,
        F.format_string(
            "SIGNAL_CHECK:signals=%d,flag=%s,top_prr=%.2f", F.size(prrs), flag,
            F.coalesce(F.array_max(prrs), F.lit(0.0)),
        ),
    ).otherwise("SIGNAL_CHECK:no_input,flag=noise")
    tail = F.when(flagged, F.array(F.lit("HUMAN_FLAG:reason=low_confidence"))).otherwise(
        F.array(map_entry, check_entry)
    )
    return found.select(
        F.col(id_col).alias("review_id"), "drug_norm", F.col("drugs").alias("extracted_drugs"),
        F.col("reactions").alias("extracted_reactions"), "meddra_pts", "mapping_scores",
        "prr_signals", "severity", F.col("confidence").alias("extraction_confidence"),
        F.when(~flagged, flag).alias("signal_flag"), flagged.alias("needs_human_review"),
        F.concat("agent_trace", tail).alias("agent_trace"),
    )


def as_json(results: DataFrame) -> DataFrame:
    """Results with their lists as JSON text, the form other tools exchange."""
    lists = ["extracted_drugs", "extracted_reactions", "meddra_pts", "mapping_scores", "prr_signals", "agent_trace"]
    return results.withColumns({c: F.to_json(c) for c in lists})


def from_json_text(results: DataFrame) -> DataFrame:
    """The reverse of ``as_json``; null text gives an empty list."""
    kinds = {
        "extracted_drugs": "array<string>", "extracted_reactions": "array<string>",
        "meddra_pts": "array<string>", "mapping_scores": "array<double>", "prr_signals": SIGNAL_TYPE,
        "agent_trace": "array<string>",
    }
    return results.withColumns(
        {c: F.from_json(F.coalesce(c, F.lit("[]")), kind) for c, kind in kinds.items()}
    )
