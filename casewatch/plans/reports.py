"""Reports over stored tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewatch import constants as K


def _rows():
    return F.count(F.lit(1))


def signal_summary(signals: DataFrame) -> DataFrame:
    return signals.agg(
        _rows().alias("total_pairs"), F.count_if("is_signal").alias("signals"),
        F.count_if("masking_warning").alias("masking"),
    )


def signals_per_drug(signals: DataFrame) -> DataFrame:
    return signals.groupBy("drug").agg(
        _rows().alias("pairs"), F.count_if("is_signal").alias("signals")
    )


def top_signals(signals: DataFrame, n: int = 20) -> DataFrame:
    return (
        signals.where("is_signal").orderBy(F.col("prr").desc(), "drug", "reaction").limit(n)
        .select("drug", "reaction", "prr", "ror", "n_cases")
    )


def _shown(signals: DataFrame, drugs: Sequence[str], min_prr: float, only_signals: bool) -> DataFrame:
    kept = signals.where(F.col("drug").isin(list(drugs)) & (F.col("prr") >= min_prr))
    return kept.where("is_signal") if only_signals else kept


def filter_signals(
    signals: DataFrame, drugs: Sequence[str], min_prr: float = K.MIN_PRR, only_signals: bool = True
) -> DataFrame:
    """Signals of chosen drugs from a PRR upwards, strongest first."""
    shown = _shown(signals, drugs, min_prr, only_signals)
    return shown.select("drug", "reaction", "prr", "n_cases", "is_signal", "masking_warning").orderBy(
        F.col("prr").desc(), "drug", "reaction"
    )


def heatmap(
    signals: DataFrame, drugs: Sequence[str], min_prr: float = K.MIN_PRR, top_n: int = 20,
    only_signals: bool = True,
) -> DataFrame:
    """Largest PRR by reaction (rows) and drug (columns) for the most reported reactions.

    The drug list is given, so no pass is needed to find the columns. One grouping by
    reaction gives the cells and the weight the top is taken by. Cells without a pair are
    0, as is the whole column of a drug with no row left.
    """
    cells = [
        F.coalesce(F.max(F.when(F.col("drug") == d, F.col("prr"))), F.lit(0.0)).alias(d) for d in drugs
    ]
    rows = _shown(signals, drugs, min_prr, only_signals).groupBy("reaction").agg(
        F.sum("n_cases").alias("_n"), *cells
    )
    return rows.orderBy(F.col("_n").desc(), "reaction").limit(top_n).drop("_n")


def controls(
    signals: DataFrame, pairs: Sequence[tuple[str, str]] = K.POSITIVE_CONTROLS,
    optional: Sequence[str] = K.OPTIONAL_CONTROLS, min_prr: float = K.MIN_PRR, any_case: bool = False,
) -> DataFrame:
    """Known pairs looked up: ``status`` judges by PRR, ``signal_status`` by the signal decision.

    The pairs are an argument, so their broadcast is as small as that list; it leaves only
    the matching signals for the outer join.
    """
    spark = signals.sparkSession
    fold = F.lower if any_case else F.col
    known = spark.createDataFrame(list(pairs), "drug string, reaction string").withColumns(
        {"_d": fold("drug"), "_r": fold("reaction")}
    )
    stored = signals.select(
        fold("drug").alias("_d"), fold("reaction").alias("_r"),
        "prr", "ror", "chi2", "n_cases", "is_signal", "masking_warning",
    ).join(F.broadcast(known.select("_d", "_r")), ["_d", "_r"], "left_semi")
    found = F.col("prr").isNotNull()
    status = (
        F.when(~found, "NOT FOUND").when(F.col("prr") >= min_prr, "PASS")
        .when(F.col("drug").isin(list(optional)), "WEAK").otherwise("FAIL")
    )
    flag = F.coalesce("is_signal", F.lit(False))
    return known.join(stored, ["_d", "_r"], "left").select(
        "drug", "reaction", "prr", "ror", "chi2", "n_cases", flag.alias("is_signal"),
        "masking_warning", found.alias("found"), status.alias("status"),
        F.when(flag, "PASS").otherwise("FAIL").alias("signal_status"),
    )


def controls_pass(checked: DataFrame, optional: Sequence[str] = K.OPTIONAL_CONTROLS) -> bool:
    """False if a control other than the optional ones fails; a pair not found does not fail."""
    bad = checked.where((F.col("status") == "FAIL") & ~F.col("drug").isin(list(optional)))
    return bad.isEmpty()


def normalisation_coverage(drugs: DataFrame) -> DataFrame:
    return drugs.agg(
        _rows().alias("total_drugs"), F.count("drugname_norm").alias("normalized"),
        F.round(F.count("drugname_norm") * 100.0 / _rows(), 1).alias("pct_normalized"),
    )


def variant_collapse(drugs: DataFrame, chosen: Sequence[str] = K.COLLAPSE_DRUGS, n: int = 20) -> DataFrame:
    return (
        drugs.where(F.col("drugname_norm").isin(list(chosen)))
        .groupBy("drugname_raw", "drugname_norm").agg(_rows().alias("n"))
        .orderBy(F.col("n").desc(), "drugname_raw", "drugname_norm").limit(n)
    )


def top_drugs(drugs: DataFrame, n: int = 15) -> DataFrame:
    return (
        drugs.where(F.col("drugname_norm").isNotNull()).groupBy("drugname_norm")
        .agg(_rows().alias("n")).orderBy(F.col("n").desc(), "drugname_norm").limit(n)
    )


def latency_stats(
    results: DataFrame, stages: Sequence[str] = ("extract", "map_terms", "signal_check"), digits: int = 6
) -> DataFrame:
    """Mean and largest latency per stage, over results that have the first stage's latency."""
    timed = results.where(F.col(f"{stages[0]}_latency_ms").isNotNull())
    return timed.agg(
        *[F.round(F.avg(f"{s}_latency_ms"), digits).alias(f"avg_{s}") for s in stages],
        *[F.max(f"{s}_latency_ms").alias(f"max_{s}") for s in stages],
    )


def confidence_histogram(
    results: DataFrame, column: str = "extraction_confidence", bins: int = 20
) -> DataFrame:
    """Results per equal-width bin of [0, 1]; 1.0 falls in the last bin. Bins count from 1."""
    spot = F.least(F.width_bucket(F.col(column), F.lit(0.0), F.lit(1.0), F.lit(bins)), F.lit(bins))
    return (
        results.where(F.col(column).isNotNull()).groupBy(spot.cast("int").alias("bin"))
        .agg(_rows().alias("n"))
        .select("bin", F.round((F.col("bin") - 1) / F.lit(bins), 4).alias("low"), "n")
    )


def flag_distribution(results: DataFrame) -> DataFrame:
    return results.groupBy("signal_flag").agg(_rows().alias("n"))


def recent_results(
    results: DataFrame, n: int = 200, flag: str | None = None, by: str = "processed_at"
) -> DataFrame:
    """The ``n`` latest results; a flag filter applies to those, as a page shows them."""
    latest = results.orderBy(F.col(by).desc(), "review_id").limit(n)
    return latest if flag is None else latest.where(F.col("signal_flag") == flag)


def result_detail(results: DataFrame, reviews: DataFrame) -> DataFrame:
    """Results with the review text."""
    return results.join(reviews.select("review_id", "review_text"), "review_id")


def run_summary(results: DataFrame, min_confidence: float = K.MIN_CONFIDENCE) -> DataFrame:
    """Counts of a batch run: confident, flagged, cached, mapped, per signal flag."""
    flag = F.coalesce("signal_flag", F.lit("noise"))
    cached = F.exists("agent_trace", lambda t: t.contains("cached=True"))
    return results.agg(
        _rows().alias("n"), F.count_if(F.col("extraction_confidence") >= min_confidence).alias("confident"),
        F.count_if("needs_human_review").alias("human_flagged"),
        F.count_if(~F.col("needs_human_review")).alias("mapped"), F.count_if(cached).alias("cached"),
        *[F.count_if(flag == f).alias(f"flag_{f}") for f in K.SIGNAL_FLAGS],
        F.count_if(flag != "noise").alias("with_signals"),
    )


def trace_steps(results: DataFrame, id_col: str = "review_id") -> DataFrame:
    """One row per trace entry: step number from 1, stage name, entry."""
    return results.select(id_col, F.posexplode("agent_trace").alias("_pos", "entry")).select(
        id_col, (F.col("_pos") + 1).alias("step"), F.substring_index("entry", ":", 1).alias("stage"), "entry"
    )
