"""Case-report flow: raw quarter tables to cases, drugs and reactions, seriousness, coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewatch import constants as K
from casewatch.functions import cases as C
from casewatch.functions.text import contains_any
from casewatch.operators.dedupe import keep_first, latest_version, number_within
from casewatch.sources.columns import first_col


def _optional(df: DataFrame, name: str | None, kind: str = "string"):
    return F.col(name).cast(kind) if name and name in df.columns else F.lit(None).cast(kind)


def build_cases(demo: DataFrame) -> DataFrame:
    """One row per case: latest version, cleaned fields. Missing columns become nulls."""
    typed = demo.withColumns({
        "caseid": F.col("caseid").cast("string"),
        "caseversion": F.col("caseversion").try_cast("int"),
    }).where(F.col("caseid").isNotNull() & (F.col("caseid") != ""))
    date = first_col(demo, K.DATE_COLUMNS)
    country = first_col(demo, K.COUNTRY_COLUMNS)
    aged = "age" in demo.columns and "age_cod" in demo.columns
    cleaned = typed.select(
        "caseid", "caseversion",
        (C.age_years(F.col("age"), F.col("age_cod")) if aged else F.lit(None).cast("double")).alias("age_years"),
        C.sex_code(_optional(demo, "sex")).alias("sex"),
        (C.report_date(F.col(date)) if date else F.lit(None).cast("date")).alias("report_date"),
        _optional(demo, country).alias("country"),
        C.serious_flag(_optional(demo, "serious")).alias("serious"),
    )
    return latest_version(cleaned)


def build_drugs(
    drug: DataFrame, cases: DataFrame, targets: Sequence[str] = K.TARGET_DRUGS,
    roles: Sequence[str] | None = None,
) -> DataFrame:
    """Drug rows of known cases whose name holds a target word; one per (case, sequence).

    All roles count unless ``roles`` narrows them. Names not yet normalised are null.
    """
    ingredient = first_col(drug, ["prod_ai"])
    name = first_col(drug, ["drugname"])
    if not (ingredient or name):
        raise ValueError(f"neither prod_ai nor drugname among {drug.columns}")
    raw = C.raw_drug_name(
        F.col(ingredient) if ingredient else None, F.col(name) if name else None
    ).cast("string")
    rows = drug.select(
        F.col("caseid").cast("string").alias("caseid"),
        F.col("drug_seq").try_cast("int").alias("drug_seq"), raw.alias("drugname_raw"),
        F.lit(None).cast("string").alias("drugname_norm"),
        F.lit(None).cast("string").alias("rxnorm_rxcui"), _optional(drug, "role_cod").alias("role_cod"),
    ).where(contains_any(F.col("drugname_raw"), targets))
    if roles is not None:
        rows = rows.where(F.col("role_cod").isin(list(roles)))
    return keep_first(rows, ["caseid", "drug_seq"]).join(cases.select("caseid"), "caseid", "left_semi")


def build_reactions(reac: DataFrame, cases: DataFrame) -> DataFrame:
    """Distinct terms per known case, numbered from 1 in term order."""
    terms = reac.select(
        F.col("caseid").cast("string").alias("caseid"), F.trim("pt").alias("pt_name")
    ).distinct()
    known = terms.join(cases.select("caseid"), "caseid", "left_semi")
    return number_within(known, "caseid", "pt_name", "reac_seq").select("caseid", "reac_seq", "pt_name")


def case_seriousness(
    outcomes: DataFrame, codes: Sequence[str] = K.SERIOUS_OUTCOMES
) -> DataFrame:
    """(caseid, is_serious) for every case with outcome rows; a null code is not serious."""
    code = F.upper(F.trim("outc_cod"))
    hit = F.coalesce(code.isin(list(codes)), F.lit(False))
    return outcomes.groupBy("caseid").agg(F.bool_or(hit).alias("is_serious"))


def apply_seriousness(cases: DataFrame, seriousness: DataFrame) -> DataFrame:
    """Write the flag to the cases; a case without outcome rows keeps what it had."""
    return (
        cases.join(seriousness, "caseid", "left")
        .withColumn("serious", F.coalesce("is_serious", "serious")).select(*cases.columns)
    )


def seriousness_distribution(cases: DataFrame) -> DataFrame:
    return cases.groupBy("serious").agg(F.count(F.lit(1)).alias("n"))


def coverage(cases: DataFrame, drugs: DataFrame, reactions: DataFrame) -> DataFrame:
    """Cases, cases with drugs and with reactions, and record totals.

    ``total_drug_records`` and ``total_reaction_records`` count the rows of cases joined to
    both tables, where each drug row appears once per reaction row and the other way
    round. They come from per-case counts, so the join is never expanded. ``drug_rows``
    and ``reaction_rows`` are the plain counts.
    """
    def per_case(df: DataFrame, out: str) -> DataFrame:
        return df.where(F.col("caseid").isNotNull()).groupBy("caseid").agg(F.count(F.lit(1)).alias(out))

    counts = (
        cases.select("caseid").distinct()
        .join(per_case(drugs, "d"), "caseid", "left").join(per_case(reactions, "r"), "caseid", "left")
    )
    d, r = F.coalesce("d", F.lit(0)), F.coalesce("r", F.lit(0))
    one = F.lit(1)

    def total(value):
        return F.coalesce(F.sum(value), F.lit(0)).cast("long")

    return counts.agg(
        F.count(one).alias("total_cases"), F.count("d").alias("cases_with_drugs"),
        F.count("r").alias("cases_with_reactions"),
        total(d * F.greatest(r, one)).alias("total_drug_records"),
        total(r * F.greatest(d, one)).alias("total_reaction_records"),
        total(d).alias("drug_rows"), total(r).alias("reaction_rows"),
    )


def require_rows(counts: DataFrame, column: str = "total_cases", least: int = K.MIN_INGESTED_CASES) -> None:
    """Fail unless a one-row report shows at least ``least``."""
    n = counts.select(column).first()[0]
    if n < least:
        raise ValueError(f"only {n} in {column}, expected at least {least}")
