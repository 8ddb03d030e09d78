"""Disproportionality, confidence, flags and set scores as expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from casewatch import constants as K

# a*d and b*c are taken in exact decimals: in doubles their difference would lose digits
# as soon as the counts are large, and plain long products overflow.
WHOLE = "decimal(18,0)"


def disproportionality(
    pair: Column, drug: Column, reaction: Column, total: Column, *,
    min_cases: int = K.MIN_CASES, min_prr: float = K.MIN_PRR, min_chi2: float = K.MIN_CHI2,
    masking_share: float = K.MASKING_SHARE,
) -> dict[str, Column]:
    """Scores of one 2x2 table given the pair count, both margins and the total.

    Thresholds apply to the unrounded scores. ``scorable`` is false where the pair is too
    rare or a margin has nothing outside the pair; all other values are null there.
    """
    a, ab, ac, n = (c.cast(WHOLE) for c in (pair, drug, reaction, total))
    b, c = ab - a, ac - a
    d = n - a - b - c
    scorable = (a >= min_cases) & (b != 0) & (c != 0)
    gap = F.abs(a * d - b * c).cast("double")
    a, b, c, d, n = (x.cast("double") for x in (a, b, c, d, n))
    prr = (a / (a + b)) / (c / (c + d))
    ror = (a * d) / (b * c)
    spread = gap - n / 2
    chi2 = (n * (spread * spread)) / ((a + b) * (c + d) * (a + c) * (b + d))
    found = (prr >= min_prr) & (chi2 >= min_chi2)
    masked = (c + d) / n < masking_share
    return {
        "scorable": scorable,
        "prr": F.when(scorable, F.round(prr, 3)),
        "ror": F.when(scorable, F.round(ror, 3)),
        "chi2": F.when(scorable, F.round(chi2, 3)),
        "is_signal": F.when(scorable, found),
        "masking_warning": F.when(scorable, masked),
    }


def signal_flag(prrs: Column, high: float = K.HIGH_PRR, medium: float = K.MEDIUM_PRR) -> Column:
    """Flag from the largest PRR of an array; an empty array is noise."""
    top = F.array_max(prrs)
    return (
        F.when(top.isNull(), "noise").when(top >= high, "high")
        .when(top >= medium, "medium").otherwise("low")
    )


def extraction_confidence(
    parsed: Column, drugs: Column, reactions: Column, severity: Column, known_drugs: Column | None,
    severities: Sequence[str] = K.SEVERITIES,
) -> Column:
    """Confidence of one parsed output, 0 where nothing was parsed.

    0.40 for parsing, up to 0.35 for filled fields, up to 0.25 for the share of drugs that
    ``known_drugs`` (the count of names with a match) recognises; None leaves that part out.
    """
    filled = (
        F.coalesce((F.size(drugs) > 0).cast("int"), F.lit(0))
        + F.coalesce((F.size(reactions) > 0).cast("int"), F.lit(0))
        + F.coalesce(severity.isin(list(severities)).cast("int"), F.lit(0))
    )
    score = F.lit(0.40) + (filled / F.lit(3)) * F.lit(0.35)
    if known_drugs is not None:
        share = F.when(F.size(drugs) > 0, known_drugs / F.size(drugs)).otherwise(F.lit(0.0))
        score = score + share * F.lit(0.25)
    return F.when(parsed, F.round(score, 3)).otherwise(F.lit(0.0))


def label_set(values: Column) -> Column:
    """Array as a set: trimmed, lower-cased, blanks dropped."""
    cleaned = F.transform(values, lambda v: F.lower(F.trim(v)))
    return F.array_distinct(F.filter(cleaned, lambda v: v.isNotNull() & (v != "")))


def comma_list(text: Column) -> Column:
    """Comma-separated text as an array; null becomes an empty array."""
    return F.coalesce(F.split(text, ","), F.array().cast("array<string>"))


def set_f1(truth: Column, predicted: Column) -> Column:
    """F1 of two arrays compared as sets; both empty scores 1, one empty 0."""
    t, p = label_set(truth), label_set(predicted)
    nt, np = F.size(t), F.size(p)
    hits = F.size(F.array_intersect(t, p))
    precision, recall = hits / np, hits / nt
    return (
        F.when((nt == 0) & (np == 0), F.lit(1.0))
        .when((nt == 0) | (np == 0) | (hits == 0), F.lit(0.0))
        .otherwise(2 * (precision * recall) / (precision + recall))
    )
