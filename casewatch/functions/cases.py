"""Expressions for case-report fields. Input columns are strings as read from the files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from casewatch.constants import AGE_UNITS, MAX_AGE_YEARS
from casewatch.functions.text import first_case


def age_years(
    age: Column, unit: Column, units: Sequence[tuple[str, float, float]] = AGE_UNITS,
    max_years: float = MAX_AGE_YEARS,
) -> Column:
    """Age in years; null for an unknown unit, a bad number or a value out of range."""
    number = age.try_cast("double")
    code = F.upper(unit)
    years = first_case((code == u, number * F.lit(m) / F.lit(d)) for u, m, d in units)
    return F.when((years >= 0) & (years <= max_years), years)


def report_date(text: Column) -> Column:
    """yyyymmdd text to a date, null where it is not one."""
    digits = F.trim(text)
    # cast of the ISO form: no formatter, and no exception per damaged date
    iso = F.concat_ws("-", *(F.substring(digits, *part) for part in ((1, 4), (5, 2), (7, 2))))
    return F.when(digits.rlike(r"^[0-9]{8}$"), iso.try_cast("date"))


def serious_flag(code: Column) -> Column:
    """'1' is true, '2' is false, anything else null."""
    mark = F.trim(code)
    return F.when(mark == "1", F.lit(True)).when(mark == "2", F.lit(False))


def sex_code(text: Column) -> Column:
    return F.trim(F.upper(text))


def raw_drug_name(ingredient: Column | None, name: Column | None) -> Column:
    """Active ingredient where given, else the free-text name."""
    if ingredient is None:
        return name
    if name is None:
        return ingredient
    return F.coalesce(F.nullif(ingredient, F.lit("")), name)
