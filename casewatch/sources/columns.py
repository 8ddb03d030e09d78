"""Choosing among alternative column names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def first_col(df: DataFrame, names: Sequence[str], required: bool = False) -> str | None:
    """The first of ``names`` the frame has; a choice per table, not per row."""
    for name in names:
        if name in df.columns:
            return name
    if required:
        raise ValueError(f"none of {list(names)} among {df.columns}")
    return None
