"""Join keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def spread_nulls(key: Column, *others: str) -> Column:
    """A string key for the outer side of a join, with nulls replaced by keys of their own.

    Null keys match nothing, but a shuffle sends them all to one task. The stand-in starts
    with a NUL character, which no real key does, and differs with the other columns.
    """
    own = F.concat(F.lit("\u0000"), F.xxhash64(*others).cast("string"))
    return F.coalesce(key, own)
