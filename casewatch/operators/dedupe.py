"""Keep-first, numbering within a key, upsert."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewatch.operators.ranks import ranked
from casewatch.session import scratch

MOST_IN_A_TASK = 1_000_000  # rows of one key that a single task sorts


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """One row per key: the first by ``order``, then by all other columns.

    The full order makes the result repeatable. The ``= 1`` filter lets Spark keep one row
    per key and input partition before the shuffle, so a key with very many rows does not
    reach one task whole.
    """
    rest = [F.col(c).asc_nulls_last() for c in df.columns if c not in keys]
    window = Window.partitionBy(*keys).orderBy(*order, *rest)
    return (
        df.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") == 1).drop("_rank")
    )


def latest_version(df: DataFrame, key: str = "caseid", version: str = "caseversion") -> DataFrame:
    """The row with the highest version per key; a null version loses to any number."""
    return keep_first(df, [key], [F.col(version).desc_nulls_last()])


def number_within(df: DataFrame, key: str, term: str, out: str, most: int = MOST_IN_A_TASK) -> DataFrame:
    """Number the rows of each key from 1 in the order of ``term``.

    Terms must be unique within their key. Rows are stored once and counted by key. Keys of up to ``most`` rows meet
    whole; the rows of larger ones are range-partitioned by key and term and ranked by partition, so a key of any
    size spreads over tasks, whatever its terms look like.
    """
    path = scratch(df.sparkSession, "unnumbered")
    df.write.parquet(path)
    rows = df.sparkSession.read.schema(df.schema).parquet(path)
    order = [F.col(term).asc_nulls_first()]

    def whole(some: DataFrame) -> DataFrame:
        return some.select(*df.columns, F.row_number().over(Window.partitionBy(key).orderBy(*order)).alias(out))

    sizes = rows.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    listed = scratch(df.sparkSession, "large-keys")
    sizes.where(F.col("_n") > most).select("_key").write.parquet(listed)
    large = df.sparkSession.read.parquet(listed)
    if large.isEmpty():
        return whole(rows)
    same = F.col(key).eqNullSafe(F.col("_key"))
    rest = [c for c in df.columns if c != key]
    spread = ranked(rows.join(large, same, "left_semi"), key, order, *rest, out=out, name="numbered")
    return whole(rows.join(large, same, "left_anti")).unionByName(spread.select(*df.columns, F.col(out).cast("int")))


def upsert(base: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``base`` with the same key; ``new`` has unique keys."""
    kept = base.join(new.select(*keys), list(keys), "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)
