"""Ranks and running totals that no task has to compute for a whole key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewatch.session import scratch

PARTITION_BITS = 33  # monotonically_increasing_id holds the partition above these bits, the row below


def placed(df: DataFrame, group: str, order: Sequence[Column], *keep: str | Column, name: str = "placed") -> DataFrame:
    """``group``, the columns ``keep`` and ``_place``, a number that follows the order (group, ``order``).

    Rows are range-partitioned and sorted locally, so a group of any size spreads over as many
    partitions as its share of the rows, and are stored once: what refers to ``_place`` later sees
    the same numbers even if tasks run again. Rows equal in ``group`` and ``order`` stay in one partition.
    """
    sorting = [F.col(group).asc_nulls_first(), *order]
    spread = df.repartitionByRange(*sorting).sortWithinPartitions(*sorting)
    path = scratch(df.sparkSession, name)
    spread.select(group, *keep, F.monotonically_increasing_id().alias("_place")).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def partition_of(place: str = "_place") -> Column:
    return F.shiftright(place, PARTITION_BITS)


def runs(rows: DataFrame, group: str) -> DataFrame:
    """What each partition of ``placed`` rows holds of a group: ``_part``, ``_first`` place and ``_before``, the group's rows in earlier partitions."""
    held = rows.groupBy(group, partition_of().alias("_part")).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return held.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")


def with_runs(rows: DataFrame, held: DataFrame, group: str) -> DataFrame:
    """``placed`` rows beside their run; a run lies in one partition, so no join key is larger than a partition."""
    held = held.withColumnRenamed(group, "_group")
    same = rows[group].eqNullSafe(F.col("_group")) & (partition_of() == F.col("_part"))
    return rows.join(held, same).drop("_group", "_part")


def ranked(df: DataFrame, group: str, order: Sequence[Column], *keep: str | Column, out: str = "rank", name: str = "placed") -> DataFrame:
    """``group``, ``keep`` and the row number ``out`` (from 1) within the group in ``order``; null is a group of its own."""
    rows = placed(df, group, order, *keep, name=name)
    rank = (F.col("_place") - F.col("_first") + F.col("_before") + 1).alias(out)
    return with_runs(rows, runs(rows, group), group).select(*[c for c in rows.columns if c != "_place"], rank)


def running_sums(df: DataFrame, at: str, n: int, values: Sequence[str], block: int = 4096) -> DataFrame:
    """``df`` with each of ``values`` replaced by its sum over all rows up to ``at``, which numbers the rows 0 to n - 1.

    Blocks of consecutive numbers are summed on their own; the totals of the blocks are summed the same
    way until one block is left.
    """
    if n <= block:
        upto = Window.orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({v: F.sum(v).over(upto) for v in values})
    own = f"{at}_block"
    blocked = df.withColumn(own, F.floor(F.col(at) / block).cast("long"))
    totals = blocked.groupBy(own).agg(*[F.sum(v).alias(v) for v in values])
    totals = running_sums(totals, own, -(-n // block), values, block)
    before = totals.select((F.col(own) + 1).alias(own), *[F.col(v).alias(f"_{v}") for v in values])
    inside = Window.partitionBy(own).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return (
        blocked.withColumns({v: F.sum(v).over(inside) for v in values}).join(before, own, "left")
        .withColumns({v: F.col(v) + F.coalesce(F.col(f"_{v}"), F.lit(0)) for v in values})
        .drop(own, *[f"_{v}" for v in values])
    )
