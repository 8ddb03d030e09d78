"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewatch.llm.common import Shelf


def components(edges: DataFrame, shelf: Shelf | None = None) -> DataFrame:
    """``node``, ``root`` (the smallest node reachable) for every node of ``edges`` (a, b).

    Alternates large-star and small-star steps until the edges are a forest of stars, in about
    log(n) rounds. Minima are aggregated before each shuffle and hot nodes are split by the
    adaptive skew join; each round is a written table (on ``shelf``, one of its own if none is given) that
    replaces the one before, so no lineage grows and nothing is collected but whether the edges are
    stars. Loops and null ends are left out; no edges give no rows.
    """
    shelf = shelf or Shelf(edges.sparkSession, "components")
    now = shelf.put(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    while True:
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
            now.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
        )
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if ends.where("up > 1 OR (up = 1 AND down = 1)").isEmpty():  # every node has one edge up, to a root
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.greatest("v", "m").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
        before, now = now, shelf.put(small.where("u <> v").distinct(), "edges")
        shelf.drop(before)
