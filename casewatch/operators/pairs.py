"""Distinct-case counts and disproportionality of drug and reaction pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewatch import constants as K
from casewatch.functions.scoring import disproportionality
from casewatch.session import scratch
from casewatch.sources.sinks import replace_table

# A case with more terms than this on one side is cut into tiles of this size.
TILE_TERMS = 500


def case_terms(df: DataFrame, term: str, case: str = "caseid") -> DataFrame:
    """Distinct (case, term) rows with a term."""
    return df.where(F.col(term).isNotNull()).select(case, term).distinct()


def term_counts(terms: DataFrame, term: str, out: str) -> DataFrame:
    """Cases per term, from distinct (case, term) rows."""
    return terms.groupBy(term).agg(F.count(F.lit(1)).alias(out))


def large_cases(
    drugs: DataFrame, reactions: DataFrame, drug: str, reaction: str, case: str = "caseid", size: int = TILE_TERMS
) -> DataFrame | None:
    """All cases with more than ``size`` rows on a side, and the tiles per side they are cut into; None if there is none.

    Rows are counted as they come, repeats too: the list only decides how the work is split, so
    it may name too many cases but never too few. Cases go by a hash, which is small to shuffle; two
    cases of one hash cannot change the pairs either. The list is written, so that it joins by a known size.
    """
    key = F.xxhash64(case).alias("_case")
    sides = drugs.where(F.col(drug).isNotNull()).select(key, F.lit(1).alias("_d"), F.lit(0).alias("_r")).unionAll(
        reactions.where(F.col(reaction).isNotNull()).select(key, F.lit(0), F.lit(1))
    )
    counts = sides.groupBy("_case").agg(F.sum("_d").alias("_nd"), F.sum("_r").alias("_nr"))

    def tiles(n: str) -> Column:
        return F.greatest(F.ceil(F.col(n) / size), F.lit(1))

    found = counts.where(F.greatest("_nd", "_nr") > size).select(
        "_case", tiles("_nd").alias("_d_tiles"), tiles("_nr").alias("_r_tiles")
    )
    found = replace_table(found, scratch(drugs.sparkSession, "large_cases"))
    return None if found.isEmpty() else found


def co_occurrence(
    drugs: DataFrame, reactions: DataFrame, drug: str, reaction: str, case: str = "caseid",
    tile_terms: int | None = TILE_TERMS,
) -> DataFrame:
    """(drug, reaction) once per case that has both; repeated rows and rows without a term do not count.

    A case with k drugs and m reactions makes k*m pairs. Large cases are cut on both sides,
    and each (drug tile, reaction tile) joins on its own, so their pairs spread over tasks;
    all other cases have the one tile 0. Finding the large cases costs one count
    by case; where there is none, the sides are joined by case alone. None leaves the search out, for data
    whose cases are known to be small.
    """
    large = None if tile_terms is None else large_cases(drugs, reactions, drug, reaction, case, tile_terms)
    drugs, reactions = case_terms(drugs, drug, case), case_terms(reactions, reaction, case)
    if large is None:
        return drugs.join(reactions, case).select(drug, reaction)
    d_tiles, r_tiles = F.col("_d_tiles"), F.col("_r_tiles")

    def tiled(terms: DataFrame, term: str, numbers: Column) -> DataFrame:
        listed = terms.withColumn("_case", F.xxhash64(case)).join(large, "_case", "left")
        only = F.array(F.lit(0).cast("long"))
        return listed.select(
            case, term, F.explode(F.when(d_tiles.isNull(), only).otherwise(numbers)).alias("_tile")
        )

    # tile (i, j) has the number i * r_tiles + j: a drug is in all of its row, a reaction in
    # all of its column
    row = F.pmod(F.xxhash64(drug), d_tiles) * r_tiles
    left = tiled(drugs, drug, F.sequence(row, row + r_tiles - 1))
    column = F.pmod(F.xxhash64(reaction), r_tiles)
    right = tiled(
        reactions, reaction, F.sequence(column, column + (d_tiles - 1) * r_tiles, r_tiles)
    )
    return left.join(right, [case, "_tile"]).select(drug, reaction)


def marginals(
    cases: DataFrame, drugs: DataFrame, reactions: DataFrame, drug: str = "drugname_norm",
    reaction: str = "pt_name", case: str = "caseid",
) -> DataFrame:
    """Distinct cases in total, per drug and per reaction as rows (kind, term, n)."""
    total = cases.agg(F.count_distinct(case).alias("n")).select(
        F.lit("total").alias("kind"), F.lit(None).cast("string").alias("term"), "n"
    )

    def side(df: DataFrame, term: str, kind: str) -> DataFrame:
        counts = term_counts(case_terms(df, term, case), term, "n")
        return counts.select(F.lit(kind).alias("kind"), F.col(term).alias("term"), "n")

    return total.unionByName(side(drugs, drug, "drug")).unionByName(side(reactions, reaction, "reaction"))


def pair_counts(
    drugs: DataFrame, reactions: DataFrame, drug: str = "drugname_norm", reaction: str = "pt_name",
    case: str = "caseid", min_cases: int = K.MIN_CASES, tile_terms: int | None = TILE_TERMS,
) -> DataFrame:
    """Distinct cases per (drug, reaction) with at least ``min_cases`` of them."""
    pairs = co_occurrence(drugs, reactions, drug, reaction, case, tile_terms)
    counts = pairs.groupBy(drug, reaction).agg(F.count(F.lit(1)).alias("n_cases"))
    return counts.where(F.col("n_cases") >= min_cases) if min_cases > 1 else counts


def _scored(
    pairs: DataFrame, drug: str, reaction: str, total: Column, include_insufficient: bool, **thresholds
) -> DataFrame:
    scores = disproportionality(
        F.col("n_cases"), F.coalesce("n_drug", F.lit(0)), F.coalesce("n_reaction", F.lit(0)), total,
        **thresholds,
    )
    scorable = scores.pop("scorable")
    columns = [
        F.col(drug).alias("drug"), F.col(reaction).alias("reaction"), "n_cases",
        *(c.alias(name) for name, c in scores.items()),
    ]
    if not include_insufficient:
        return pairs.where(scorable).select(*columns)
    reason = F.when(~scorable, F.lit("insufficient_data")).alias("reason")
    full = pairs.select(*columns, reason)
    return full.withColumns(
        {c: F.coalesce(c, F.lit(False)) for c in ("is_signal", "masking_warning")}
    )


def signals(
    cases: DataFrame, drugs: DataFrame, reactions: DataFrame, drug: str = "drugname_norm",
    reaction: str = "pt_name", case: str = "caseid", include_insufficient: bool = False,
    min_cases: int = K.MIN_CASES, tile_terms: int | None = TILE_TERMS, **thresholds,
) -> DataFrame:
    """Case-level PRR, ROR, chi-squared, masking warning and signal decision per pair.

    Every margin is counted once. Rare pairs leave before the scores are taken, unless
    ``include_insufficient`` asks for them with the reason they have no score. Joins to the
    margins are left to Spark's size-based choice: the margins are usually small, but
    nothing bounds them.
    """
    d_terms, r_terms = case_terms(drugs, drug, case), case_terms(reactions, reaction, case)
    pairs = (
        co_occurrence(drugs, reactions, drug, reaction, case, tile_terms)
        .groupBy(drug, reaction).agg(F.count(F.lit(1)).alias("n_cases"))
    )
    if not include_insufficient:
        pairs = pairs.where(F.col("n_cases") >= min_cases)
    total = cases.agg(F.count_distinct(case)).scalar()
    joined = (
        pairs.join(term_counts(d_terms, drug, "n_drug"), drug, "left")
        .join(term_counts(r_terms, reaction, "n_reaction"), reaction, "left")
    )
    return _scored(
        joined, drug, reaction, total, include_insufficient, min_cases=min_cases, **thresholds
    )


def signals_by_row(
    rows: DataFrame, drug: str = "generic_drug", reaction: str = "meddra_pt",
    include_insufficient: bool = False, **thresholds,
) -> DataFrame:
    """The same scores with rows as the unit, all pairs at once.

    A row without drug or reaction is not part of a pair but counts in the total and in the
    margin of the term it does have. Only the first grouping reads rows; the margins are
    sums over the pair table.
    """
    counts = rows.groupBy(drug, reaction).agg(F.count(F.lit(1)).alias("n_cases"))
    total = rows.agg(F.count(F.lit(1))).scalar()
    per_drug = counts.where(F.col(drug).isNotNull()).groupBy(drug).agg(F.sum("n_cases").alias("n_drug"))
    per_reaction = (
        counts.where(F.col(reaction).isNotNull()).groupBy(reaction)
        .agg(F.sum("n_cases").alias("n_reaction"))
    )
    joined = (
        counts.where(F.col(drug).isNotNull() & F.col(reaction).isNotNull())
        .join(per_drug, drug).join(per_reaction, reaction)
    )
    return _scored(joined, drug, reaction, total, include_insufficient, **thresholds)
