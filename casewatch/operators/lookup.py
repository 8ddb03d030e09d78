"""Per-report joins: reactions to mapped terms, drug and term pairs to stored signals.

Both spread a report's short lists into narrow rows (id, places, key), join those, gather what
they found by report id, and join that back. No other column of a report is copied or shuffled
with them; reports that are already partitioned by id stay in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewatch.operators.dedupe import keep_first
from casewatch.operators.keys import spread_nulls

SIGNAL_FIELDS = ["drug", "reaction", "prr", "ror", "chi2", "n_cases", "masking_warning"]


def map_terms(
    df: DataFrame, term_map: DataFrame, id_col: str = "report_id", reactions: str = "reactions",
    text: str = "text",
) -> DataFrame:
    """Add ``meddra_pts`` and ``mapping_scores`` in the order of the report's reactions.

    ``term_map`` (text, mapped_term, similarity) has one row per text. A reaction it lacks
    keeps its own text with score 0. Report ids are unique and not null.
    """
    spoken = df.select(id_col, F.posexplode(reactions).alias("_pos", "_text"))
    known = term_map.select(F.col(text).alias("_key"), "mapped_term", "similarity")
    mapped = spoken.withColumn("_key", spread_nulls(F.col("_text"), id_col)).join(known, "_key", "left")
    item = F.struct(
        "_pos", F.coalesce("mapped_term", "_text").alias("pt"),
        F.coalesce("similarity", F.lit(0.0)).alias("score"),
    )
    found = mapped.groupBy(id_col).agg(F.sort_array(F.collect_list(item)).alias("_items"))
    none = F.array()
    return df.join(found, id_col, "left").select(
        *(df[c] for c in df.columns), F.coalesce("_items.pt", none.cast("array<string>")).alias("meddra_pts"),
        F.coalesce("_items.score", none.cast("array<double>")).alias("mapping_scores"),
    )


def signal_lookup(
    df: DataFrame, signals: DataFrame, id_col: str = "report_id", drugs: str = "drugs",
    terms: str = "meddra_pts",
) -> DataFrame:
    """Add ``prr_signals``: the signals among a report's drugs x terms, drug by drug.

    Names compare without case, repeats are kept, only signals count, scores round to 3
    places. Report ids are unique and not null, so gathering collects no more than the pairs of two
    short lists.
    """
    stored = keep_first(
        signals.withColumns({"_d": F.lower("drug"), "_t": F.lower("reaction")}), ["_d", "_t"],
        [F.col("drug"), F.col("reaction")],
    ).where("is_signal")
    hit = F.struct(
        "drug", "reaction", *(F.round(c, 3).alias(c) for c in ("prr", "ror", "chi2")), "n_cases",
        "masking_warning",
    )
    stored = stored.select("_d", "_t", hit.alias("_hit"))
    pairs = (
        df.select(id_col, terms, F.posexplode(drugs).alias("_i", "_drug"))
        .select(id_col, "_i", "_drug", F.posexplode(terms).alias("_j", "_term"))
        .select(id_col, "_i", "_j", F.lower("_drug").alias("_d"), F.lower("_term").alias("_t"))
    )
    found = pairs.join(stored, ["_d", "_t"]).groupBy(id_col).agg(
        F.sort_array(F.collect_list(F.struct("_i", "_j", "_hit"))).alias("_found")
    )
    none = F.array().cast(found.select("_found._hit").schema[0].dataType)
    return df.join(found, id_col, "left").select(
        *(df[c] for c in df.columns), F.coalesce("_found._hit", none).alias("prr_signals")
    )
