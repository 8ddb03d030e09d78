"""Nearest catalog term by cosine similarity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewatch import constants as K
from casewatch.operators.best import BLOCK_ROWS, MAX_BROADCAST_ROWS, best_partner, measured

# Similarities held at once while a batch of queries meets the catalog.
CELLS = 2_000_000
# Numbers of a catalog that is broadcast; each Python worker holds them twice.
MAX_CATALOG_BYTES = 32 << 20
# Twice what rounding to 12 places can move (1 + cosine) / 2, as a cosine: only cells this near the highest are rounded.
NEAR = 4e-12


def nearest_term(
    queries: DataFrame, catalog: DataFrame, text: str = "text", term: str = "term",
    embedding: str = "embedding", threshold: float = K.MIN_TERM_SIMILARITY,
    max_catalog_rows: int = MAX_BROADCAST_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Per query text: matched term or null, mapped term (own text if none), similarity.

    Similarity is (1 + cosine) / 2, over every catalog entry, so the result is exact. Equal
    entries go by term. Blank text, or one without a vector, maps to itself with score 0; catalog
    rows without a vector are no entries; catalog vectors of different lengths are an error before the
    search starts, a query vector of another length one during it. Query texts are unique.
    """
    blank = F.col(text).isNull() | (F.trim(text) == "") | F.col(embedding).isNull()
    spoken = queries.where(~blank).select(text, F.col(embedding).cast("array<double>").alias("_vec"))
    entries = catalog.select(
        F.col(term).alias("_term"), F.col(embedding).cast("array<double>").alias("_vec")
    ).where("_vec IS NOT NULL")
    text_type = queries.schema[text].dataType
    term_type = catalog.schema[term].dataType
    dims = F.size("_vec")
    rows, held, least, most = measured(entries, 8 * dims, F.min(dims), F.max(dims))
    if least != most:
        raise ValueError(f"catalog vectors have {least} to {most} numbers")
    schema = T.StructType([
        T.StructField(text, text_type), T.StructField("_score", T.DoubleType()),
        T.StructField("_place", term_type),
    ])

    def prepare(part: pd.DataFrame):
        import numpy as np

        def unit(vectors: pd.Series):
            rows = np.vstack(vectors.to_numpy())
            norms = np.linalg.norm(rows, axis=1, keepdims=True)
            return rows / np.where(norms == 0, 1.0, norms)

        def rounded(cosines):
            return np.round((1.0 + cosines) / 2.0, 12)

        def nearest(cosines):
            # rounding makes equal entries tie, whatever order the products were summed in
            top = cosines.max(axis=1)
            if np.isnan(top).any():
                near = rounded(cosines)
                place = near.argmax(axis=1)
                return place, near[np.arange(len(place)), place]
            best = rounded(top)
            row, at = np.nonzero(cosines >= (top - NEAR)[:, None])
            ties = rounded(cosines[row, at]) == best[row]
            _, first = np.unique(row[ties], return_index=True)
            return at[ties][first], best

        part = part.sort_values("_term", ignore_index=True)
        known, terms = unit(part["_vec"]).T, part["_term"].to_numpy()
        step = max(1, CELLS // len(part))

        def score(rows: pd.DataFrame) -> pd.DataFrame:
            if rows.empty:
                return pd.DataFrame({text: [], "_score": [], "_place": []})
            if (rows["_vec"].map(len) != len(known)).any():
                raise ValueError(f"a query vector has not the {len(known)} numbers of the catalog's")
            asked, places, scores = unit(rows["_vec"]), [], []
            for start in range(0, len(rows), step):
                place, best = nearest(asked[start : start + step] @ known)
                places.append(place)
                scores.append(best)
            return pd.DataFrame({
                text: rows[text].to_numpy(), "_score": np.concatenate(scores),
                "_place": terms[np.concatenate(places)],
            })

        return score

    best = best_partner(spoken, entries, text, prepare, schema, rows, held, max_catalog_rows, block_rows, MAX_CATALOG_BYTES)
    matched = F.when(F.col("_score") >= threshold, F.col("_place"))
    mapped = best.select(
        text, matched.alias("matched_term"),
        F.coalesce(matched.cast("string"), F.col(text).cast("string")).alias("mapped_term"),
        F.round("_score", 3).alias("similarity"),
    )
    unspoken = queries.where(blank).select(
        text, F.lit(None).cast(term_type).alias("matched_term"),
        F.col(text).cast("string").alias("mapped_term"), F.lit(0.0).alias("similarity"),
    )
    return mapped.unionByName(unspoken)
