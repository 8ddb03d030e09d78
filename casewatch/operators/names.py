"""Drug-name normalisation: vocabulary, keyword match, fuzzy match, write-back."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewatch import constants as K
from casewatch.functions.lcs import RatioIndex
from casewatch.functions.text import first_case, strip_salts
from casewatch.operators.best import (
    BLOCK_ROWS,
    MAX_BROADCAST_BYTES,
    MAX_BROADCAST_ROWS,
    by_block,
    measured,
    nothing,
    stream_past,
    winners_first,
)
from casewatch.operators.dedupe import keep_first
from casewatch.operators.keys import spread_nulls
from casewatch.session import scratch
from casewatch.sources.columns import first_col
from casewatch.sources.readers import union_all
from casewatch.sources.sinks import replace_table

Vocabulary = Sequence[tuple[str, str, Sequence[str]]]


def keyword_vocabulary(spark: SparkSession, vocabulary: Vocabulary = K.DRUG_KEYWORDS) -> DataFrame:
    """The keyword vocabulary as a lookup (display_name, rxcui, generic_name)."""
    rows = [(w.upper().strip(), code, drug) for drug, code, words in vocabulary for w in words]
    return spark.createDataFrame(rows, "display_name string, rxcui string, generic_name string")


def _ranked(vocabulary: Vocabulary) -> list[tuple[str, str, str]]:
    """(keyword, generic name, code), longest keyword first, list order on equal length."""
    entries = [(w.lower().strip(), drug, code) for drug, code, words in vocabulary for w in words]
    return sorted(entries, key=lambda e: -len(e[0]))


def with_keyword(
    df: DataFrame, column: str, vocabulary: Vocabulary = K.DRUG_KEYWORDS, out: str = "hit"
) -> DataFrame:
    """Add a struct (drugname_norm, rxnorm_rxcui, match_score) of the longest keyword in a name.

    100 where the keyword is the whole name, else 90; nulls and 0 without a hit. The list
    is tried longest first in one CASE expression that gives the place in it, so this needs
    neither a join nor a window.
    """
    entries = _ranked(vocabulary)
    lowered = df.withColumn("_lower", F.lower(F.trim(column)))
    placed = lowered.withColumn(
        "_place",
        first_case((F.col("_lower").contains(e[0]), F.lit(i)) for i, e in enumerate(entries)),
    )

    def pick(field: int) -> Column:
        return F.get(F.array(*[F.lit(e[field]) for e in entries]), F.col("_place"))

    score = (
        F.when(F.col("_place").isNull(), F.lit(0.0))
        .when(pick(0) == F.col("_lower"), F.lit(100.0)).otherwise(F.lit(90.0))
    )
    hit = F.struct(
        pick(1).alias("drugname_norm"), pick(2).alias("rxnorm_rxcui"), score.alias("match_score")
    )
    return placed.withColumn(out, hit).drop("_lower", "_place")


def known_drug_count(drugs: Column, vocabulary: Vocabulary = K.DRUG_KEYWORDS) -> Column:
    """How many names of an array hold a keyword."""
    words = F.array(*[F.lit(e[0]) for e in _ranked(vocabulary)])
    lowered = F.transform(drugs, lambda d: F.lower(F.trim(d)))
    return F.size(F.filter(lowered, lambda d: F.exists(words, lambda w: F.contains(d, w))))


def distinct_terms(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-null values in order."""
    return df.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column)


def keyword_match(
    names: DataFrame, column: str = "drugname_raw", vocabulary: Vocabulary = K.DRUG_KEYWORDS
) -> DataFrame:
    """Distinct names with their keyword match."""
    unique = names.where(F.col(column).isNotNull()).select(column).distinct()
    return with_keyword(unique, column, vocabulary, "_hit").select(column, "_hit.*")


def vocabulary_lookup(terms: DataFrame) -> DataFrame:
    """Stack the name columns of a vocabulary file into (display_name, rxcui, generic_name).

    Generic, display and brand names in that order of preference; the first entry per
    display name stays. Column names are upper-case, as the reader leaves them.
    """
    code = first_col(terms, [c for c in terms.columns if c in ("RXCUI", "GENERIC_RXCUI")], required=True)
    generic = first_col(terms, [c for c in reversed(terms.columns) if c in ("FULL_GENERIC_NAME", "GENERIC_NAME")])
    display = first_col(terms, [c for c in terms.columns if c in ("DISPLAY_NAME", "FULL_NAME")])
    brand = first_col(terms, ["BRAND_NAME"])
    columns = [c for c in (generic, display, brand) if c]
    if not columns:
        raise ValueError(f"no name column among {terms.columns}")

    def entry(place: int, column: str) -> Column:
        return F.struct(
            F.lit(place).alias("_place"), F.upper(F.trim(column)).alias("display_name"),
            F.col(code).alias("rxcui"), F.lower(F.trim(generic or column)).alias("generic_name"),
        )

    stacked = terms.select(F.inline(F.array(*[entry(i, c) for i, c in enumerate(columns)])))
    named = stacked.where(F.col("display_name").isNotNull() & (F.col("display_name") != ""))
    return keep_first(named, ["display_name"], [F.col("_place")]).drop("_place")


def _forms(rows: pd.DataFrame) -> list[list[tuple[int, str]]]:
    """The forms of each name that are compared: without salts (0) where that differs, and in full (1)."""
    return [([(0, bare)] if bare and bare != full else []) + [(1, full)] for full, bare in zip(rows["_full"], rows["_bare"])]


def _best_entries(column: str, forms: Callable = _forms, least: float = 0.0):
    """Scorer factory: the best entry of every name, the first form and then the first display name on a tie."""

    def prepare(catalog: pd.DataFrame):
        catalog = catalog.sort_values("display_name", ignore_index=True)
        index = RatioIndex(catalog["display_name"].tolist())
        columns = {c: catalog[c].to_numpy() for c in ("generic_name", "rxcui", "display_name")}

        def score(rows: pd.DataFrame) -> pd.DataFrame:
            found = []
            for name, texts in zip(rows[column], forms(rows)):
                ratio, _, form, place = max(((r, -f, f, p) for f, t in texts for p, r in [index.best(t)]))
                if ratio >= least:
                    found.append((name, *[columns[c][place] for c in ("generic_name", "rxcui")], ratio, form, columns["display_name"][place]))
            return pd.DataFrame(found, columns=[column, "generic_name", "rxcui", "_score", "_form", "_place"])

        return score

    return prepare


LENGTH_BANDS = 4  # bands of name lengths from a number to its double


def _length(name: Column) -> Column:
    """Characters of a name with its words sorted: runs of white space count once, at the ends not at all."""
    return F.length(F.trim(F.regexp_replace(name, "(?U)[\\x1c-\\x1f\\s]+", " ")))


def _band(length: Column) -> Column:
    return F.floor(LENGTH_BANDS * F.log2(F.greatest(length, F.lit(1)))).cast("int")


def _by_length(
    open_names: DataFrame, entries: DataFrame, column: str, schema: T.StructType, threshold: float, block_rows: int,
) -> DataFrame:
    """Best entries where the lookup is too large to broadcast: an equi-join on bands of lengths.

    A ratio of t needs lengths within t / (200 - t) of each other, so a name visits only the bands that can hold
    such entries, and within a block only the entries that ``RatioIndex`` cannot rule out are compared. Names whose best
    ratio is below the threshold come again with a lower t and more bands, until every name has its best entry. A
    band of many entries is cut into slices, and many names into buckets, of at most about ``block_rows``.
    """
    spark = open_names.sparkSession
    base = scratch(spark, "fuzzy")
    entries = replace_table(entries.withColumn("_band", _band(_length(F.col("display_name")))), f"{base}/entries")
    sliced = entries.groupBy("_band").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("_slices"))
    sliced = replace_table(sliced, f"{base}/bands")
    lowest, highest = sliced.agg(F.min("_band"), F.max("_band")).first()
    if lowest is None:
        return nothing(open_names, column, schema)
    entries = entries.join(sliced, "_band").withColumn("_slice", F.pmod(F.xxhash64("display_name"), F.col("_slices")).cast("int")).drop("_slices")
    form = lambda number, text: F.struct(F.lit(number).alias("_form"), F.col(text).alias("_text"))
    both, one = F.array(form(1, "_full"), form(0, "_bare")), F.array(form(1, "_full"))
    differs = (F.col("_bare") != "") & (F.col("_bare") != F.col("_full"))
    left = open_names.select(column, F.inline(F.when(differs, both).otherwise(one))).withColumn("_len", _length(F.col("_text")))
    left, done = replace_table(left, f"{base}/forms"), []
    for step, t in enumerate([threshold, *[x for x in (60.0, 40.0, 20.0) if x < threshold], 0.0]):
        near = F.ceil(F.col("_len") * t / (200 - t)) - 1, F.floor(F.col("_len") * (200 - t) / t) + 1 if t else None
        low, high = (F.lit(lowest), F.lit(highest)) if not t else [
            edge(_band(n), F.lit(at)) for edge, n, at in ((F.greatest, near[0], lowest), (F.least, near[1], highest))]
        buckets = max(1, -(-left.count() // block_rows))
        visits = left.withColumn("_low", low).withColumn("_high", high).where("_low <= _high").withColumn("_band", F.explode(F.sequence("_low", "_high")))
        visits = visits.join(sliced, "_band").withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1))).drop("_slices")
        visits = visits.withColumn("_bucket", F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int"))
        parts = entries.withColumn("_bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
        prepare = _best_entries(column, lambda rows: [[f] for f in zip(rows["_form"], rows["_text"])], t)
        group = ["_band", "_slice", "_bucket"]
        found = visits.groupBy(*group).cogroup(parts.groupBy(*group)).applyInPandas(by_block(prepare, schema), schema)
        done.append(replace_table(winners_first(found, column), f"{base}/found-{step}"))
        left = replace_table(left.join(done[-1].select(column), column, "left_anti"), f"{base}/left-{step}")
        if left.isEmpty():
            break
    return union_all(done)


def fuzzy_match(
    names: DataFrame, lookup: DataFrame, column: str = "drugname_raw",
    threshold: float = K.MIN_NAME_SCORE, salts: Sequence[str] = K.SALT_WORDS,
    max_lookup_rows: int = MAX_BROADCAST_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Distinct names with their best lookup entry by token-sort ratio.

    An exact display name scores 100. Otherwise the name without salts and the full name
    are both compared with every entry and the higher score wins, the stripped one on a
    tie; equal entries go by display name. Below the threshold the score stays and the
    match is null. A lookup of at most ``max_lookup_rows`` and a bounded number of bytes is broadcast;
    a larger one meets the names in bands of lengths. Either way entries that cannot win are not compared.
    """
    unique = names.where(F.col(column).isNotNull()).select(column).distinct().withColumn(
        "_full", F.upper(F.trim(column))
    )
    unique = unique.withColumn("_bare", strip_salts(F.col("_full"), salts))
    entries = lookup.select(
        F.upper(F.trim("display_name")).alias("display_name"), "rxcui",
        F.nullif(F.lower(F.trim("generic_name")), F.lit("")).alias("generic_name"),
    ).where(F.col("display_name").isNotNull() & (F.col("display_name") != ""))
    entries = keep_first(entries, ["display_name"])

    exact = entries.select(F.col("display_name").alias("_full"), "rxcui", "generic_name")
    hits = unique.join(exact, "_full").select(
        column, F.col("generic_name").alias("drugname_norm"), F.col("rxcui").alias("rxnorm_rxcui"),
        F.lit(100.0).alias("match_score"),
    )
    # Names are few bytes but much work each: a set number of partitions, which adaptive
    # execution does not merge by size as it would those of the joins above.
    spread = max(
        int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")),
        names.sparkSession.sparkContext.defaultParallelism,
    )
    open_names = unique.join(exact, "_full", "left_anti").repartition(spread, column)

    schema = T.StructType([
        T.StructField(column, T.StringType()), T.StructField("generic_name", T.StringType()),
        T.StructField("rxcui", T.StringType()), T.StructField("_score", T.DoubleType()),
        T.StructField("_form", T.IntegerType()), T.StructField("_place", T.StringType()),
    ])
    # measured on the lookup as it comes, of which the entries are a part
    rows, held = measured(lookup, F.octet_length(F.concat_ws("", "display_name", "generic_name", "rxcui")))
    if rows <= max_lookup_rows and held <= MAX_BROADCAST_BYTES:
        scored = stream_past(open_names, entries, column, _best_entries(column), schema)
    else:
        scored = _by_length(open_names, entries, column, schema, threshold, block_rows)
    accepted = F.col("_score") >= threshold
    near = scored.select(
        column, F.when(accepted, F.col("generic_name")).alias("drugname_norm"),
        F.when(accepted, F.col("rxcui")).alias("rxnorm_rxcui"),
        F.round("_score", 1).alias("match_score"),
    )
    return hits.unionByName(near)


def apply_names(drugs: DataFrame, mapping: DataFrame, column: str = "drugname_raw") -> DataFrame:
    """Write matched names back; rows whose name has no match keep what they had.

    The join type is left to Spark: small mappings are broadcast by measured size, large
    ones shuffle, and a name that many rows share is split by the skew-join rule.
    """
    new = mapping.where(F.col("drugname_norm").isNotNull()).select(
        F.col(column).alias("_key"), F.col("drugname_norm").alias("_norm"),
        F.col("rxnorm_rxcui").alias("_code"),
    )
    matched = F.col("_norm").isNotNull()
    return (
        drugs.withColumn("_key", spread_nulls(F.col(column), *drugs.columns)).join(new, "_key", "left")
        .withColumns({
            "drugname_norm": F.when(matched, F.col("_norm")).otherwise(F.col("drugname_norm")),
            "rxnorm_rxcui": F.when(matched, F.col("_code")).otherwise(F.col("rxnorm_rxcui")),
        })
        .select(*drugs.columns)
    )


def normalize_names(
    drugs: DataFrame, method: str = "keyword", lookup: DataFrame | None = None,
    vocabulary: Vocabulary = K.DRUG_KEYWORDS, column: str = "drugname_raw",
) -> DataFrame:
    """Normalise the raw names of drug rows.

    ``fuzzy`` matches distinct names against ``lookup`` and joins back. ``keyword`` gives
    the same rows as matching distinct names would, but as one expression per row: no
    shuffle, and no join whose key a frequent name could skew.
    """
    if method == "fuzzy":
        return apply_names(drugs, fuzzy_match(drugs, lookup, column), column)
    hit = F.col("_hit")
    matched = hit["drugname_norm"].isNotNull()
    return (
        with_keyword(drugs, column, vocabulary, "_hit")
        .withColumns({
            c: F.when(matched, hit[c]).otherwise(F.col(c)) for c in ("drugname_norm", "rxnorm_rxcui")
        })
        .drop("_hit")
    )


def match_stats(mapping: DataFrame) -> DataFrame:
    """Totals over a mapping: names, matched, unmatched, percent matched."""
    total, matched = F.count(F.lit(1)), F.count("drugname_norm")
    return mapping.agg(
        total.alias("total"), matched.alias("matched"), (total - matched).alias("unmatched"),
        F.round(matched * 100 / F.greatest(total, F.lit(1)), 1).alias("match_rate_pct"),
    )


def mapping_samples(mapping: DataFrame, matched: int = 15, unmatched: int = 10) -> DataFrame:
    """The first matched and first unmatched names in name order.

    ``n_more`` says how many further names of the kind are not listed.
    """
    columns = ["drugname_raw", "drugname_norm", "rxnorm_rxcui", "match_score"]

    def sample(kind: str, keep: Column, n: int) -> DataFrame:
        rows = mapping.where(keep)
        more = rows.agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0))).scalar()
        return rows.orderBy("drugname_raw").limit(n).select(
            F.lit(kind).alias("kind"), *columns, more.alias("n_more")
        )

    has = F.col("drugname_norm").isNotNull()
    return sample("matched", has, matched).unionByName(sample("unmatched", ~has, unmatched))
