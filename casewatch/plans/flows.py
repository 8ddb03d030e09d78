"""Whole jobs: from stored inputs to stored tables, in the order an operator runs them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewatch import constants as K
from casewatch.operators import names, nearest, pairs, texts
from casewatch.plans import reports, reviews
from casewatch.plans.triage import score_outputs, triage
from casewatch.sources import readers, sinks

Score = Callable[[list[str], int], list[str]]


def drug_lookup(spark: SparkSession, stored: str, terms_file: str) -> DataFrame:
    """The stored name lookup if there is one, else built from the vocabulary file and stored."""
    return sinks.stored_or_built(
        spark, stored, lambda: names.vocabulary_lookup(readers.read_vocabulary(spark, terms_file))
    )


def normalize_flow(
    drugs: DataFrame, out: str, lookup: DataFrame | None = None,
    vocabulary: names.Vocabulary = K.DRUG_KEYWORDS,
) -> tuple[DataFrame, DataFrame]:
    """Stored mapping of the distinct names and stored drug rows with names written back.

    Fuzzy matching where a lookup is given, keyword matching otherwise. The mapping is
    stored first, so that names are matched once for both tables.
    """
    matched = (
        names.fuzzy_match(drugs, lookup) if lookup is not None
        else names.keyword_match(drugs, vocabulary=vocabulary)
    )
    mapping = sinks.replace_table(matched, f"{out.rstrip('/')}/name_mapping")
    return mapping, sinks.replace_table(names.apply_names(drugs, mapping), f"{out.rstrip('/')}/drugs_normalized")


def signal_flow(
    cases: DataFrame, drugs: DataFrame, reactions: DataFrame, out: str,
    known: Sequence[tuple[str, str]] = K.POSITIVE_CONTROLS, **thresholds,
) -> tuple[DataFrame, DataFrame, bool]:
    """Stored signals, the known pairs looked up in them, and whether the mandatory ones hold."""
    scored = sinks.stamped(pairs.signals(cases, drugs, reactions, **thresholds), "computed_at")
    stored = sinks.replace_table(scored, f"{out.rstrip('/')}/signals")
    checked = reports.controls(stored, known)
    return stored, checked, reports.controls_pass(checked)


def review_flow(
    spark: SparkSession, folder: str, out: str, terms: Sequence[tuple[str, str]],
    n_tagged: int | None = None, n_labels: int = 50, **build_args,
) -> dict[str, DataFrame]:
    """Review files to the stored tables reviews and mentions, and a labelling sheet as CSV.

    Mentions are looked for in all event-mentioning reviews, or in the first ``n_tagged`` by id.
    """
    out = out.rstrip("/")
    built = reviews.build_reviews(readers.read_reviews(spark, folder), **build_args)
    stored = sinks.replace_table(sinks.stamped(built, "created_at"), f"{out}/reviews")
    tagged = stored.where("has_ae_mention")
    if n_tagged is not None:
        tagged = tagged.orderBy("review_id").limit(n_tagged)
    found = sinks.replace_table(texts.mentions(tagged, terms), f"{out}/mentions")
    sheet = sinks.label_sheet(stored, n_labels)
    sinks.write_csv(sheet, f"{out}/label_sheet")
    return {"reviews": stored, "mentions": found, "label_sheet": sheet}


def score_attempts(
    todo: DataFrame, score: Score, out: str, vocabulary: names.Vocabulary = K.DRUG_KEYWORDS,
    min_confidence: float = K.MIN_CONFIDENCE, max_attempts: int = K.MAX_ATTEMPTS,
    cache: str | None = None, batch: int = 0, delivered: DataFrame | None = None,
) -> DataFrame:
    """Raw outputs (report_id, drug_norm, raw, cached, attempt) of reviews (review_id, review_text, drug_norm).

    ``score(texts, attempt)`` is a user's function. Each attempt is stored before the next,
    which scores only the reviews whose output fell short: nothing is scored twice. ``cache`` is
    the folder of an ``OutputStore``: what an earlier ``batch`` scored at the same attempt is taken from there.

    The texts are shuffled once, by their hash, and kept for all attempts; other joins move ids and hashes only.
    ``delivered`` is a table with ``_hash`` that holds the texts of ``todo``: they are then taken from there, so that the
    joins that made ``todo`` move no texts either.
    """
    spark = todo.sparkSession
    hashed = todo if delivered is not None else texts.with_hash(todo)
    every = hashed.select("review_id", "drug_norm", "_hash").persist(StorageLevel.DISK_ONLY)
    unique = texts.distinct_texts(hashed if delivered is None else delivered)
    unique = unique.join(every.select("_hash"), "_hash", "left_semi").persist(StorageLevel.DISK_ONLY)
    todo = every
    for attempt in range(1, max_attempts + 1):
        def run(batch: list[str], attempt: int = attempt) -> list[str]:
            return score(batch, attempt)

        store = texts.OutputStore(cache, batch, attempt) if cache else None
        rows = texts.score_texts(todo, run, store=store, unique=unique).select(
            F.col("review_id").alias("report_id"), "drug_norm", F.col("raw_output").alias("raw"),
            F.col("cached") if cache else F.lit(False).alias("cached"),
        )
        stored = sinks.replace_table(rows, f"{out.rstrip('/')}/attempt={attempt}")
        short = score_outputs(stored, vocabulary).where(F.col("confidence") < min_confidence)
        todo = todo.join(short.select(F.col("report_id").alias("review_id")), "review_id", "left_semi")
    unique.unpersist()
    every.unpersist()
    return spark.read.parquet(out)


def term_map(
    outputs: DataFrame, catalog: DataFrame, embed: Callable[[list[str]], list[list[float]]],
    vocabulary: names.Vocabulary = K.DRUG_KEYWORDS, **args,
) -> DataFrame:
    """(text, mapped_term, similarity) for every distinct reaction text of the outputs.

    ``catalog`` has (term, embedding); ``embed`` is a user's function for the texts.
    """
    spoken = score_outputs(outputs, vocabulary).select(F.explode("reactions").alias("text"))
    return nearest.nearest_term(texts.embed_texts(spoken, embed), catalog, **args).select(
        "text", "mapped_term", "similarity"
    )


def triage_flow(
    spark: SparkSession, review_table: DataFrame, out: str, score: Score, signals: DataFrame,
    terms: Callable[[DataFrame], DataFrame], vocabulary: names.Vocabulary = K.DRUG_KEYWORDS,
    limit: int | None = None,
) -> DataFrame:
    """One batch: reviews without a result are scored, triaged and added to the stored results.

    ``terms`` makes the term map of the raw outputs, for example by ``term_map`` above. Texts that an
    earlier batch has scored are not scored again; their reviews are marked as cached in the trace.
    Returns the rows of this batch.
    """
    results = f"{out.rstrip('/')}/results"
    done = sinks.read_if_present(spark, results)
    version = sinks.next_version(done)
    delivered = texts.with_hash(review_table)  # hashed before the joins, which then move no texts
    if done is None:
        done = review_table.select("review_id").limit(0)
    todo = reviews.unprocessed(delivered, done, limit)
    base = out.rstrip("/")
    # a batch with a limit is small beside the table: its texts come from its own rows
    rows = delivered.where("has_ae_mention") if limit is None else todo
    outputs = score_attempts(
        todo, score, f"{base}/outputs/batch={version}", vocabulary, cache=f"{base}/cache", batch=version, delivered=rows)
    decided = triage(outputs, terms(outputs), signals, vocabulary)
    sinks.append_version(sinks.stamped(decided, "processed_at"), results, version)
    return spark.read.parquet(f"{results}/version={version}")
