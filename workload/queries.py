"""One registered query per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewatch.functions import cases as C
from casewatch.functions import text as X
from casewatch.functions.parsing import parse_outputs
from casewatch.functions.scoring import signal_flag as flag_of
from casewatch.operators import dedupe, lookup, names, nearest, pairs, texts
from casewatch.plans import evaluate, flows, ingest, reports, reviews, triage
from casewatch.session import scratch, tune
from casewatch.sources import readers, sinks
from casewatch.streaming import stages, triage_stream
from workload.inputs import table, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# The nouns and brands of the part table stand in for drug names.
NOUNS = [
    ("ring", "R1", ["ring", "red ring"]), ("bolt", "B2", ["bolt", "old bolt "]),
    ("gear", "G3", ["gear", "new gear"]), ("rod", "D4", ["rod", "rod hot"]),
    ("widget", "W5", ["widget"]),
]
BRANDS = [(f"Brand#{i}", str(i), [f"brand#{i}"]) for i in range(3, 10)]
TARGETS = ["ring", "bolt", "gear"]
SOURCES = ["src12", "src1", "src0", "src5"]
STEMS = ["ouen", "reti", "pain", "lichen"]
TERMS = [("the", "CHEMICAL"), ("of the", "DISEASE"), ("der", "CHEMICAL"), ("pain", "DISEASE"), ("que", "DISEASE")]
CONTROLS = [("Brand#3", "red gear"), ("Brand#13", "new ring"), ("Brand#7", "old bolt"), ("Brand#99", "hot rod")]
CHOSEN = ["Brand#3", "Brand#7", "Brand#13", "Brand#21"]
LOW = {"min_prr": 1.1, "min_chi2": 0.5}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(tune(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return run


def joined(column: str):
    """A list column as text, so that results compare as plain values."""
    return F.array_join(column, "|").alias(column)


# --- signals -----------------------------------------------------------------------------

def _report_tables(spark, d):
    return view(spark, d, "cases"), view(spark, d, "case_drugs"), view(spark, d, "case_reactions")


def _signals(spark, d, **args):
    return pairs.signals(*_report_tables(spark, d), **args)


@query
def marginals(spark, d):
    return pairs.marginals(*_report_tables(spark, d))


@query
def pair_counts(spark, d):
    return pairs.pair_counts(*_report_tables(spark, d)[1:])


@query
def signals(spark, d):
    return _signals(spark, d)


@query
def signals_rowlevel(spark, d):
    return pairs.signals_by_row(view(spark, d, "case_rows"))


@query
def signals_all(spark, d):
    return _signals(spark, d, include_insufficient=True, min_cases=30)


@query
def signal_summary(spark, d):
    return reports.signal_summary(_signals(spark, d))


@query
def signals_per_drug(spark, d):
    return reports.signals_per_drug(_signals(spark, d))


@query
def top_signals(spark, d):
    return reports.top_signals(_signals(spark, d, **LOW))


@query
def signal_filter(spark, d):
    return reports.filter_signals(_signals(spark, d, **LOW), CHOSEN, min_prr=1.1)


@query
def heatmap(spark, d):
    return reports.heatmap(_signals(spark, d, **LOW), CHOSEN, min_prr=1.1)


@query
def controls(spark, d):
    return reports.controls(_signals(spark, d, **LOW), CONTROLS, optional=["Brand#13"], min_prr=1.1)


def _stored_signals(spark, d):
    """Signals as the lookups find them: a stored table, whose size Spark knows."""
    return sinks.replace_table(_signals(spark, d, **LOW), scratch(spark, "signals"))


def _report_lists(spark, d):
    return view(spark, d, "part").select(
        "p_partkey", F.array("p_brand", F.lower("p_brand"), F.lit("Brand#7")).alias("drugs"),
        F.array(F.upper("p_name"), F.lit("old bolt")).alias("meddra_pts"),
    )


def _looked_up(spark, d):
    return lookup.signal_lookup(_report_lists(spark, d), _stored_signals(spark, d), "p_partkey")


@query
def signal_flow(spark, d):
    """Signals as a stored table, read back."""
    stored, checked, _ = flows.signal_flow(*_report_tables(spark, d), scratch(spark, "flow"), CONTROLS, **LOW)
    return stored.drop("computed_at")


@query
def signal_lookup(spark, d):
    hits = _looked_up(spark, d).select("p_partkey", F.posexplode("prr_signals").alias("pos", "s"))
    return hits.select("p_partkey", (F.col("pos") + 1).cast("long").alias("place"), "s.*")


@query
def signal_flag(spark, d):
    prrs = F.col("prr_signals.prr")
    return _looked_up(spark, d).select("p_partkey", flag_of(prrs, high=1.6, medium=1.3).alias("signal_flag"))


# --- case reports ------------------------------------------------------------------------

@query
def age_years(spark, d):
    return view(spark, d, "demo_raw").select(
        "caseid", "age", "age_cod", F.round(C.age_years(F.col("age"), F.col("age_cod")), 6).alias("age_years")
    )


@query
def report_date(spark, d):
    return view(spark, d, "demo_raw").select("caseid", "fda_dt", C.report_date(F.col("fda_dt")).alias("report_date"))


@query
def latest_version(spark, d):
    return dedupe.latest_version(view(spark, d, "demo_raw"))


@query
def case_build(spark, d):
    cases = ingest.build_cases(view(spark, d, "demo_raw"))
    return cases.withColumn("age_years", F.round("age_years", 6))


@query
def dedupe_first(spark, d):
    return dedupe.keep_first(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"
    )


@query
def drug_build(spark, d):
    return ingest.build_drugs(view(spark, d, "drug_raw"), view(spark, d, "known_cases"), TARGETS)


@query
def target_filter(spark, d):
    raw = view(spark, d, "raw_names")
    return raw.where(X.contains_any(F.col("drugname_raw"), TARGETS))


@query
def first_target(spark, d):
    raw = view(spark, d, "raw_names")
    found = raw.withColumn("drug_norm", X.first_target(F.col("drugname_raw"), ["red", "ring", "bolt", "hcl"]))
    return found.where(F.col("drug_norm").isNotNull())


@query
def reac_build(spark, d):
    return ingest.build_reactions(view(spark, d, "reac_raw"), view(spark, d, "known_cases"))


def _flagged_cases(spark, d):
    known = view(spark, d, "known_cases")
    return ingest.apply_seriousness(known, ingest.case_seriousness(view(spark, d, "outc_raw")))


@query
def seriousness(spark, d):
    return _flagged_cases(spark, d)


@query
def serious_dist(spark, d):
    return ingest.seriousness_distribution(_flagged_cases(spark, d))


@query
def coverage(spark, d):
    return ingest.coverage(*_report_tables(spark, d))


@query
def table_counts(spark, d):
    given = {n: table(spark, d, n) for n in ("orders", "lineitem", "part", "documents", "events")}
    return readers.table_counts(given | {"not_there": None})


# --- drug names --------------------------------------------------------------------------

@query
def salt_strip(spark, d):
    raw = view(spark, d, "raw_names")
    return raw.select("p_partkey", X.strip_salts(F.col("drugname_raw")).alias("stripped"))


@query
def keyword_match(spark, d):
    return names.keyword_match(view(spark, d, "raw_names"), vocabulary=NOUNS)


def _lookup(spark, d):
    return names.vocabulary_lookup(view(spark, d, "terms_file"))


@query
def vocab_lookup(spark, d):
    return _lookup(spark, d)


@query
def fuzzy_match(spark, d):
    return names.fuzzy_match(view(spark, d, "raw_names"), _lookup(spark, d))


@query
def fuzzy_match_blocks(spark, d):
    """The same over a lookup that counts as too large to broadcast."""
    return names.fuzzy_match(view(spark, d, "raw_names"), _lookup(spark, d), max_lookup_rows=0, block_rows=500)


@query
def normalize_fuzzy(spark, d):
    """Fuzzy mapping stored, then written back to the drug rows."""
    lookup = _lookup(spark, d)
    drugs = view(spark, d, "raw_names").withColumns({c: F.lit(None).cast("string") for c in ("drugname_norm", "rxnorm_rxcui")})
    return flows.normalize_flow(drugs, scratch(spark, "normalized"), lookup)[1]


def _normalized(spark, d):
    return names.normalize_names(view(spark, d, "drug_names"), "keyword", vocabulary=NOUNS)


@query
def normalize_apply(spark, d):
    mapping = names.keyword_match(view(spark, d, "drug_names"), vocabulary=NOUNS)
    return names.apply_names(view(spark, d, "drug_names"), mapping)


@query
def normalize_direct(spark, d):
    return _normalized(spark, d)


@query
def norm_coverage(spark, d):
    return reports.normalisation_coverage(_normalized(spark, d))


@query
def variant_collapse(spark, d):
    return reports.variant_collapse(_normalized(spark, d), ["ring", "bolt"])


@query
def top_drugs(spark, d):
    return reports.top_drugs(view(spark, d, "case_drugs"))


@query
def match_stats(spark, d):
    return names.match_stats(names.keyword_match(view(spark, d, "raw_names"), vocabulary=NOUNS))


@query
def mapping_samples(spark, d):
    return names.mapping_samples(names.keyword_match(view(spark, d, "raw_names"), vocabulary=NOUNS))


@query
def distinct_terms(spark, d):
    return names.distinct_terms(view(spark, d, "raw_names"), "drugname_raw")


# --- reviews -----------------------------------------------------------------------------

@query
def html_clean(spark, d):
    return table(spark, d, "pages").select("page_id", X.clean_html(F.col("html")).alias("clean"))


@query
def word_filter(spark, d):
    kept = reviews.readable_reviews(table(spark, d, "documents").withColumnRenamed("text", "review"))
    return kept.select("doc_id", F.col("word_count").cast("long").alias("word_count"))


@query
def ae_flag(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", X.mentions_event(F.col("text"), STEMS).alias("has_ae_mention"))


@query
def review_id(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", X.review_id(F.col("source"), F.col("text")).alias("review_id"))


def _reviews(spark, d):
    return reviews.build_reviews(view(spark, d, "reviews_raw"), SOURCES, STEMS)


@query
def review_build(spark, d):
    return _reviews(spark, d)


@query
def review_dist(spark, d):
    return reviews.review_distribution(_reviews(spark, d))


@query
def label_sheet(spark, d):
    return sinks.label_sheet(_reviews(spark, d))


@query
def mentions(spark, d):
    return texts.mentions(view(spark, d, "reviews"), TERMS)


@query
def mention_coverage(spark, d):
    return reviews.mention_coverage(texts.mentions(view(spark, d, "reviews"), TERMS))


@query
def unprocessed(spark, d):
    done = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("review_id"))
    return reviews.unprocessed(view(spark, d, "reviews"), done).select("review_id", "drug_norm")


@query
def score_texts(spark, d):
    def score(batch):
        return [f"{len(t)}:{t.count('the')}" for t in batch]

    scored = texts.score_texts(table(spark, d, "documents"), score, "text")
    return scored.select("doc_id", "raw_output")


# --- triage ------------------------------------------------------------------------------

def _scored_outputs(spark, d):
    return triage.score_outputs(view(spark, d, "outputs"), BRANDS)


def _results(spark, d):
    return triage.triage(
        view(spark, d, "outputs"), view(spark, d, "term_map"), _stored_signals(spark, d), BRANDS
    )


def _flat(results: DataFrame) -> DataFrame:
    """Results with lists as text and signals as drug, reaction and PRR."""
    hits = F.transform(
        "prr_signals", lambda s: F.concat(s["drug"], F.lit("/"), s["reaction"], F.lit("/"), s["prr"].cast("string"))
    )
    scores = F.transform("mapping_scores", lambda s: s.cast("string"))
    return results.withColumns({"prr_signals": hits, "mapping_scores": scores}).select(
        "review_id", "drug_norm", *(joined(c) for c in (
            "extracted_drugs", "extracted_reactions", "meddra_pts", "mapping_scores", "prr_signals")),
        "severity", "extraction_confidence", "signal_flag", "needs_human_review", joined("agent_trace"),
    )


@query
def parse_output_rows(spark, d):
    parsed = parse_outputs(view(spark, d, "outputs"), "raw", "o")
    return parsed.select(
        "report_id", "attempt", F.array_join("o.drugs", "|").alias("drugs"),
        F.array_join("o.reactions", "|").alias("reactions"), F.col("o.severity").alias("severity"),
        F.col("o.method").alias("method"),
    )


@query
def confidence(spark, d):
    return _scored_outputs(spark, d).select("report_id", "attempt", "method", "severity", "confidence")


@query
def route_attempts(spark, d):
    return triage.route_attempts(_scored_outputs(spark, d)).select(
        "report_id", "route", "attempt", "confidence", joined("agent_trace")
    )


@query
def triage_results(spark, d):
    return _flat(_results(spark, d))


@query
def result_detail(spark, d):
    detail = reports.result_detail(triage.as_json(_results(spark, d)), view(spark, d, "reviews"))
    return detail.select("review_id", "extracted_drugs", "meddra_pts", "signal_flag", "review_text")


@query
def run_summary(spark, d):
    return reports.run_summary(_results(spark, d))


@query
def conf_hist(spark, d):
    return reports.confidence_histogram(_scored_outputs(spark, d), "confidence")


@query
def flag_dist(spark, d):
    return reports.flag_distribution(_results(spark, d))


@query
def recent_results(spark, d):
    dated = _results(spark, d).withColumn("processed_at", F.length("review_id") + F.size("agent_trace"))
    return reports.recent_results(dated, flag="low").select("review_id", "signal_flag", "processed_at")


@query
def trace_steps(spark, d):
    return reports.trace_steps(_results(spark, d))


def _bent(spark, d):
    vectors = table(spark, d, "embeddings")
    bent = F.transform("embedding", lambda x, i: F.when(i < 10, -x).otherwise(x))
    asked = vectors.select(F.concat(F.lit("q"), F.col("vec_id").cast("string")).alias("text"), bent.alias("embedding"))
    return asked, vectors.select(F.col("vec_id").alias("term"), "embedding")


@query
def nearest_term(spark, d):
    return nearest.nearest_term(*_bent(spark, d))


@query
def nearest_term_blocks(spark, d):
    """The same over a catalog that counts as too large to broadcast."""
    return nearest.nearest_term(*_bent(spark, d), max_catalog_rows=0, block_rows=2000)


@query
def term_map(spark, d):
    """Reaction texts of the outputs mapped to part names by their letter counts."""
    def embed(batch):
        return [[float(t.lower().count(c)) for c in "abdegilnort"] for t in batch]

    catalog = texts.embed_texts(table(spark, d, "part").select(F.col("p_name").alias("text")), embed)
    return flows.term_map(view(spark, d, "outputs"), catalog.withColumnRenamed("text", "term"), embed, BRANDS)


def _stand_in(batch, attempt):
    """A stand-in for a model: decides by the length of the text and the attempt."""
    good = '{"drugs": ["Brand#3"], "reactions": ["old bolt", "red gear"], "severity": "serious"}'
    return [good if (len(t) + attempt) % 5 < 2 else "nothing" for t in batch]


def _triaged(spark, d, out, *deliveries):
    terms = sinks.replace_table(view(spark, d, "term_map"), scratch(spark, "term_map"))
    signals = _stored_signals(spark, d)
    for rows in deliveries:
        done = flows.triage_flow(spark, rows, out, _stand_in, signals, lambda outputs: terms, BRANDS, limit=None)
    return done


@query
def triage_batch(spark, d):
    """All event-mentioning reviews scored, retried, and triaged."""
    done = _triaged(spark, d, scratch(spark, "batch"), view(spark, d, "reviews"))
    return _flat(done).select("review_id", "drug_norm", "meddra_pts", "prr_signals", "signal_flag", "needs_human_review", "agent_trace")


@query
def cached_summary(spark, d):
    """All reviews in two deliveries; the second brings each once more, half of them with another text."""
    out, first = scratch(spark, "batches"), view(spark, d, "reviews")
    again = first.withColumn("review_id", F.concat(F.lit("again-"), "review_id")).withColumn(
        "review_text", F.when(F.col("n_chars") % 2 == 0, F.col("review_text")).otherwise(F.concat("review_text", F.lit("!"))))
    _triaged(spark, d, out, first, first.unionByName(again))
    return reports.run_summary(spark.read.parquet(f"{out}/results"))


@query
def unprocessed_only(spark, d):
    """Open reviews among listed ids: those of the conversations."""
    done = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("review_id"))
    listed = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("review_id")).distinct()
    return reviews.unprocessed(view(spark, d, "reviews"), done, only=listed).select("review_id", "drug_norm")


@query
def latency_stats(spark, d):
    return reports.latency_stats(view(spark, d, "latencies"), digits=3)


# --- evaluation --------------------------------------------------------------------------

def _evaluated(spark, d):
    labels = view(spark, d, "label_rows")
    results = sinks.replace_table(_results(spark, d), scratch(spark, "results"))  # read twice below
    found = texts.mentions(evaluate.labelled(view(spark, d, "reviews"), labels, results), TERMS)
    return evaluate.scored_rows(labels, results, evaluate.baseline_drugs(found))


@query
def eval_f1(spark, d):
    rounded = ["drug_f1", "reaction_f1", "baseline_f1"]
    return _evaluated(spark, d).select("review_id", *(F.round(c, 6).alias(c) for c in rounded))


@query
def eval_accuracy(spark, d):
    return evaluate.evaluation(_evaluated(spark, d))


@query
def label_summary(spark, d):
    labels = view(spark, d, "label_rows")
    return evaluate.label_summary(labels.withColumn("severity_gt", F.lower("severity_gt")))


@query
def label_file(spark, d):
    """Label rows written as CSV and read back."""
    path = scratch(spark, "labels")
    sinks.write_csv(view(spark, d, "label_rows"), path)
    solid = F.length(F.regexp_replace("review_text_preview", "\\s", ""))
    return readers.read_labels(spark, path).select(
        "review_id", F.trim("drugs_gt").alias("drugs_gt"), "reactions_gt", "severity_gt", solid.alias("n_solid"))


@query
def metrics_json(spark, d):
    """The evaluation's averages written as JSON and read back."""
    path = scratch(spark, "metrics")
    sinks.write_metrics(evaluate.evaluation(_evaluated(spark, d)), path)
    return spark.read.json(path)


@query
def row_checks(spark, d):
    rows = view(spark, d, "reviews").withColumnRenamed("drug_norm", "drug_name").withColumn(
        "word_count", F.col("n_chars") - 50
    )
    checked = evaluate.check_rows(rows, evaluate.CHECKS["review"])
    return checked.select("review_id", joined("broken"))


# --- files and incremental jobs ----------------------------------------------------------

def _write_dollar(df: DataFrame, path: str) -> None:
    (
        df.write.option("sep", "$").option("header", "true")
        .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)
    )


def _write_quarters(spark, d) -> str:
    """Two quarters: the second has upper-case headers, no ``sex``, and no ``ascii`` folder."""
    raw = scratch(spark, "raw")
    early = F.col("fda_dt") < "1998"
    demo = view(spark, d, "demo_raw")
    first, second = f"{raw}/faers_ascii_2024Q4/ascii", f"{raw}/faers_ascii_2025Q1"
    _write_dollar(demo.where(F.coalesce(early, F.lit(False))), f"{first}/DEMO24Q4.txt")
    late = demo.where(~F.coalesce(early, F.lit(False))).drop("sex")
    _write_dollar(late.toDF(*[c.upper() + " " for c in late.columns]), f"{second}/demo25q1.TXT")
    _write_dollar(view(spark, d, "drug_raw"), f"{first}/DRUG24Q4.txt")
    _write_dollar(view(spark, d, "reac_raw"), f"{second}/REAC25Q1.txt")
    _write_dollar(view(spark, d, "outc_raw"), f"{first}/OUTC24Q4.txt")
    return raw


@query
def src_quarters(spark, d):
    found = readers.discover_quarters(spark, _write_quarters(spark, d))
    return readers.table_counts({
        f"{quarter} {kind} {path.rsplit('/', 1)[-1]}": readers.read_dollar(spark, path)
        for quarter, files in found.items() for kind, path in files.items()
    })


@query
def src_dollar_csv(spark, d):
    path = scratch(spark, "DEMO24Q4.txt")
    demo = view(spark, d, "demo_raw")
    _write_dollar(demo.toDF(*[c.upper() + " " for c in demo.columns]), path)
    return readers.read_dollar(spark, path, ["CASEID", "age", "sex", "fda_dt", "not_there"])


@query
def union_quarters(spark, d):
    found = readers.discover_quarters(spark, _write_quarters(spark, d))
    return readers.read_quarters(spark, found, "DEMO").select("caseid", "caseversion", "fda_dt", "sex")


@query
def src_reviews(spark, d):
    folder = scratch(spark, "reviews")
    rows = table(spark, d, "documents").select(
        F.col("source").alias("drugName"), F.col("text").alias("review"), "doc_id", "lang"
    )
    for name, part in (
        ("drugsComTrain_raw.tsv", rows.where("lang = 'en'")), ("drugsComTest_raw.csv", rows.where("lang <> 'en'"))
    ):
        part.drop("lang").write.option("sep", "\t" if name.endswith("tsv") else ",").option("header", "true") \
            .option("escape", '"').option("quoteAll", "true").csv(f"{folder}/{name}")
    return readers.read_reviews(spark, folder).select("drugname", "review", "doc_id", "source")


@query
def src_vocab(spark, d):
    path = scratch(spark, "RxTerms.txt")
    terms = view(spark, d, "terms_file")
    lowered = terms.toDF(*[c.lower() + " " for c in terms.columns])
    lowered.write.option("sep", "|").option("header", "true").csv(path)
    return names.vocabulary_lookup(readers.read_vocabulary(spark, path))


@query
def snk_parquet(spark, d):
    path = scratch(spark, "lookup")
    first = sinks.stored_or_built(spark, path, lambda: _lookup(spark, d))
    second = sinks.stored_or_built(spark, path, lambda: first.limit(0))
    return second.select("display_name", "rxcui", "generic_name")


@query
def upsert(spark, d):
    """Orders with the corrections in the line items written over them, stored in versions."""
    base = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"), F.lit("order").alias("origin")
    )
    new = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.max("l_extendedprice").alias("amount")
    ).where("amount > 60000").withColumn("origin", F.lit("line"))
    merged = dedupe.upsert(base, new, ["id"])
    path = scratch(spark, "versions")
    sinks.append_version(merged, path, 0)
    sinks.append_version(new.withColumn("origin", F.lit("again")), path, 1)
    return sinks.current_rows(spark.read.parquet(path), ["id"])


def _ingested(spark, d) -> str:
    out = scratch(spark, "tables")
    raw = _write_quarters(spark, d)
    stages.ingest_reports(spark, raw, out, targets=TARGETS)
    if stages.ingest_reports(spark, raw, out, targets=TARGETS):
        raise AssertionError("a finished stage was built again")
    return out


@query
def ingest_flow(spark, d):
    out = _ingested(spark, d)
    return ingest.coverage(*(spark.read.parquet(f"{out}/{t}") for t in stages.STAGES))


@query
def stage_status(spark, d):
    return stages.stage_status(spark, _ingested(spark, d))


@query
def stream_triage(spark, d):
    """Attempts arrive in three deliveries, the last with the first once more."""
    source, out = scratch(spark, "arrivals"), scratch(spark, "stream")
    outputs = view(spark, d, "outputs")
    terms = sinks.replace_table(view(spark, d, "term_map"), scratch(spark, "term_map"))
    known = _stored_signals(spark, d)
    for delivery in ("attempt = 1", "attempt = 2", "attempt <> 2"):
        outputs.where(delivery).write.mode("append").parquet(source)
        triage_stream.stream_triage(
            spark, source, out, lambda batch: triage.triage(batch, terms, known, BRANDS), vocabulary=BRANDS
        )
    return _flat(triage_stream.stream_results(spark, out))


QUERIES["parse_output"] = QUERIES.pop("parse_output_rows")
QUERIES["triage"] = QUERIES.pop("triage_results")
