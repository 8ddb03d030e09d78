"""Parsing, confidence, routing, triage, reports on results, evaluation, row checks."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from casewatch.functions.parsing import parse_outputs
from casewatch.functions.scoring import set_f1
from casewatch.operators import lookup, texts
from casewatch.plans import evaluate, flows, reports, triage

GOOD = '{"drugs": ["ibuprofen"], "reactions": ["gastrointestinal bleeding", "stomach cramps"], "severity": "serious"}'
CASES = [
    (GOOD, (["ibuprofen"], ["gastrointestinal bleeding", "stomach cramps"], "serious", "json")),
    ("```json\n" + GOOD + "\n```", (["ibuprofen"], ["gastrointestinal bleeding", "stomach cramps"], "serious", "json")),
    ("```\n" + GOOD + "```  ", (["ibuprofen"], ["gastrointestinal bleeding", "stomach cramps"], "serious", "json")),
    ('Sure!\n{"drugs": ["x"],\n "reactions": [], "severity": "mild"} Bye.', (["x"], [], "mild", "json")),
    (GOOD + " trailing", (["ibuprofen"], ["gastrointestinal bleeding", "stomach cramps"], "serious", "json")),
    ('{"drugs": ["x", "y"], "reactions": ["q"], "severity": "ser', (["x", "y"], ["q"], "unknown", "regex_fallback")),
    ('"reactions" : [ \'a\' , "b",, ] "severity": "serious"', ([], ["a", "b"], "serious", "regex_fallback")),
    ('{"drugs": "ibuprofen", "reactions": ["q"], "severity": "unknown"}', ([], ["q"], "unknown", "json")),
    ('{"drugs": ["a"], "drugs": ["b"]}', (["b"], [], None, "json")),
    ("{}", ([], [], None, "json")),
    ('{"drugs": null, "reactions": [], "severity": null}', ([], [], None, "json")),
    ('{"a": 1} {"b": 2}', None), ("{'drugs': ['a']}", None), ('["a"]', None), ("", None), ("  \n ", None), (None, None), ("no json", None),
    ('{"drugs": ["x"],}', (["x"], [], "unknown", "regex_fallback")),
]


@pytest.mark.parametrize("place", range(len(CASES)))
def test_parse_outputs(spark, place):
    raw, want = CASES[place]
    got = parse_outputs(spark.createDataFrame([(raw,)], "raw string")).first().output
    assert (tuple(got) if got else None) == want


CONFIDENCE = [
    (GOOD, 1.0), ('{"drugs": ["ibuprofen"], "reactions": [], "severity": "unknown"}', 0.883),
    ('{"drugs": ["penicillin"], "reactions": ["a"], "severity": "unknown"}', 0.75),
    ('{"drugs": ["penicillin", "Advil PM"], "reactions": ["a"], "severity": "unknown"}', 0.875),
    ('{"drugs": [], "reactions": [], "severity": "mild"}', 0.4), ('{"drugs": [], "reactions": []}', 0.4),
    ('{"drugs": [], "reactions": ["a"], "severity": "unknown"}', 0.633), ("junk", 0.0), (None, 0.0),
]


def test_confidence(spark):
    df = spark.createDataFrame([(str(i), 1, r) for i, (r, _) in enumerate(CONFIDENCE)], "report_id string, attempt int, raw string")
    got = triage.score_outputs(df).orderBy("report_id").collect()
    assert [r.confidence for r in got] == [c for _, c in CONFIDENCE]
    assert got[5].severity == "unknown" and got[4].severity == "mild" and got[7].method == "failed"


def scored(spark, data):
    df = spark.createDataFrame(data, "report_id string, attempt int, confidence double")
    return df.withColumns({
        "drugs": F.array(F.lit("d1"), F.lit("d2"), F.lit("d3"), F.lit("d4")), "reactions": F.array(F.lit("r")),
        "severity": F.lit("unknown"), "parsed": F.lit(True),
    })


def test_routes(spark):
    got = {r.report_id: r for r in triage.route_attempts(scored(spark, [
        ("high", 1, 0.85), ("exact", 1, 0.75), ("first", 1, 0.4), ("second", 1, 0.4), ("second", 2, 0.4),
        ("third", 1, 0.4), ("third", 2, 0.4), ("third", 3, 0.4), ("late", 1, 0.4), ("late", 2, 0.9), ("late", 3, 0.8),
        ("beyond", 1, 0.4), ("beyond", 2, 0.4), ("beyond", 3, 0.4), ("beyond", 4, 1.0), ("twice", 1, 0.4), ("twice", 1, 0.4),
    ])).collect()}
    assert {k: (v.route, v.attempt) for k, v in got.items()} == {
        "high": ("map_terms", 1), "exact": ("map_terms", 1), "first": ("extract", 1), "second": ("extract", 2),
        "third": ("flag_human", 3), "late": ("map_terms", 2), "beyond": ("flag_human", 3), "twice": ("extract", 1),
    }
    assert got["late"].agent_trace == [
        "EXTRACTION:1,conf=0.4,drugs=d1,d2,d3", "VALIDATION:conf=0.4,retries=1",
        "EXTRACTION_RETRY:2,conf=0.9,drugs=d1,d2,d3", "VALIDATION:conf=0.9,retries=2",
    ]
    assert sum(t.startswith("EXTRACTION") for t in got["beyond"].agent_trace) == 3


SIGNALS = "drug string, reaction string, prr double, ror double, chi2 double, n_cases long, is_signal boolean, masking_warning boolean"


@pytest.fixture(scope="module")
def results(spark):
    outputs = spark.createDataFrame([
        ("ok", 1, GOOD, "ibuprofen"), ("none", 1, '{"drugs": ["advil"], "reactions": [], "severity": "unknown"}', "advil"),
        ("retry", 1, "junk", "x"), ("retry", 2, '{"drugs": ["Aspirin"], "reactions": ["cramps", "cramps"], "severity": "serious"}', "x"),
        ("bad", 1, "junk", "x"), ("bad", 2, "", "x"), ("bad", 3, '{"drugs": [], "reactions": ["cramps"], "severity": "mild"}', "x"), ("open", 1, "junk", "x"),
    ], "report_id string, attempt int, raw string, drug_norm string")
    terms = spark.createDataFrame([("gastrointestinal bleeding", "Gastrointestinal haemorrhage", 0.93), ("cramps", "Muscle cramp", 0.9)], "text string, mapped_term string, similarity double")
    signals = spark.createDataFrame([
        ("ibuprofen", "Gastrointestinal haemorrhage", 5.1234, 6.0, 40.0, 12, True, False), ("aspirin", "muscle cramp", 2.5, 2.6, 9.0, 4, True, True),
        ("ibuprofen", "stomach cramps", 11.0, 11.0, 1.0, 3, False, False),
    ], SIGNALS)
    return triage.triage(outputs, terms, signals).cache()


def test_triage(results):
    got = {r.review_id: r for r in results.collect()}
    assert set(got) == {"ok", "none", "retry", "bad"}
    ok = got["ok"]
    assert (ok.meddra_pts, ok.mapping_scores, ok.signal_flag, ok.needs_human_review) == (["Gastrointestinal haemorrhage", "stomach cramps"], [0.93, 0.0], "medium", False)
    assert [(s.drug, s.prr, s.n_cases) for s in ok.prr_signals] == [("ibuprofen", 5.123, 12)]
    assert ok.agent_trace == [
        "EXTRACTION:1,conf=1.0,drugs=ibuprofen", "VALIDATION:conf=1.0,retries=1",
        "MAPPING:reactions=2,top_pt=Gastrointestinal haemorrhage,top_score=0.93", "SIGNAL_CHECK:signals=1,flag=medium,top_prr=5.12",
    ]
    assert got["none"].agent_trace[2:] == ["MAPPING:no_reactions_to_map", "SIGNAL_CHECK:no_input,flag=noise"]
    assert (got["none"].signal_flag, got["none"].meddra_pts, got["none"].prr_signals) == ("noise", [], [])
    assert got["retry"].meddra_pts == ["Muscle cramp"] * 2 and len(got["retry"].prr_signals) == 2 and got["retry"].signal_flag == "low"
    bad = got["bad"]
    assert (bad.signal_flag, bad.needs_human_review, bad.meddra_pts, bad.mapping_scores, bad.prr_signals, bad.extracted_reactions) == (None, True, [], [], [], ["cramps"])
    assert bad.agent_trace[-1] == "HUMAN_FLAG:reason=low_confidence" and len(bad.agent_trace) == 7 and bad.agent_trace[0] == "EXTRACTION:1,conf=0.0,drugs=none"
    assert {r: got[r].drug_norm for r in got} == {"ok": "ibuprofen", "none": "advil", "retry": "x", "bad": "x"}


def test_outputs_need_no_more_than_id_attempt_and_text(spark, results):
    outputs = spark.createDataFrame([("1", 1, GOOD)], "report_id string, attempt int, raw string")
    terms = spark.createDataFrame([], "text string, mapped_term string, similarity double")
    got = triage.triage(outputs, terms, spark.createDataFrame([], SIGNALS))
    assert got.columns == triage.RESULT_COLUMNS and got.first().drug_norm is None and got.first().meddra_pts[0] == "gastrointestinal bleeding"


def test_cached_outputs_leave_their_mark(spark):
    df = spark.createDataFrame([("1", 1, '{"drugs": [], "reactions": ["a"]}', True)], "report_id string, attempt int, raw string, cached boolean")
    trace = triage.route_attempts(triage.score_outputs(df)).first().agent_trace
    assert trace[0] == "EXTRACTION:1,cached=True,conf=0.517,drugs=none"


def test_json_round_trip(results):
    text = triage.as_json(results)
    assert dict(text.dtypes)["prr_signals"] == "string"
    assert rows(triage.from_json_text(text)) == rows(results)
    assert triage.from_json_text(text.withColumn("meddra_pts", F.lit(None).cast("string"))).first().meddra_pts == []


def test_reports_on_results(spark, results):
    summary = reports.run_summary(results).first()
    assert (summary.n, summary.confident, summary.human_flagged, summary.mapped, summary.cached) == (4, 3, 1, 3, 0)
    assert (summary.flag_medium, summary.flag_low, summary.flag_noise, summary.with_signals) == (1, 1, 2, 2)
    assert rows(reports.flag_distribution(results)) == [(None, 1), ("low", 1), ("medium", 1), ("noise", 1)]
    steps = reports.trace_steps(results.where("review_id = 'ok'")).collect()
    assert [(r.step, r.stage) for r in steps] == [(1, "EXTRACTION"), (2, "VALIDATION"), (3, "MAPPING"), (4, "SIGNAL_CHECK")]
    dated = results.withColumn("processed_at", F.length("review_id"))
    assert [r.review_id for r in reports.recent_results(dated, 2).collect()] == ["retry", "none"]
    assert [r.review_id for r in reports.recent_results(dated, 2, "low").collect()] == ["retry"]
    assert reports.recent_results(dated, 2, "medium").isEmpty()
    texts = spark.createDataFrame([("ok", "text")], "review_id string, review_text string")
    assert reports.result_detail(results, texts).first().review_text == "text"
    hist = spark.createDataFrame([(0.0,), (0.049,), (0.05,), (0.75,), (1.0,), (None,)], "extraction_confidence double")
    assert {r.bin: r.n for r in reports.confidence_histogram(hist).collect()} == {1: 2, 2: 1, 16: 1, 20: 1}
    latency = spark.createDataFrame([(1.0, None, 4.0), (3.0, 5.0, None), (None, 99.0, 99.0)], "extract_latency_ms double, map_terms_latency_ms double, signal_check_latency_ms double")
    assert tuple(reports.latency_stats(latency).first()) == (2.0, 5.0, 4.0, 3.0, 5.0, 4.0)


def test_map_terms_with_many_empty_reports(spark):
    df = spark.createDataFrame([(str(i), ["a", "b"] if i % 10 == 0 else []) for i in range(100)], "report_id string, reactions array<string>")
    terms = spark.createDataFrame([("b", "B", 0.9)], "text string, mapped_term string, similarity double")
    got = lookup.map_terms(df, terms).collect()
    assert len(got) == 100 and all(r.meddra_pts == (["a", "B"] if r.reactions else []) for r in got)


@pytest.mark.parametrize("truth,found,f1", [
    ([], [], 1.0), (["a"], [], 0.0), ([], ["a"], 0.0), (["a"], ["b"], 0.0), (["A ", "b"], ["a", "c", "a"], 0.5), ([" ", ""], [None], 1.0), (["a", "b", "c"], ["a", "b"], 0.8),
])
def test_set_f1(spark, truth, found, f1):
    df = spark.createDataFrame([(truth, found)], "t array<string>, p array<string>")
    assert df.select(set_f1(F.col("t"), F.col("p"))).first()[0] == pytest.approx(f1)


def test_evaluation(spark, results):
    labels = spark.createDataFrame([
        ("ok", "Ibuprofen, aspirin", "stomach cramps", "SERIOUS"), ("none", "advil", None, "serious"), ("bad", "x", "cramps", None),
        ("retry", "", "a", "unknown"), ("gone", "x", None, "unknown"),
    ], "review_id string, drugs_gt string, reactions_gt string, severity_gt string")
    base = spark.createDataFrame([("ok", ["ibuprofen", "aspirin"])], "review_id string, baseline_drugs array<string>")
    got = evaluate.evaluation(evaluate.scored_rows(labels, results, base)).first()
    assert got.n_evaluated == 3
    assert got.drug_extraction_f1 == round((2 / 3 + 1 + 0) / 3, 3) and got.reaction_extraction_f1 == round((2 / 3 + 1 + 1) / 3, 3)
    assert got.severity_accuracy == 0.333 and got.meddra_mapping_accuracy == 0.667 and got.baseline_drug_f1 == 0.333
    assert evaluate.evaluation(evaluate.scored_rows(labels, results)).first().baseline_drug_f1 == 0.0
    assert tuple(evaluate.label_summary(labels).first()) == (5, 1, 0, 2, 3, 2)
    found = spark.createDataFrame([("1", "Aspirin", "CHEMICAL"), ("1", "aspirin", "CHEMICAL"), ("1", "pain", "DISEASE")], "review_id string, entity_text string, entity_label string")
    assert evaluate.baseline_drugs(found).collect()[0].baseline_drugs == ["aspirin"]


def test_row_checks(spark):
    df = spark.createDataFrame([("1", 7, 3, "a", "t"), ("2", 11, 3, "a", "t"), ("3", None, -1, None, "t")], "review_id string, rating int, word_count int, drug_name string, review_text string")
    valid, rejected = evaluate.split_rows(df, evaluate.CHECKS["review"])
    assert rows(valid.select("review_id")) == [("1",)]
    assert {r.review_id: r.broken for r in rejected.collect()} == {"2": ["rating"], "3": ["rating", "word_count", "drug_name"]}
    bare = evaluate.with_defaults(spark.createDataFrame([("x",)], "id string"), evaluate.DEFAULTS["extraction"])
    assert tuple(bare.first()) == ("x", "unknown", "", "failed")
    assert evaluate.check_rows(bare, evaluate.CHECKS["extraction"]).first().broken == []


def test_attempts_are_scored_only_while_they_fall_short(spark, tmp_path):
    todo = spark.createDataFrame([(f"r{i}", f"text {i}", "d") for i in range(6)], "review_id string, review_text string, drug_norm string")

    def score(batch, attempt):
        return [GOOD if int(t.split()[1]) < 2 * attempt else "junk" for t in batch]

    outputs = flows.score_attempts(todo, score, str(tmp_path / "outputs"))
    assert rows(outputs.groupBy("attempt").count()) == [(1, 6), (2, 4), (3, 2)]

    signals = spark.createDataFrame([("ibuprofen", "BLEED", 4.0, 4.0, 9.0, 5, True, False)], SIGNALS)
    reviews = todo.withColumn("has_ae_mention", F.lit(True))

    def terms(outputs):
        catalog = spark.createDataFrame([("Bleed", [1.0, 0.0]), ("Cramp", [0.0, 1.0])], "term string, embedding array<double>")
        return flows.term_map(outputs, catalog, lambda b: [[1.0, 0.0] if "bleed" in t else [0.1, 1.0] for t in b])

    first = flows.triage_flow(spark, reviews, str(tmp_path / "t"), score, signals, terms, limit=4)
    assert {r.review_id for r in first.collect()} == {"r0", "r1", "r2", "r3"}
    assert first.first().meddra_pts == ["Bleed", "Cramp"] and first.first().signal_flag == "low"
    second = flows.triage_flow(spark, reviews, str(tmp_path / "t"), score, signals, terms, limit=4)
    assert {r.review_id for r in second.collect()} == {"r4", "r5"}


def test_attempts_wait_for_earlier_ones(spark):
    late = GOOD.replace("ibuprofen", "aspirin")
    kind = "report_id string, attempt int, raw string"
    both = spark.createDataFrame([("a", 2, late), ("a", 1, GOOD)], kind)
    second = spark.createDataFrame([("a", 2, late), ("b", 1, "junk"), ("b", 3, late)], kind)
    got = triage.route_attempts(triage.score_outputs(both)).first()
    assert (got.route, got.attempt, got.drugs) == ("map_terms", 1, ["ibuprofen"])
    waiting = {r.report_id: r for r in triage.route_attempts(triage.score_outputs(second)).collect()}
    assert (waiting["a"].route, waiting["a"].attempt, waiting["a"].agent_trace) == ("extract", None, [])
    assert (waiting["b"].route, waiting["b"].attempt) == ("extract", 1)


def test_a_failing_text_has_null_output(spark):
    df = spark.createDataFrame([("1", "good"), ("2", "bad"), ("3", None)], "review_id string, review_text string")

    def score(batch):
        if "bad" in batch:
            raise ValueError("model call failed")
        return [t.upper() for t in batch]

    got = texts.score_texts(df, score)
    assert rows(got.select("review_id", "raw_output")) == [("1", "GOOD"), ("2", None), ("3", None)]


def test_only_labelled_reviews_are_tagged(spark):
    reviews = spark.createDataFrame([("1", "x"), ("2", "y"), ("3", "z")], "review_id string, review_text string")
    labels = spark.createDataFrame([("1", "a"), ("2", ""), ("3", "b")], "review_id string, drugs_gt string")
    results = spark.createDataFrame([("1",), ("2",)], "review_id string")
    assert rows(evaluate.labelled(reviews, labels, results)) == [("1", "x")]


def test_a_text_is_scored_once_an_attempt_over_all_batches(spark, tmp_path):
    kind = "review_id string, review_text string, drug_norm string"
    calls = spark.sparkContext.accumulator(0)

    def score(batch, attempt):
        calls.add(len(batch))
        if any(t == "broken" for t in batch):
            raise ValueError("model call failed")
        return [GOOD if t.startswith("good") or attempt == 2 else "junk" for t in batch]

    def run(number, *texts_):
        todo = spark.createDataFrame([(f"{number}-{i}", t, "d") for i, t in enumerate(texts_)], kind)
        out = flows.score_attempts(todo, score, str(tmp_path / f"outputs-{number}"), cache=str(tmp_path / "cache"), batch=number)
        found = {(r.report_id, r.attempt): (r.raw, r.cached) for r in out.collect()}
        seen, calls.value = calls.value, 0
        return found, seen

    first, scored = run(0, "good a", "good a", "bad b", None)
    assert scored == 3 and first["0-0", 1] == first["0-1", 1] == (GOOD, False) and first["0-2", 2] == (GOOD, False)
    assert first["0-3", 1] == (None, False)
    for _ in range(2):  # a batch that runs again scores what it scored, and replaces it in the store
        second, scored = run(1, "good a", "bad b", "good c")
        assert scored == 1 and second["1-0", 1] == (GOOD, True) and second["1-1", 1] == ("junk", True)
        assert second["1-1", 2] == (GOOD, True) and second["1-2", 1] == (GOOD, False)
    third, scored = run(2, "good c", "broken")
    assert third["2-0", 1] == (GOOD, True) and third["2-1", 1] == (None, False)
    assert run(3, "broken")[1] > 0  # no output was kept for it


def test_cached_reviews_are_counted(spark, tmp_path):
    signals = spark.createDataFrame([], SIGNALS)
    terms = spark.createDataFrame([], "text string, mapped_term string, similarity double")
    kind = "review_id string, review_text string, drug_norm string, has_ae_mention boolean"

    def batch(*ids):
        rows_ = spark.createDataFrame([(i, f"text {i[-1]}", "d", True) for i in ids], kind)
        return flows.triage_flow(spark, rows_, str(tmp_path / "t"), lambda b, a: [GOOD] * len(b), signals, lambda o: terms)

    assert reports.run_summary(batch("a1", "a2")).first().cached == 0
    summary = reports.run_summary(batch("b1", "b3")).first()
    assert (summary.n, summary.cached) == (2, 1)


def test_attempts_take_each_text_from_the_delivery_by_its_hash(spark, tmp_path):
    table = texts.with_hash(spark.createDataFrame(
        [("1", "d", "long enough"), ("2", "d", "long enough"), ("3", "e", "no"), ("4", "e", None), ("5", "e", "done before")],
        "review_id string, drug_norm string, review_text string"))

    def score(batch, attempt):
        return ['{"drugs": ["ibuprofen"], "reactions": ["a"], "severity": "serious"}' if len(t) > 4 or attempt == 2 else f"junk {t}" for t in batch]

    todo = table.where("review_id <> '5'")
    whole = rows(flows.score_attempts(todo.drop("_hash"), score, str(tmp_path / "a")).select("report_id", "attempt", "raw"))
    light = flows.score_attempts(todo.drop("review_text"), score, str(tmp_path / "b"), delivered=table)
    assert rows(light.select("report_id", "attempt", "raw")) == whole
    assert [r[:2] for r in whole] == [("1", 1), ("2", 1), ("3", 1), ("3", 2), ("4", 1), ("4", 2), ("4", 3)]
