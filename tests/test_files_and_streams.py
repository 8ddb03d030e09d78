"""Readers, writers, resumable ingest, streaming triage."""

import random

import pytest
from conftest import rows

from casewatch.operators import names
from casewatch.plans import flows, triage
from casewatch.session import scratch
from casewatch.sources import readers, sinks
from casewatch.streaming import stages, triage_stream


def write(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode(encoding))


@pytest.fixture
def raw(tmp_path):
    q4, q1 = tmp_path / "raw/faers_ascii_2024Q4/ascii", tmp_path / "raw/faers_ascii_2025q1"
    write(q4 / "DEMO24Q4.txt", "PrimaryID$CASEID $caseversion$age$age_cod$fda_dt$sex\n1$10$1$30$YR$20240101$f\n2$10$2$31$YR$20240201$f\n3$11$1$x$YR$2024$M$extra$more\n4$12\n")
    write(q4 / "drug24q4.TXT", b"caseid$drug_seq$prod_ai$drugname\n10$1$ASPIRIN$x\n10$1$IBUPROFEN$y\n11$1$$Advil ibuprofen \xff\n99$1$ASPIRIN$x\n")
    write(q4 / "REAC24Q4.txt", "caseid$pt\n10$Rash \n10$Rash\n10$Cough\n12$Pain\n99$Pain\n")
    write(q4 / "OUTC24Q4.txt", "caseid$outc_cod\n10$OT\n10$ho\n11$OT\n")
    write(q4 / "README.md", "no data")
    write(tmp_path / "raw/faers_ascii_2024Q4/DEMO_other.txt", "ignored, as there is an ascii folder")
    write(q1 / "DEMO25Q1.txt", "caseid$caseversion$event_dt\n10$3$20250101\n13$1$20250102\n")
    write(tmp_path / "raw/other/DEMO.txt", "ignored")
    return str(tmp_path / "raw")


def test_discovery(spark, raw):
    found = readers.discover_quarters(spark, raw)
    assert {q: sorted(f) for q, f in found.items()} == {"2024Q4": ["DEMO", "DRUG", "OUTC", "REAC"], "2025q1": ["DEMO"]}
    assert found["2024Q4"]["DEMO"].endswith("/ascii/DEMO24Q4.txt")


def test_dollar_reader(spark, raw):
    found = readers.discover_quarters(spark, raw)
    demo = readers.read_dollar(spark, found["2024Q4"]["DEMO"])
    assert demo.columns == ["primaryid", "caseid", "caseversion", "age", "age_cod", "fda_dt", "sex"]
    by_id = {r.primaryid: r for r in demo.collect()}
    assert by_id["3"].sex == "M" and by_id["4"].caseid == "12" and by_id["4"].sex is None
    assert readers.read_dollar(spark, found["2024Q4"]["DEMO"], ["CaseID", "none", "sex"]).columns == ["caseid", "sex"]
    assert "�" in readers.read_dollar(spark, found["2024Q4"]["DRUG"]).where("caseid = '11'").first().drugname
    both = readers.read_quarters(spark, found, "DEMO")
    assert both.count() == 6 and both.where("event_dt is not null and fda_dt is null").count() == 2
    assert readers.read_quarters(spark, {}, "DEMO") is None


def test_ingest_resumes_after_the_last_finished_stage(spark, raw, tmp_path):
    out = str(tmp_path / "tables")
    assert not any(r.finished for r in stages.stage_status(spark, out).collect())
    with pytest.raises(RuntimeError):
        def broken():
            raise RuntimeError("lost")
        stages.run_stages(spark, out, {"cases": broken})
    with pytest.raises(ValueError):  # 1000 cases are expected unless a caller knows better
        stages.ingest_reports(spark, raw, out)
    assert not any(r.finished for r in stages.stage_status(spark, out).collect())
    assert stages.ingest_reports(spark, raw, out, least=4) == ["cases", "drugs", "reactions"]
    assert stages.ingest_reports(spark, raw, out) == []
    assert rows(stages.stage_status(spark, out)) == [("cases", 4, True), ("drugs", 2, True), ("reactions", 3, True)]
    cases = {r.caseid: r for r in spark.read.parquet(out + "/cases").collect()}
    assert cases["10"].caseversion == 3 and cases["10"].serious is True and cases["11"].serious is False and cases["13"].serious is None
    assert rows(spark.read.parquet(out + "/reactions")) == [("10", 1, "Cough"), ("10", 2, "Rash"), ("12", 1, "Pain")]
    assert {r.drugname_raw[:5] for r in spark.read.parquet(out + "/drugs").collect()} == {"ASPIR", "Advil"}


def test_a_table_without_its_mark_is_built_again(spark, tmp_path):
    out = str(tmp_path)
    old = spark.range(3).withColumnRenamed("id", "n")
    sinks.replace_table(old, out + "/cases")  # written, but the stage did not finish
    assert stages.run_stages(spark, out, {"cases": lambda: spark.range(5)}) == ["cases"]
    assert spark.read.parquet(out + "/cases").count() == 5


@pytest.mark.parametrize("text", ["rxcui|FULL_NAME |generic_name\n1|Advil|Ibuprofen\n", "rxcui\tFULL_NAME\tgeneric_name\n1\tAdvil\tIbuprofen\n"])
def test_vocabulary_separator_and_cache(spark, tmp_path, text):
    write(tmp_path / "terms.txt", text)
    lookup = flows.drug_lookup(spark, str(tmp_path / "lookup"), str(tmp_path / "terms.txt"))
    assert rows(lookup) == [("ADVIL", "1", "ibuprofen"), ("IBUPROFEN", "1", "ibuprofen")]
    again = flows.drug_lookup(spark, str(tmp_path / "lookup"), "not there")
    assert rows(again) == rows(lookup) and names.fuzzy_match(spark.createDataFrame([("advil",)], "drugname_raw string"), again).first().rxnorm_rxcui == "1"


def test_table_counts_and_metrics(spark, tmp_path):
    counts = readers.table_counts({"a": spark.range(4), "b": None})
    assert rows(counts) == [("a", 4), ("b", 0)]
    sinks.write_metrics(counts, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 2
    assert sinks.read_if_present(spark, str(tmp_path / "none")) is None


def test_versions(spark, tmp_path):
    path = str(tmp_path / "v")
    assert sinks.next_version(None) == 0
    sinks.append_version(spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), path, 0)
    for _ in range(2):  # a batch that runs twice counts once
        sinks.append_version(spark.createDataFrame([(2, "B")], "id int, v string"), path, 1)
    table = spark.read.parquet(path)
    assert sinks.next_version(table) == 2 and rows(sinks.current_rows(table, ["id"])) == [(1, "a"), (2, "B")]
    small = sinks.compact_versions(spark, path, ["id"], str(tmp_path / "w"))
    assert small.count() == 2 and sinks.next_version(small) == 2
    assert rows(sinks.current_rows(small, ["id"])) == [(1, "a"), (2, "B")]


def test_scratch_is_below_the_shared_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    assert scratch(spark, "x").startswith(base) and scratch(spark, "x") != scratch(spark, "x")


def test_streaming_triage_is_idempotent_and_waits_for_attempts(spark, tmp_path):
    good = '{"drugs": ["ibuprofen"], "reactions": ["a"], "severity": "serious"}'
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    terms = spark.createDataFrame([("a", "A", 0.9)], "text string, mapped_term string, similarity double")
    signals = spark.createDataFrame([], "drug string, reaction string, prr double, ror double, chi2 double, n_cases long, is_signal boolean, masking_warning boolean")

    def deliver(data):
        spark.createDataFrame(data, "report_id string, attempt int, raw string").coalesce(1).write.mode("append").parquet(source)
        triage_stream.stream_triage(spark, source, out, lambda b: triage.triage(b, terms, signals), files_per_batch=1)
        return {r.review_id: (r.needs_human_review, len(r.agent_trace)) for r in triage_stream.stream_results(spark, out).collect()}

    assert deliver([("1", 1, good), ("1", 1, good), ("2", 1, "junk"), ("3", 1, "junk")]) == {"1": (False, 4)}
    assert deliver([("2", 2, good), ("3", 2, "junk"), ("1", 1, "junk")]) == {"1": (False, 4), "2": (False, 6)}
    third = deliver([("3", 3, "junk"), ("2", 2, good)])
    assert third == {"1": (False, 4), "2": (False, 6), "3": (True, 7)}
    triage_stream.stream_triage(spark, source, out, lambda b: triage.triage(b, terms, signals))
    assert triage_stream.stream_results(spark, out).count() == 3


def test_shuffled_repeated_and_late_deliveries_equal_the_batch(spark, tmp_path):
    draw = random.Random(8)
    good = '{"drugs": ["ibuprofen"], "reactions": ["a"], "severity": "serious"}'
    data = [(f"r{i}", a, good if draw.random() < 0.3 else "junk") for i in range(40) for a in range(1, draw.randint(1, 3) + 1)]
    kind = "report_id string, attempt int, raw string"
    terms = spark.createDataFrame([("a", "A", 0.9)], "text string, mapped_term string, similarity double")
    signals = spark.createDataFrame([], "drug string, reaction string, prr double, ror double, chi2 double, n_cases long, is_signal boolean, masking_warning boolean")
    whole = rows(triage.triage(spark.createDataFrame(data, kind), terms, signals))
    sent = data + draw.sample(data, 30) + [("r1", 4, good), (None, 1, good), ("r2", 0, good)]
    draw.shuffle(sent)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for at in range(0, len(sent), 45):
        spark.createDataFrame(sent[at : at + 45], kind).coalesce(1).write.mode("append").parquet(source)
        triage_stream.stream_triage(spark, source, out, lambda b: triage.triage(b, terms, signals))
    assert rows(triage_stream.stream_results(spark, out)) == whole


@pytest.mark.parametrize("seen, want", [({}, None), ({2: 0.9}, None), ({1: 0.9}, 1), ({1: 0.1, 2: 0.75}, 2), ({1: 0.1, 3: 0.9}, None), ({1: 0, 2: 0, 3: 0}, 3)])
def test_the_deciding_attempt(seen, want):
    assert triage_stream.decide({a: [c] for a, c in seen.items()}, 0.75, 3) == want


def test_stream_state_is_updated_once_a_batch_and_keeps_the_first_arrival(spark, tmp_path):
    good = '{"drugs": ["ibuprofen"], "reactions": ["a"], "severity": "serious"}'
    source, out, seen = str(tmp_path / "in"), str(tmp_path / "out"), []

    def keep(batch):
        seen.append(batch.is_cached)
        return batch

    for data in ([("1", 2, good), ("2", 1, "junk")], [("1", 2, "late"), ("2", 1, good)], [("1", 1, "junk"), ("2", 2, good)], [("1", 1, good), ("2", 3, good)]):
        spark.createDataFrame(data, "report_id string, attempt int, raw string").coalesce(1).write.mode("append").parquet(source)
        triage_stream.stream_triage(spark, source, out, keep)
    assert rows(triage_stream.stream_results(spark, out).select("report_id", "attempt", "raw")) == [
        ("1", 1, "junk"), ("1", 2, good), ("2", 1, "junk"), ("2", 2, good)]
    assert seen and all(seen)
    arrivals = spark.readStream.schema("report_id string, attempt int, raw string").parquet(source)
    assert "Pandas" not in triage_stream.decided_attempts(arrivals)._jdf.queryExecution().analyzed().toString()
