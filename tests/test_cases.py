"""Case fields, latest version, drugs, reactions, seriousness, coverage."""

import random
from datetime import date

import pytest
from conftest import rows
from pyspark.sql import functions as F

from casewatch.functions import cases as C
from casewatch.operators import dedupe
from casewatch.plans import ingest


@pytest.mark.parametrize("age,unit,years", [
    ("30", "YR", 30.0), ("3", "dec", 30.0), ("6", "MON", 0.5), ("26", "WK", 0.5), ("365", "DY", 1.0), ("8760", "HR", 1.0),
    ("5", "??", None), ("5", None, None), ("abc", "YR", None), (None, "YR", None), ("-1", "YR", None), ("151", "YR", None),
    ("150", "YR", 150.0), ("0", "DY", 0.0), ("16", "DEC", None),
])
def test_age_years(spark, age, unit, years):
    df = spark.createDataFrame([(age, unit)], "a string, u string")
    assert df.select(C.age_years(F.col("a"), F.col("u"))).first()[0] == years


@pytest.mark.parametrize("text,day", [
    ("20240131", date(2024, 1, 31)), ("20240230", None), ("202401", None), ("", None), (None, None), ("2024-01-31", None), ("2024013x", None),
])
def test_report_date(spark, text, day):
    assert spark.createDataFrame([(text,)], "d string").select(C.report_date(F.col("d"))).first()[0] == day


def test_build_cases(spark):
    demo = spark.createDataFrame([
        ("1", "1", "30", "YR", "20240101", " f", "US", "1"),
        ("1", "3", "31", "YR", "20240103", "F ", "US", "2"),
        ("1", None, "99", "YR", "20240109", "M", "US", "1"),
        ("2", "x", "2", "DEC", "bad", None, None, " 1 "),
        ("", "1", "1", "YR", "20240101", "M", "US", "1"), (None, "1", "1", "YR", "20240101", "M", "US", "1"),
    ], "caseid string, caseversion string, age string, age_cod string, fda_dt string, sex string, reporter_country string, serious string")
    assert rows(ingest.build_cases(demo)) == [
        ("1", 3, 31.0, "F", date(2024, 1, 3), "US", False), ("2", None, 20.0, None, None, None, True),
    ]


def test_build_cases_falls_back_column_by_column(spark):
    demo = spark.createDataFrame([("1", "1", "20240105", "20240101", "DE")], "caseid string, caseversion string, event_dt string, rept_dt string, occr_country string")
    assert rows(ingest.build_cases(demo)) == [("1", 1, None, None, date(2024, 1, 1), "DE", None)]


def test_the_choice_of_date_column_is_not_per_row(spark):
    demo = spark.createDataFrame([("1", "1", None, "20240101")], "caseid string, caseversion string, fda_dt string, rept_dt string")
    assert ingest.build_cases(demo).first().report_date is None


def test_build_drugs(spark):
    cases = spark.createDataFrame([("1",), ("2",)], "caseid string")
    drug = spark.createDataFrame([
        ("1", "1", "IBUPROFEN SODIUM", "Advil", "PS"), ("1", "1", "ASPIRIN", "x", "SS"), ("1", "2", "", "Aspirin 100", "C"),
        ("2", "1", None, "baby aspirin", "PS"), ("2", "2", "Advil", "ibuprofen", "PS"), ("9", "1", "ASPIRIN", "x", "PS"),
        ("2", "x", "metformin", None, None),
    ], "caseid string, drug_seq string, prod_ai string, drugname string, role_cod string")
    got = ingest.build_drugs(drug, cases)
    assert rows(got.select("caseid", "drug_seq", "drugname_raw", "role_cod")) == [
        ("1", 1, "ASPIRIN", "SS"), ("1", 2, "Aspirin 100", "C"), ("2", 1, "baby aspirin", "PS"), ("2", None, "metformin", None),
    ]
    assert got.columns == ["caseid", "drug_seq", "drugname_raw", "drugname_norm", "rxnorm_rxcui", "role_cod"]
    assert ingest.build_drugs(drug, cases, roles=["PS"]).count() == 1 + 1
    only_names = ingest.build_drugs(drug.drop("prod_ai", "role_cod"), cases)
    assert rows(only_names.select("drugname_raw")) == [("Aspirin 100",), ("baby aspirin",), ("ibuprofen",)]
    with pytest.raises(ValueError):
        ingest.build_drugs(drug.drop("prod_ai", "drugname"), cases)


def test_reactions_are_numbered_in_term_order(spark):
    rng = random.Random(1)
    terms = ["", "a", "ab", "abc", "b", "ba", "Émile", "éa", "zz", None] + [f"t{i:03}" for i in range(60)]
    data = [(str(rng.randrange(5)), rng.choice(terms)) for _ in range(400)] + [("0", f" long{i} ") for i in range(300)]
    cases = spark.createDataFrame([(str(i),) for i in range(4)], "caseid string")
    got = ingest.build_reactions(spark.createDataFrame(data, "caseid string, pt string"), cases).collect()
    for case in "0123":
        unique = {t.strip() if t is not None else None for c, t in data if c == case}
        want = sorted(unique, key=lambda t: (t is not None, (t or "").encode()))
        mine = sorted((r.reac_seq, r.pt_name) for r in got if r.caseid == case and r.pt_name is not None)
        assert len([r for r in got if r.caseid == case]) == len(unique)
        assert sorted(r.reac_seq for r in got if r.caseid == case) == list(range(1, len(unique) + 1))
        assert [t for _, t in mine] == [t for t in want if t is not None]
    assert not [r for r in got if r.caseid == "4"]


def test_seriousness_keeps_cases_without_outcomes(spark):
    cases = spark.createDataFrame([("1", None), ("2", True), ("3", True), ("4", None)], "caseid string, serious boolean")
    outcomes = spark.createDataFrame([("1", "ot"), ("1", " de "), ("2", "OT"), ("2", None)], "caseid string, outc_cod string")
    got = ingest.apply_seriousness(cases, ingest.case_seriousness(outcomes))
    assert rows(got) == [("1", True), ("2", False), ("3", True), ("4", None)]
    assert rows(ingest.seriousness_distribution(got)) == [(False, 1), (None, 1), (True, 2)]


def test_coverage_counts_the_join_without_making_it(spark):
    rng = random.Random(2)
    cases = spark.createDataFrame([(i,) for i in range(30)], "caseid int")
    drugs = spark.createDataFrame([(rng.randrange(25),) for _ in range(60)], "caseid int")
    reactions = spark.createDataFrame([(rng.randrange(35),) for _ in range(80)], "caseid int")
    d, r = drugs.withColumn("d", F.lit(1)), reactions.withColumn("r", F.lit(1))
    wide = cases.join(d, "caseid", "left").join(r, "caseid", "left")
    want = wide.agg(F.countDistinct("caseid"), F.countDistinct(F.when(F.col("d") == 1, F.col("caseid"))),
                    F.countDistinct(F.when(F.col("r") == 1, F.col("caseid"))), F.count("d"), F.count("r")).first()
    got = ingest.coverage(cases, drugs, reactions).first()
    assert tuple(got)[:5] == tuple(want) and got.drug_rows == 60
    with pytest.raises(ValueError):
        ingest.require_rows(ingest.coverage(cases, drugs, reactions))
    ingest.require_rows(ingest.coverage(cases, drugs, reactions), least=30)


def test_keep_first_is_repeatable_and_prunes_before_the_shuffle(spark):
    data = [(i % 3, i % 7, str(i % 5)) for i in range(100)]
    df = spark.createDataFrame(data, "k int, v int, s string")
    first = dedupe.keep_first(df, ["k"], [F.col("v").desc()])
    assert rows(first) == rows(dedupe.keep_first(df.repartition(7, "s"), ["k"], [F.col("v").desc()])) == [(k, 6, min(s for a, v, s in data if a == k and v == 6)) for k in range(3)]
    plan = first._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


def test_upsert(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "id int, v string")
    once = dedupe.upsert(base, new, ["id"])
    assert rows(once) == [(1, "a"), (2, "B"), (3, "C")] == rows(dedupe.upsert(once, new, ["id"]))
