"""Counts, scores, tiles, reports on signals."""

import math
import random
from collections import defaultdict
from fractions import Fraction

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from casewatch.functions.scoring import disproportionality, signal_flag
from casewatch.operators import lookup, pairs
from casewatch.plans import flows, reports


def scores(a, b, c, d):
    """Scores of one table in exact fractions; None where there are too few cases."""
    if a < 3 or b == 0 or c == 0:
        return None
    n = a + b + c + d
    prr = Fraction(a, a + b) / Fraction(c, c + d)
    ror = Fraction(a * d, b * c)
    chi2 = n * (abs(a * d - b * c) - Fraction(n, 2)) ** 2 / Fraction((a + b) * (c + d) * (a + c) * (b + d))
    return float(prr), float(ror), float(chi2), prr >= 2 and chi2 >= Fraction(384, 100), Fraction(c + d, n) < Fraction(1, 5)


def score_tables(spark, tables):
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(tables)], "i int, a long, b long, c long, d long")
    a, b, c, d = (F.col(x) for x in "abcd")
    return df.select("i", *(v.alias(k) for k, v in disproportionality(a, a + b, a + c, a + b + c + d).items())).orderBy("i").collect()


def test_hand_computed_tables(spark):
    got = score_tables(spark, [(2, 10, 10, 100), (3, 0, 10, 100), (3, 10, 0, 100), (10, 90, 20, 880), (90, 810, 5, 95)])
    assert [r.scorable for r in got] == [False, False, False, True, True]
    assert all(r.prr is None and r.is_signal is None for r in got[:3])
    assert (got[3].prr, got[3].ror, got[3].chi2, got[3].masking_warning, got[3].is_signal) == (4.5, 4.889, 16.132, False, True)
    assert (got[4].prr, got[4].ror, got[4].chi2, got[4].masking_warning, got[4].is_signal) == (2.0, 2.111, 2.068, True, False)


def test_large_counts_keep_their_digits(spark):
    # a*d and b*c differ by one part in 10^11: their difference is gone in doubles
    table = (1_000_003, 1_000_000_000, 999_997, 1_000_000_007)
    got = score_tables(spark, [table])[0]
    want = scores(*table)
    assert got.chi2 == pytest.approx(want[2], abs=2e-3)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(*[st.integers(0, 100_000)] * 4), min_size=20, max_size=40))
def test_scores_follow_the_formula(spark, tables):
    for got, table in zip(score_tables(spark, tables), tables):
        want = scores(*table)
        assert got.scorable == (want is not None)
        if want:
            for x, y in zip((got.prr, got.ror, got.chi2), want):
                assert math.isclose(x, y, rel_tol=1e-9, abs_tol=6e-4)
            assert got.is_signal == want[3] and got.masking_warning == want[4]


@pytest.fixture(scope="module")
def reports_data(spark):
    """Small cases, one case with a third of all rows, repeats and nulls."""
    rng = random.Random(5)
    drug_rows = [(rng.randrange(60), rng.choice(["a", "b", "c", "d", None])) for _ in range(400)]
    drug_rows += [(7, f"x{i % 40}") for i in range(200)]
    reac_rows = [(rng.randrange(62), rng.choice(["p", "q", "r", "s", None])) for _ in range(400)]
    reac_rows += [(7, f"y{i % 30}") for i in range(200)] + [(8, f"y{i % 30}") for i in range(30)] + [(9, f"y{i}") for i in range(30)]
    drug_rows += [(c, f"x{i}") for c in (8, 9) for i in range(40)] + [(10 + i, f"x{i}") for i in range(40)]
    reac_rows += [(55 - i, f"y{i}") for i in range(30)]
    cases = spark.createDataFrame([(i,) for i in range(70)], "caseid int")
    drugs = spark.createDataFrame(drug_rows, "caseid int, drugname_norm string")
    reactions = spark.createDataFrame(reac_rows, "caseid int, pt_name string")
    return cases, drugs, reactions, drug_rows, reac_rows


def brute_counts(drug_rows, reac_rows):
    by_drug, by_reac = defaultdict(set), defaultdict(set)
    for c, x in drug_rows:
        if x is not None:
            by_drug[x].add(c)
    for c, x in reac_rows:
        if x is not None:
            by_reac[x].add(c)
    return by_drug, by_reac


@pytest.mark.parametrize("tile", [None, 500, 7, 1])
def test_signals_match_brute_force_whatever_the_tiles(spark, reports_data, tile):
    cases, drugs, reactions, drug_rows, reac_rows = reports_data
    by_drug, by_reac = brute_counts(drug_rows, reac_rows)
    want = {}
    for d, dc in by_drug.items():
        for r, rc in by_reac.items():
            a = len(dc & rc)
            found = scores(a, len(dc) - a, len(rc) - a, 70 - len(dc | rc)) if a >= 3 else None
            if found:
                want[d, r] = (a, *(round(x, 3) for x in found[:3]), *found[3:])
    got = {
        (r.drug, r.reaction): (r.n_cases, r.prr, r.ror, r.chi2, r.is_signal, r.masking_warning)
        for r in pairs.signals(cases, drugs, reactions, tile_terms=tile).collect()
    }
    assert got.keys() == want.keys() and any(k[0].startswith("x") for k in want)
    for key, value in want.items():
        assert got[key] == pytest.approx(value, abs=1.1e-3)


def test_pair_counts_and_marginals(spark, reports_data):
    cases, drugs, reactions, drug_rows, reac_rows = reports_data
    by_drug, by_reac = brute_counts(drug_rows, reac_rows)
    want = {(d, r): len(x & y) for d, x in by_drug.items() for r, y in by_reac.items() if len(x & y) >= 3}
    assert {(r[0], r[1]): r[2] for r in pairs.pair_counts(drugs, reactions, tile_terms=5).collect()} == want
    got = {(r.kind, r.term): r.n for r in pairs.marginals(cases, drugs, reactions).collect()}
    assert got["total", None] == 70
    assert all(got["drug", d] == len(x) for d, x in by_drug.items())
    assert all(got["reaction", d] == len(x) for d, x in by_reac.items())


def test_insufficient_pairs_get_a_reason(spark, reports_data):
    cases, drugs, reactions, *_ = reports_data
    every = pairs.signals(cases, drugs, reactions, include_insufficient=True).collect()
    scored = pairs.signals(cases, drugs, reactions).collect()
    assert {(r.drug, r.reaction) for r in every if r.reason is None} == {(r.drug, r.reaction) for r in scored}
    short = [r for r in every if r.reason == "insufficient_data"]
    assert short and all(r.prr is None and r.is_signal is False for r in short)


def test_row_level_counts_rows_and_null_terms(spark):
    rng = random.Random(3)
    data = [(rng.choice(["a", "b", None]), rng.choice(["p", "q", None])) for _ in range(300)]
    got = {
        (r.drug, r.reaction): (r.n_cases, r.prr)
        for r in pairs.signals_by_row(spark.createDataFrame(data, "generic_drug string, meddra_pt string")).collect()
    }
    want = {}
    for d in "ab":
        for p in "pq":
            a = sum(x == d and y == p for x, y in data)
            b = sum(x == d and y != p for x, y in data)
            c = sum(x != d and y == p for x, y in data)
            want[d, p] = (a, round(scores(a, b, c, len(data) - a - b - c)[0], 3))
    assert got.keys() == want.keys()
    for key in want:
        assert got[key] == pytest.approx(want[key], abs=1.1e-3)


SIGNALS = "drug string, reaction string, n_cases long, prr double, ror double, chi2 double, is_signal boolean, masking_warning boolean"


@pytest.fixture(scope="module")
def stored(spark):
    return spark.createDataFrame([
        ("ibuprofen", "Cough", 9, 12.0, 13.0, 50.0, True, False),
        ("ibuprofen", "Rash", 5, 1.5, 1.6, 2.0, False, False),
        ("aspirin", "Cough", 7, 6.0, 6.1, 20.0, True, True),
        ("aspirin", "Rash", 30, 2.0, 2.2, 9.0, True, False),
        ("rofecoxib", "Stroke", 4, 1.1, 1.2, 0.5, False, False),
        ("lisinopril", "Cough", 50, 1.9, 2.0, 30.0, False, False),
    ], SIGNALS)


def test_controls(spark, stored):
    known = [("ibuprofen", "Cough"), ("rofecoxib", "Stroke"), ("lisinopril", "Cough"), ("metformin", "x")]
    got = {r.drug: r for r in reports.controls(stored, known).collect()}
    assert [got[d].status for d in ("ibuprofen", "rofecoxib", "lisinopril", "metformin")] == ["PASS", "WEAK", "FAIL", "NOT FOUND"]
    assert got["metformin"].found is False and got["metformin"].prr is None
    assert [got[d].signal_status for d in ("ibuprofen", "rofecoxib")] == ["PASS", "FAIL"]
    assert not reports.controls_pass(reports.controls(stored, known))
    # a pair that is not found does not fail, and neither does the optional control
    assert reports.controls_pass(reports.controls(stored, [known[0], known[1], known[3]]))
    assert reports.controls(stored, [("IBUPROFEN", "cough")], any_case=True).first().status == "PASS"
    assert reports.controls(stored, [("IBUPROFEN", "cough")]).first().status == "NOT FOUND"


def test_reports(spark, stored):
    assert tuple(reports.signal_summary(stored).first()) == (6, 3, 1)
    assert rows(reports.signals_per_drug(stored)) == [("aspirin", 2, 2), ("ibuprofen", 2, 1), ("lisinopril", 1, 0), ("rofecoxib", 1, 0)]
    assert [r.prr for r in reports.top_signals(stored, 2).collect()] == [12.0, 6.0]
    assert [r.prr for r in reports.filter_signals(stored, ["aspirin", "ibuprofen"], 3.0).collect()] == [12.0, 6.0]
    grid = reports.heatmap(stored, ["aspirin", "ibuprofen", "none"], 2.0)
    assert rows(grid) == [("Cough", 6.0, 12.0, 0.0), ("Rash", 2.0, 0.0, 0.0)]
    assert rows(reports.heatmap(stored, ["aspirin", "ibuprofen"], 2.0, top_n=1)) == [("Rash", 2.0, 0.0)]


@pytest.mark.parametrize("prrs,flag", [([], "noise"), ([2.0], "low"), ([4.999], "low"), ([5.0, 2.0], "medium"), ([9.999], "medium"), ([3.0, 10.0], "high")])
def test_signal_flag(spark, prrs, flag):
    df = spark.createDataFrame([(prrs,)], "p array<double>")
    assert df.select(signal_flag(F.col("p"))).first()[0] == flag


def test_signal_lookup_order_case_and_repeats(spark, stored):
    df = spark.createDataFrame([
        ("1", ["Aspirin", "IBUPROFEN", "aspirin"], ["rash", "COUGH", "none"]), ("2", [], ["Cough"]), ("3", ["aspirin"], None),
    ], "report_id string, drugs array<string>, meddra_pts array<string>")
    got = {r.report_id: [(s.drug, s.reaction) for s in r.prr_signals] for r in lookup.signal_lookup(df, stored).collect()}
    assert got == {
        "1": [("aspirin", "Rash"), ("aspirin", "Cough"), ("ibuprofen", "Cough"), ("aspirin", "Rash"), ("aspirin", "Cough")],
        "2": [], "3": [],
    }


def test_signal_flow_stores_and_judges(spark, reports_data, tmp_path):
    cases, drugs, reactions, *_ = reports_data
    table, checked, ok = flows.signal_flow(cases, drugs, reactions, str(tmp_path), [("a", "p"), ("zzz", "p")], min_prr=1.0)
    assert table.count() == pairs.signals(cases, drugs, reactions).count()
    assert {r.drug: r.found for r in checked.collect()}["zzz"] is False and isinstance(ok, bool)
