from fractions import Fraction
from math import comb
import random

import brute
import pytest
from casewatch.llm import signature_join as sj
from casewatch.llm.components import components


def run(spark, rows, **args):
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, node int").repartition(3)
    return {r.doc_id: r for r in sj.near_duplicates(docs, **args).collect()}


def corpus(seed, groups=8, size=12):
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(3, 120))]
        for _ in range(rng.randrange(1, size)):
            words = [*base]
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = f"e{rng.randrange(999)}"
            rows.append(" ".join(words))
    rng.shuffle(rows)
    return [*enumerate(rows)]


@pytest.mark.parametrize("width, percent, rounds", [(3, 85, 6), (5, 80, 6), (3, 85, 0), (3, 85, 1)])
def test_components_equal_brute_force(spark, width, percent, rounds):
    rows = corpus(width + rounds) + [(900, "Short one"), (901, "short ONE"), (902, None), (903, " \n"), (904, "a " * 3000)]
    got = run(spark, rows, width=width, percent=percent, rounds=rounds)
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == brute.near_components(rows, width, percent)
    assert all(r.kept == (d == r.component_id) for d, r in got.items())


def test_rounds_change_nothing_in_one_large_group(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(50):
        words = [*base]
        for _ in range(4):
            words[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(words)))
    want = brute.near_components(rows, 3, 85)
    for rounds in (0, 6):
        assert {d: (r.n_shingles, r.component_id) for d, r in run(spark, rows, width=3, percent=85, rounds=rounds).items()} == want


def test_null_ids_repeated_rows_and_empty_tables(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in sj.near_duplicates(docs).collect()), key=str)
    assert got == [(3, 2, 3, True)] * 2 + [(None, 2, None, True)] * 2
    assert sj.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


def test_threshold_leaves_a_wide_margin():
    assert sj.threshold(0.85) == 15 and sj.threshold(0.8) == 12 and sj.threshold(1.0) == 32
    for similarity in (Fraction(85, 100), Fraction(8, 10)):  # by the exact binomial tail
        k = sj.threshold(float(similarity))
        fewer = [sum(comb(32, i) * similarity**i * (1 - similarity) ** (32 - i) for i in range(n)) for n in (k, k + 1)]
        assert fewer[0] <= sj.MISSED < fewer[1]


@pytest.mark.parametrize("rounds", [0, 1, 4])
@pytest.mark.parametrize("words", [2, 10**6])
def test_copies_around_the_threshold_in_one_large_group(spark, words, rounds):
    rng = random.Random(words)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(80):
        text = base[: rng.randrange(70, 91)]
        for _ in range(rng.randrange(0, 9)):
            text[rng.randrange(len(text))] = f"x{rng.randrange(words)}"
        rows += [(2 * i, " ".join(text))]
        text[-1] = "end"
        rows += [(2 * i + 1, " ".join(text))] if i % 3 == 0 else []
    got = run(spark, rows, width=3, percent=85, rounds=rounds)
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == brute.near_components(rows, 3, 85)


def test_changed_copies_leave_without_a_comparison(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 200):  # ten words of its own in each: no two are linked
        text = [*base]
        for at in rng.sample(range(120), 10):
            text[at] = f"x{i}"
        rows.append((i, " ".join(text)))
    compared = []
    plain = sj.confirmed
    monkeypatch.setattr(sj, "confirmed", lambda pairs, *rest: compared.append(pairs.count()) or plain(pairs, *rest))
    got = run(spark, rows, width=3, percent=85, rounds=0)
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == brute.near_components(rows, 3, 85)
    assert sum(compared) < 200 * 199 / 2 / 10
