"""Keyword and fuzzy matching, salts, vocabulary, write-back."""

import random
import time

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from casewatch import constants as K
from casewatch.functions.lcs import RatioIndex, lcs_length
from casewatch.functions.text import first_target, sorted_tokens, strip_salts
from casewatch.operators import names
from casewatch.plans import flows, reports


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def plain_ratio(a, b):
    a, b = (" ".join(sorted(t.split())) for t in (a, b))
    return 200 * plain_lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


words = st.text(alphabet="abcé Z", max_size=80)


@settings(max_examples=150, deadline=None)
@given(words, st.lists(words, min_size=1, max_size=6))
def test_ratio_matches_the_plain_recurrence(query, known):
    assert RatioIndex(known).scores(query) == pytest.approx([plain_ratio(query, k) for k in known])


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdeé Z", max_size=200), st.lists(st.text(alphabet="abcdeé Z", max_size=150), min_size=1, max_size=90), st.integers(1, 8))
def test_pruned_search_finds_the_best(query, known, first):
    index = RatioIndex(known)
    scores = index.scores(query)
    assert scores == pytest.approx([plain_ratio(query, k) for k in known])
    assert index.best(query, first) == (int(scores.argmax()), scores.max())


def test_pruned_search_compares_few_names():
    rng = random.Random(2)
    stems = ["".join(rng.choices("ABCDEILNORSTU", k=rng.randint(4, 10))) for _ in range(400)]
    index = RatioIndex([" ".join(rng.sample(stems, rng.randint(1, 3))) for _ in range(4000)])
    for name in rng.sample(index.texts, 50):
        index.best(name[:-2] + "X")
    assert index.computed < 50 * 4000 * 0.1


def test_long_names_cost_little_more():
    rng = random.Random(3)
    index = RatioIndex(["".join(rng.choices("ABCDE FGH", k=rng.randint(40, 120))) for _ in range(5000)])
    took = {}
    for n in (50, 100):
        query = "".join(rng.choices("ABCDEFGH", k=n))
        runs = []
        for _ in range(5):
            start = time.perf_counter()
            index.scores(query)
            runs.append(time.perf_counter() - start)
        took[n] = min(runs)
    assert took[100] < 4 * took[50]


@settings(max_examples=60, deadline=None)
@given(words, words)
def test_ratio_is_symmetric_and_ignores_word_order(a, b):
    assert RatioIndex([a]).scores(b)[0] == pytest.approx(RatioIndex([b]).scores(a)[0])
    assert RatioIndex([a]).scores(" ".join(reversed(a.split())))[0] == 100.0


def test_known_ratio_and_native_form(spark):
    assert RatioIndex(["IBUPROFEN TABLET"]).scores("IBUPROFEN TAB")[0] == pytest.approx(89.655, abs=1e-3)
    rng = random.Random(4)
    data = [("".join(rng.choices("abc ", k=rng.randrange(12))), "".join(rng.choices("abc ", k=rng.randrange(12)))) for _ in range(60)] + [("", "a"), ("a", "")]
    got = spark.createDataFrame(data, "a string, b string").select(lcs_length(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [plain_lcs(a, b) for a, b in data]
    tokens = spark.createDataFrame([("  b  a c ",)], "a string").select(sorted_tokens(F.col("a"))).first()[0]
    assert tokens == "a b c"


def plain_keyword(name):
    if not name:
        return None, None, 0.0
    low, best = name.strip().lower(), (None, None, 0.0, 0)
    for drug, code, keywords in K.DRUG_KEYWORDS:
        for k in (k.strip() for k in keywords):
            if k in low and len(k) > best[3]:
                best = (drug, code, 100.0 if low == k else 90.0, len(k))
    return best[:3]


NAMES = [
    "ibuprofen", "Metformin", "advil", "LIPITOR", "penicillin", "amoxicillin", "nasal spray", "ASA 100", "St. Joseph Aspirin",
    "MINT ATORVASTATIN", "atorvastatin calcium", "naproxeno + aspirin", " ibuprofen ", "s-amlodipine", "sandoz-metoprolol tartrate",
    "metforming", "", "advil motrin", "Celebrex/ Vioxx",
]


def test_keyword_match(spark):
    df = spark.createDataFrame([(n,) for n in NAMES * 2] + [(None,)], "drugname_raw string")
    got = {r[0]: tuple(r)[1:] for r in names.keyword_match(df).collect()}
    assert got == {n: plain_keyword(n) for n in NAMES}
    assert got["nasal spray"][0] == "aspirin"  # the trimmed keyword "asa" is inside


def test_keyword_vocabulary(spark):
    table = names.keyword_vocabulary(spark)
    assert table.count() == 61 and table.select("generic_name").distinct().count() == 11
    assert table.where("display_name = 'ASA'").first().generic_name == "aspirin"


def test_known_drug_count(spark):
    df = spark.createDataFrame([(["ibuprofen", "Advil 200", "penicillin"],), ([],)], "d array<string>")
    assert [r[0] for r in df.select(names.known_drug_count(F.col("d"))).collect()] == [2, 0]


@pytest.mark.parametrize("name,bare", [
    ("ATORVASTATIN CALCIUM", "ATORVASTATIN"), ("Metoprolol  Succinate ER", "Metoprolol ER"), ("calciumx", "calciumx"),
    ("ibuprofen dl-lysine", "ibuprofen"), ("SODIUM", ""), ("sodium-potassium salt", "- salt"),
])
def test_strip_salts(spark, name, bare):
    assert spark.createDataFrame([(name,)], "n string").select(strip_salts(F.col("n"))).first()[0] == bare


def test_first_target_goes_by_list_order(spark):
    df = spark.createDataFrame([("Aspirin/Ibuprofen",), ("x",), (None,)], "n string")
    assert [r[0] for r in df.select(first_target(F.col("n"))).collect()] == ["ibuprofen", None, None]


LOOKUP = [
    ("IBUPROFEN", "1", "Ibuprofen "), ("IBUPROFEN TABLET", "2", "ibuprofen"), ("ATORVASTATIN", "3", "atorvastatin"),
    ("ASPIRIN 81 MG", "4", "aspirin"), ("ASPIRIN 82 MG", "5", "other"), ("CALCIUM", "6", ""), ("X" * 70 + " LONG", "7", "long"),
]


def plain_fuzzy(name):
    full = name.strip().upper()
    table = {d: (c, g.strip().lower() or None) for d, c, g in LOOKUP}
    if full in table:
        return table[full][1], table[full][0], 100.0
    bare = full
    for salt in K.SALT_WORDS:
        bare = " ".join(w for w in bare.split() if w != salt.upper())

    def best(q):
        return max(((plain_ratio(q, d), d) for d in sorted(table)), key=lambda x: x[0])

    score, entry = best(full)
    if bare and bare != full and best(bare)[0] >= score:
        score, entry = best(bare)
    if score < 80:
        return None, None, round(score, 1)
    return table[entry][1], table[entry][0], round(score, 1)


FUZZY = ["ibuprofen", "IBUPROFEN TAB", "tablet ibuprofen", "Atorvastatin Calcium", "atorvastatine", "aspirin 83 mg", "zzz", "Ibuprofen Sodium", "calcium", "x" * 69 + " long"]


@pytest.mark.parametrize("limits", [{}, {"max_lookup_rows": 2, "block_rows": 3}])
def test_fuzzy_match(spark, limits):
    df = spark.createDataFrame([(n,) for n in FUZZY * 2], "drugname_raw string")
    lookup = spark.createDataFrame(LOOKUP, "display_name string, rxcui string, generic_name string")
    got = {r[0]: tuple(r)[1:] for r in names.fuzzy_match(df, lookup, **limits).collect()}
    for name in FUZZY:
        want = plain_fuzzy(name)
        assert got[name][:2] == want[:2], name
        assert got[name][2] == pytest.approx(want[2], abs=0.051), name


def test_bands_of_lengths_lose_nothing(spark):
    rng = random.Random(6)
    entries = sorted({"".join(rng.choices("ABCDE ", k=rng.randint(1, 60))).strip() or "A" for _ in range(150)})
    asked = ["".join(rng.choices("ABCDEZ\u2003", k=rng.randint(1, 90))) for _ in range(60)] + ["\u2003", "q", "\x1cABC\x1cD"]
    lookup = spark.createDataFrame([(e, str(i), e.lower()) for i, e in enumerate(entries)], "display_name string, rxcui string, generic_name string")
    df = spark.createDataFrame([(a,) for a in asked], "drugname_raw string")
    small = names.fuzzy_match(df, lookup)
    assert rows(names.fuzzy_match(df, lookup, max_lookup_rows=1, block_rows=20)) == rows(small)
    best = {r.drugname_raw: r.match_score for r in small.collect()}
    assert all(best[a] == pytest.approx(max(plain_ratio(a.strip(" ").upper(), e) for e in entries), abs=0.051) for a in asked)


def test_fuzzy_match_against_nothing(spark):
    df = spark.createDataFrame([("a",)], "drugname_raw string")
    lookup = spark.createDataFrame([], "display_name string, rxcui string, generic_name string")
    assert rows(names.fuzzy_match(df, lookup)) == [("a", None, None, 0.0)]


def test_vocabulary_lookup(spark):
    terms = spark.createDataFrame([
        ("1", "9", "Ibuprofen", "Advil Tab", "ADVIL"), ("2", "8", "ibuprofen ", "Motrin", ""), ("3", "7", None, "Advil", None),
    ], "RXCUI string, GENERIC_RXCUI string, FULL_GENERIC_NAME string, DISPLAY_NAME string, BRAND_NAME string")
    assert rows(names.vocabulary_lookup(terms)) == [
        ("ADVIL", "3", None), ("ADVIL TAB", "1", "ibuprofen"), ("IBUPROFEN", "1", "ibuprofen"), ("MOTRIN", "2", "ibuprofen"),
    ]
    alone = names.vocabulary_lookup(terms.select("GENERIC_RXCUI", F.col("DISPLAY_NAME").alias("FULL_NAME")))
    assert rows(alone)[0] == ("ADVIL", "7", "advil")
    with pytest.raises(ValueError):
        names.vocabulary_lookup(terms.select("DISPLAY_NAME"))
    with pytest.raises(ValueError):
        names.vocabulary_lookup(terms.select("RXCUI"))


def test_write_back_and_reports(spark, tmp_path):
    drugs = spark.createDataFrame([
        (1, "Advil", None, None), (2, "Advil", "old", "0"), (3, "penicillin", "kept", "5"), (4, None, None, None), (5, "lipitor 10", None, None),
    ], "id int, drugname_raw string, drugname_norm string, rxnorm_rxcui string")
    want = [(1, "Advil", "ibuprofen", "5640"), (2, "Advil", "ibuprofen", "5640"), (3, "penicillin", "kept", "5"), (4, None, None, None), (5, "lipitor 10", "atorvastatin", "83367")]
    mapping = names.keyword_match(drugs)
    assert rows(names.apply_names(drugs, mapping)) == rows(names.normalize_names(drugs)) == want
    lookup = names.keyword_vocabulary(spark)
    fuzzy = names.normalize_names(drugs, "fuzzy", lookup)
    assert {r.id: r.drugname_norm for r in fuzzy.collect()} == {1: "ibuprofen", 2: "ibuprofen", 3: "kept", 4: None, 5: "atorvastatin" if plain_ratio("LIPITOR 10", "LIPITOR") >= 80 else None}
    stored, done = flows.normalize_flow(drugs, str(tmp_path))
    assert rows(done) == want and stored.count() == 3
    assert tuple(names.match_stats(mapping).first()) == (3, 2, 1, 66.7)
    assert tuple(names.match_stats(mapping.limit(0)).first())[:3] == (0, 0, 0)
    assert tuple(reports.normalisation_coverage(done).first()) == (5, 4, 80.0)
    assert rows(reports.variant_collapse(done)) == [("lipitor 10", "atorvastatin", 1)]
    assert [r.drugname_norm for r in reports.top_drugs(done, 1).collect()] == ["ibuprofen"]
    sample = names.mapping_samples(mapping, matched=1, unmatched=10).collect()
    assert {(r.kind, r.drugname_raw, r.n_more) for r in sample} == {("matched", "Advil", 1), ("unmatched", "penicillin", 0)}
    assert [r[0] for r in names.distinct_terms(drugs, "drugname_raw").collect()] == ["Advil", "lipitor 10", "penicillin"]


@pytest.mark.parametrize("limits", [{}, *({"max_lookup_rows": 1, "block_rows": n} for n in (1, 2, 3))])
def test_stripped_form_wins_ties_whatever_the_blocks(spark, limits):
    lookup = spark.createDataFrame(
        [("ABCDF", "1", "z-drug"), ("ABCDE SODI111", "2", "a-drug"), ("QQQ0", "3", "q"), ("QQQ1", "4", "q")],
        "display_name string, rxcui string, generic_name string",
    )
    found = names.fuzzy_match(spark.createDataFrame([("ABCDE SODIUM",)], "drugname_raw string"), lookup, **limits)
    assert [(r.drugname_norm, r.match_score) for r in found.collect()] == [("z-drug", 80.0)]
