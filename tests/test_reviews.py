"""Cleaning, keys, review flow, mentions, scoring and embedding hooks."""

import hashlib
import random
import re
import time

import pytest
from conftest import rows
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from casewatch import constants as K
from casewatch.functions import text as X
from casewatch.operators import nearest, texts
from casewatch.plans import flows, reviews
from casewatch.sources import readers, sinks


def plain_clean(text):
    for pattern, new in K.MARKUP:
        text = re.sub(pattern, new, text, flags=re.IGNORECASE)
    text = " ".join(text.split())
    return text[1:-1].strip() if text[:1] == text[-1:] == '"' else text


TEXTS = [
    "", '"', '""', ' " a " ', "a<br>b<BR />c<br />d", "&AMP;lt;b&gt;x", "&quot;quoted&quot;", "it&#039;s", "a < b > c", "<p\nclass='x'>t</p>",
    "a  b\x1cc\n\n d", '"one" and "two"', "no markup", "<b", "&lt;i&gt;tag&lt;/i&gt;", '"open', "é&amp;É",
]


def test_clean_html(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS] + [(None,)], "t string")
    got = [r[0] for r in df.select(X.clean_html(F.col("t"))).collect()]
    assert got == [plain_clean(t) for t in TEXTS] + [None]


def test_strip(spark):
    df = spark.createDataFrame([(" \t\n x y  \x1f",)], "t string")
    assert df.select(X.strip(F.col("t"))).first()[0] == "x y"


@pytest.mark.parametrize("text,hit", [("Bad SIDE EFFECTS here", True), ("my allergy", True), ("fine", False), ("", False), (None, False), ("Painting", True)])
def test_mentions_event(spark, text, hit):
    assert spark.createDataFrame([(text,)], "t string").select(X.mentions_event(F.col("t"))).first()[0] is hit


def test_review_id(spark):
    long = "é" * 49 + "xyz"
    df = spark.createDataFrame([("Advil", long), (None, "t"), ("Advil", None)], "d string, t string")
    want = [hashlib.sha256(k.encode()).hexdigest() for k in ("Advil\x1f" + long, "\x1ft", "Advil\x1f")]
    assert [r[0] for r in df.select(X.review_id(F.col("d"), F.col("t"))).collect()] == want
    short = hashlib.sha256(("Advil\x1f" + long[:50]).encode()).hexdigest()[:12]
    assert df.select(X.review_id(F.col("d"), F.col("t"), 50, 12)).first()[0] == short


SENTENCE = "word " * 20


def raw_reviews(spark):
    same = "the first fifty characters of these two are alike " + "x " * 25
    return spark.createDataFrame([
        ("Advil (ibuprofen)", "Pain", '"' + SENTENCE + 'headache"', "9.0", "train"),
        ("ibuprofen", None, SENTENCE.strip(), "3", "train"),               # exactly 20 words
        ("Aspirin", "x", same + "one", "7", "test"), ("Aspirin", "x", same + "two", "bad", "test"),
        ("aspirin / ibuprofen", "x", SENTENCE + "fine", None, "test"),
        ("penicillin", "x", SENTENCE + "rash", "1", "test"), (None, "x", SENTENCE + "rash", "1", "test"),
        ("aspirin", "x", None, "1", "test"), ("aspirin", "x", "  ", "1", "test"),
    ], "drugname string, condition string, review string, rating string, source string")


def test_build_reviews(spark):
    got = {r.drug_name: r for r in reviews.build_reviews(raw_reviews(spark)).collect()}
    assert set(got) == {"Advil (ibuprofen)", "Aspirin", "aspirin / ibuprofen"}
    advil = got["Advil (ibuprofen)"]
    assert (advil.drug_norm, advil.rating, advil.word_count, advil.has_ae_mention) == ("ibuprofen", 9, 21, True)
    assert advil.review_text == SENTENCE + "headache"
    assert got["aspirin / ibuprofen"].drug_norm == "ibuprofen" and got["aspirin / ibuprofen"].rating is None
    slim = raw_reviews(spark).select(F.col("drugname").alias("drug_name"), F.col("review").alias("reviewtext"), "source")
    assert reviews.build_reviews(slim).where("rating is null and condition is null").count() == 4
    with pytest.raises(ValueError):
        reviews.build_reviews(slim.drop("reviewtext"))
    alike = [r for r in reviews.build_reviews(raw_reviews(spark)).collect() if r.drug_name == "Aspirin"]
    assert sorted((r.review_text[-3:], r.rating) for r in alike) == [("one", 7), ("two", None)]  # both are reviews of their own


def test_cleaning_runs_once_per_row(spark):
    plan = reviews.readable_reviews(raw_reviews(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("&quot;") == 1


def test_unprocessed_and_distribution(spark):
    df = spark.createDataFrame([(f"r{i}", "t", "d" if i % 2 else "e", i % 3 > 0) for i in range(9)], "review_id string, review_text string, drug_norm string, has_ae_mention boolean")
    done = spark.createDataFrame([("r1",), ("r4",)], "review_id string")
    assert [r.review_id for r in reviews.unprocessed(df, done, 3).collect()] == ["r2", "r5", "r7"]
    assert reviews.unprocessed(df, done, None).count() == 4
    only = spark.createDataFrame([("r8",), ("r0",), ("r1",)], "review_id string")
    assert rows(reviews.unprocessed(df, done, None, only).select("review_id")) == [("r8",)]
    assert rows(reviews.review_distribution(df)) == [("d", 4, 3), ("e", 5, 3)]


MENTION_TERMS = [("pain", "DISEASE"), ("stomach pain", "DISEASE"), ("ibuprofen", "CHEMICAL"), ("vitamin c", "CHEMICAL"), ("c++", "X"), ("pain", "second")]


@pytest.mark.parametrize("text,found", [
    ("Stomach pain, PAIN and painful ibuprofen.", [("Stomach pain", "DISEASE", 0, 12), ("PAIN", "DISEASE", 14, 18), ("ibuprofen", "CHEMICAL", 31, 40)]),
    ("stomach painting", []), ("xpain pain_ pain", [("pain", "DISEASE", 12, 16)]), ("İ pain", [("pain", "DISEASE", 2, 6)]),
    ("vitamin cd vitamin c", [("vitamin c", "CHEMICAL", 11, 20)]), ("c++x", [("c++", "X", 0, 3)]), ("", []), (None, []),
])
def test_mentions(spark, text, found):
    df = spark.createDataFrame([("1", text)], "review_id string, review_text string")
    assert [tuple(r)[1:] for r in texts.mentions(df, MENTION_TERMS).collect()] == found


def plain_mentions(text, terms):
    labels = {t.lower(): label for t, label in reversed(terms)}
    word = lambda ch: ch.isalnum() or ch == "_"
    found, at = [], 0
    while at < len(text):
        if not (at and word(text[at - 1])):
            fits = [t for t in labels if text.lower().startswith(t, at) and not (word(t[-1]) and text[at + len(t) : at + len(t) + 1].isalnum())]
            fits = [t for t in fits if not (word(t[-1]) and text[at + len(t) : at + len(t) + 1] == "_")]
            if fits:
                best = max(fits, key=len)
                found.append((text[at : at + len(best)], labels[best], at, at + len(best)))
                at += len(best)
                continue
        at += 1
    return found


@pytest.mark.parametrize("n_terms", [4, 300])
def test_term_finder_equals_a_plain_search(n_terms):
    rng = random.Random(n_terms)
    piece = lambda n: "".join(rng.choices("ab_+- 1", k=n))
    terms = [(t, str(i)) for i, t in enumerate(piece(rng.randint(1, 5)) for _ in range(n_terms))]
    finder = texts.TermFinder(terms)
    for _ in range(300):
        text = piece(rng.randint(0, 60)).upper()
        assert list(finder.find(text)) == plain_mentions(text, terms), (text, terms)


def test_many_terms_cost_what_few_cost():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 9))) for _ in range(20_000)]
    text = " ".join(rng.choices(words, k=100_000))
    took = []
    for n in (100, 10_000):
        finder = texts.TermFinder([(w + " zz", "X") for w in rng.sample(words, n)])
        start = time.perf_counter()
        assert not list(finder.find(text))
        took.append(time.perf_counter() - start)
    assert took[1] < 6 * took[0]


def test_mention_coverage(spark):
    df = spark.createDataFrame([("1", "pain pain ibuprofen"), ("2", "pain")], "review_id string, review_text string")
    assert rows(reviews.mention_coverage(texts.mentions(df, MENTION_TERMS))) == [("CHEMICAL", 1, 1), ("DISEASE", 3, 2)]


def test_score_texts_scores_equal_texts_once(spark, tmp_path):
    def score(batch):
        with open(tmp_path / "calls", "a") as f:
            f.writelines(t + "\n" for t in batch)
        return [t.upper() for t in batch]

    df = spark.createDataFrame([(i, "ab" if i % 3 else f"t{i}") for i in range(30)] + [(99, None)], "id int, review_text string")
    got = texts.score_texts(df, score).collect()
    assert all(r.raw_output == (r.review_text.upper() if r.review_text else None) for r in got) and len(got) == 31
    assert sorted((tmp_path / "calls").read_text().split()) == sorted({"ab"} | {f"t{i}" for i in range(0, 30, 3)})


VECTORS = {"Cough": [1.0, 0.0], "Rash": [0.0, 2.0], "Also rash": [0.0, 1.0], "Opposite": [-1.0, 0.0]}


@pytest.mark.parametrize("limits", [{}, {"max_catalog_rows": 1, "block_rows": 2}])
def test_nearest_term(spark, limits):
    catalog = spark.createDataFrame(list(VECTORS.items()), "term string, embedding array<double>")
    queries = spark.createDataFrame([("a", [3.0, 0.1]), ("b", [0.0, 5.0]), ("c", [-1.0, -1.0]), (" ", [1.0, 0.0]), ("z", [0.0, 0.0])], "text string, embedding array<double>")
    got = {r.text: (r.matched_term, r.mapped_term, r.similarity) for r in nearest.nearest_term(queries, catalog, **limits).collect()}
    assert got["a"] == ("Cough", "Cough", 1.0) and got["b"] == ("Also rash", "Also rash", 1.0)
    assert got["c"][0] == "Opposite" and got["c"][2] == 0.854
    assert got[" "] == (None, " ", 0.0) and got["z"] == (None, "z", 0.5)
    strict = nearest.nearest_term(queries, catalog, threshold=0.9, **limits).where("text = 'c'").first()
    assert (strict.matched_term, strict.mapped_term) == (None, "c")
    assert nearest.nearest_term(queries, catalog.limit(0)).where("matched_term is not null").isEmpty()


def test_review_flow_from_files(spark, tmp_path):
    (tmp_path / "drugsComTrain_raw.csv").write_text(
        'drugName,condition,review,rating\nAdvil ibuprofen,"a, b","""' + SENTENCE + 'bad\npain ""so"" it was""",8\nother,x,"y",1\n', "utf-8")
    (tmp_path / "drugsComTest_raw.tsv").write_text("DRUGNAME\treview\tuseful\naspirin\t" + SENTENCE + "rash here\t5\n", "utf-8")
    (tmp_path / "notes.csv").write_text("drugName,review\naspirin,ignored\n")
    raw = readers.read_reviews(spark, str(tmp_path))
    assert rows(raw.select("drugname", "source")) == [("Advil ibuprofen", "train"), ("aspirin", "test"), ("other", "train")]
    out = flows.review_flow(spark, str(tmp_path), str(tmp_path / "out"), MENTION_TERMS + [("rash", "DISEASE")], n_labels=5)
    assert {r.drug_norm: r.review_text for r in out["reviews"].collect()} == {
        "ibuprofen": SENTENCE + 'bad pain "so" it was', "aspirin": SENTENCE + "rash here"}
    assert rows(out["mentions"].select("entity_text")) == [("pain",), ("rash",)]
    sheet = spark.read.option("header", "true").option("escape", '"').csv(str(tmp_path / "out/label_sheet"))
    assert sheet.columns == ["review_id", "drug_norm", "review_text_preview", "drugs_gt", "reactions_gt", "severity_gt", "notes"]
    assert sorted(r.drug_norm for r in sheet.collect()) == ["aspirin", "ibuprofen"]
    with pytest.raises(FileNotFoundError):
        readers.read_reviews(spark, str(tmp_path / "out"))


def test_label_sheet_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", "d", 'a "q", with\nbreak', True), ("2", "d", "t" * 300, True), ("0", "d", "no", False)], "review_id string, drug_norm string, review_text string, has_ae_mention boolean")
    sheet = sinks.label_sheet(df, 2).withColumn("drugs_gt", F.when(F.col("review_id") == "1", "a, b").otherwise(""))
    sinks.write_csv(sheet, str(tmp_path / "labels"))
    got = readers.read_labels(spark, str(tmp_path / "labels")).collect()
    assert [(r.review_id, r.review_text_preview, r.drugs_gt) for r in got] == [("1", 'a "q", with\nbreak', "a, b")]
    assert len(sheet.where("review_id = '2'").first().review_text_preview) == 200


def test_audit_column_and_partition_setting(spark):
    from casewatch.session import tune

    assert dict(sinks.stamped(spark.range(1), "created_at").dtypes)["created_at"] == "timestamp"
    before = spark.conf.get("spark.sql.shuffle.partitions")
    tune(spark, shuffle_bytes=1280 << 20)
    assert spark.conf.get("spark.sql.shuffle.partitions") == "10"
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_vectors_of_other_lengths_are_a_clear_error(spark):
    kind = "term string, embedding array<double>"
    asked = spark.createDataFrame([("q", [1.0, 0.0])], "text string, embedding array<double>")
    with pytest.raises(ValueError, match="2 to 3 numbers"):
        nearest.nearest_term(asked, spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0, 0.0])], kind))
    with pytest.raises(PySparkException, match="has not the 3 numbers"):
        nearest.nearest_term(asked, spark.createDataFrame([("b", [1.0, 0.0, 0.0])], kind)).collect()


def test_a_large_vector_catalog_meets_the_queries_as_stored_blocks(spark, monkeypatch):
    import numpy as np

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    draw = np.random.default_rng(5)
    vectors = draw.integers(-2, 3, (60, 3)).astype(float).tolist()  # many equal and parallel ones
    catalog = spark.createDataFrame([(f"t{i}", v) for i, v in enumerate(vectors)], "term string, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(f"q{i}", v) for i, v in enumerate(draw.integers(-2, 3, (50, 3)).astype(float).tolist())], "text string, embedding array<double>")
    want = nearest.nearest_term(asked, catalog)
    assert "CartesianProduct" not in plan(want)
    small = nearest.nearest_term(asked, catalog, max_catalog_rows=0, block_rows=7)
    assert "CartesianProduct" in plan(small) and "Generate" not in plan(small)
    assert rows(small) == rows(want)
    monkeypatch.setattr(nearest, "MAX_CATALOG_BYTES", 60 * 24 - 1)
    assert "CartesianProduct" in plan(nearest.nearest_term(asked, catalog))
