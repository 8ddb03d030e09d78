import random

import brute
import numpy as np
import pytest
from casewatch.llm import recompression, suffix_dedup
from casewatch.llm.window_repeats import multikey_order

EDGE = [
    (1, "a b c d e f g h"), (2, "x a b c d e f g h y"), (3, None), (4, ""), (5, "z " * 40), (6, "a b c d e"),
    (7, "q a b c d e f g h a b c d e f g h"), (8, "one two three four five six"), (9, "one two three four five six"),
    (10, " ".join(f"w{i % 97}" for i in range(9000))), (11, "  \t\n "), (12, "Übung " * 30), (None, "x a b c d e f g h y"),
]


def corpus(seed, n=60):
    """Random texts over few words, with copies, passages, runs and edits."""
    rng = random.Random(seed)
    passage = [rng.choice("abcdefgh") for _ in range(60)]
    texts = []
    for i in range(n):
        kind = rng.randrange(5)
        words = [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(3)) for _ in range(rng.randrange(80))]
        if kind == 0 and texts:
            words = rng.choice(texts).split()
            if words and rng.random() < 0.7:
                words[rng.randrange(len(words))] = "EDIT"
        elif kind == 1:
            a = rng.randrange(40)
            words[len(words) // 2 : len(words) // 2] = passage[a : a + rng.randrange(20)]
        elif kind == 2:
            words += ["run"] * rng.randrange(40)
        texts.append(" ".join(words))
    return [*enumerate(texts)]


def run_words(spark, rows, width):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, ranges string").repartition(3)
    return {r[0]: tuple(r)[1:4] for r in recompression.remove_repeats(docs, width).collect()}


def run_bytes(spark, rows, width):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, doc string").repartition(3)
    return {r[0]: tuple(r)[1:5] for r in suffix_dedup.remove_repeats(docs, width).collect()}


@pytest.mark.parametrize("width", [2, 5, 35])
def test_words_edge_rows(spark, width):
    assert run_words(spark, EDGE, width) == brute.words_removed(EDGE, width)


@pytest.mark.parametrize("width", [33, 40, 100])
def test_bytes_edge_rows(spark, width):
    assert run_bytes(spark, EDGE, width) == brute.bytes_removed(EDGE, width)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_corpora(spark, seed):
    rows = corpus(seed)
    assert run_words(spark, rows, 7) == brute.words_removed(rows, 7)
    assert run_bytes(spark, rows, 50) == brute.bytes_removed(rows, 50)


def test_repeated_rows_and_empty_tables(spark):
    rows = [(1, " ".join(f"w{i}" for i in range(60)))] * 2 + [(2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.n_removed for r in recompression.remove_repeats(docs).collect()] == [0, 0, 0]
    assert [r.n_removed for r in suffix_dedup.remove_repeats(docs).collect()] == [0, 0, 0]
    assert recompression.remove_repeats(docs.limit(0)).count() == 0
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_a_passage_in_every_document(spark):
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [(i, f"a{i} b{i} {passage} c{i} d{i}") for i in range(300)]
    assert run_words(spark, rows, 35) == brute.words_removed(rows, 35)
    assert run_bytes(spark, rows, 100) == brute.bytes_removed(rows, 100)


def test_equal_substrings_have_equal_inner_symbols():
    rng = np.random.default_rng(5)
    inner = rng.integers(0, 9, 35).astype(np.uint64)
    seen = set()
    for _ in range(30):
        left, right = (rng.integers(0, 9, rng.integers(0, 50)).astype(np.uint64) for _ in range(2))
        anchor, place, name = recompression.anchors(np.concatenate((left, inner, right)), 35)
        a = anchor[len(left)]
        seen.add((int(place[a]) - len(left), int(name[a])))
    assert len(seen) == 1


def test_multikey_order_sorts_by_all_columns():
    rng = np.random.default_rng(6)
    columns = [rng.integers(0, 4, 500).astype(np.uint64) for _ in range(4)]
    order = multikey_order(columns)
    rows = list(zip(*[c[order].tolist() for c in columns]))
    assert rows == sorted(rows)
