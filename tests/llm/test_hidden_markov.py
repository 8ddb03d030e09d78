import itertools
import math
from collections import Counter

import numpy as np
import pytest
from casewatch.llm import hidden_markov as hm


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double").repartition(3)


def corpus():
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):  # two topics that last through a document
        words = "abcdefgh" if i % 2 else "stuvwxyz"
        rows.append((i, " ".join(rng.choice(list(words), rng.integers(1, 60))) + (f" Rare{i}" if i % 5 == 0 else "")))
    return rows + [(900, None), (901, ""), (902, "neverseen words only"), (None, "a b c")]


def test_forward_equals_the_sum_over_all_paths():
    rng = np.random.default_rng(1)
    start, moves, emission = rng.dirichlet([1, 1]), rng.dirichlet([1, 1], 2), rng.random((4, 2))
    ids = rng.integers(0, 4, 12)
    starts, lengths = np.array([0, 5, 6]), np.array([5, 1, 6])
    got = hm.forward(ids, starts, lengths, emission, start, moves)
    for k, (a, n) in enumerate(zip(starts, lengths)):
        total = 0.0
        for path in itertools.product(range(2), repeat=int(n)):
            p = start[path[0]] * emission[ids[a], path[0]]
            for t in range(1, n):
                p *= moves[path[t - 1], path[t]] * emission[ids[a + t], path[t]]
            total += p
        assert got[k] == pytest.approx(math.log(total))


def test_expected_counts_equal_the_posterior_over_all_paths():
    rng = np.random.default_rng(2)
    start, moves, emission = rng.dirichlet([1, 1]), rng.dirichlet([1, 1], 2), rng.random((3, 2))
    ids, n = rng.integers(0, 3, 6), 6
    emitted, moved, first = np.zeros((3, 2)), np.zeros((2, 2)), np.zeros(2)
    weights = {}
    for path in itertools.product(range(2), repeat=n):
        p = start[path[0]] * emission[ids[0], path[0]]
        for t in range(1, n):
            p *= moves[path[t - 1], path[t]] * emission[ids[t], path[t]]
        weights[path] = p
    total = sum(weights.values())
    for path, p in weights.items():
        first[path[0]] += p / total
        for t in range(n):
            emitted[ids[t], path[t]] += p / total
            if t:
                moved[path[t - 1], path[t]] += p / total
    got = hm.expected(ids, np.array([0]), np.array([n]), emission, start, moves, 3)
    for x, y in zip(got, (emitted, moved, first)):
        assert np.allclose(x, y)


def test_base_and_held_out_likelihood(spark):
    rows = corpus()
    tokens = lambda t: (t or "").encode().lower().split() + [hm.END]
    c = Counter(w for d, t in rows if not hm.held_out(d) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in hm.score(frame(spark, rows), frequent=20).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        w, r = tokens(t), got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (hm.held_out(d), len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
        assert math.isfinite(r.score)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # lasting topics beat the unigram model


def test_one_word_probabilities_sum_to_one(spark):
    """All texts of one token and the end: the model's start over every type, unseen ones included."""
    rows = [(i, "a b c d e f"[: 1 + 2 * (i % 6)]) for i in range(40)]
    known = sorted("abcdef")
    probe = [(1000 + i, w) for i, w in enumerate(known)]
    got = {r.doc_id: r for r in hm.score(frame(spark, rows + probe), frequent=3).collect()}
    assert all(got[d].score < 0 for d, _ in probe)
    assert sum(10 ** got[d].score for d, _ in probe) < 1


def test_empty_table(spark):
    assert hm.score(frame(spark, corpus()).limit(0)).count() == 0


def test_first_sums_are_those_of_sparks_hash(spark):
    words = np.array([0, -1, 5, 2**63 - 1, -(2**63)], np.int64)
    from pyspark.sql import functions as F
    d = spark.createDataFrame([(int(w),) for w in words], "word long")
    for s in range(3):
        want = d.select("word", 0.1 + F.pmod(F.xxhash64("word", F.lit(s)), F.lit(1_000_003)) / 1_000_003).collect()
        assert dict(map(tuple, want)) == dict(zip(words.tolist(), hm.noise(words, s).tolist()))


def test_arrays_come_back():
    for a in (np.arange(1000, dtype="<u4"), np.array([], "<f4"), np.array([2**40, -1], "<i8")):
        assert np.array_equal(hm.expanded(hm.squeezed(a), a.dtype), a)


def test_a_chunk_moves_a_row_for_each_bucket_and_not_for_each_word(spark):
    rows = [(i, " ".join(f"w{(i * 37 + j) % 3000}" for j in range(200))) for i in range(300)]
    held = hm.stored(hm.chunks(frame(spark, rows)), "chunks")
    n = held.count()
    made = hm.counts(held, 7, 2, 4).collect()
    assert len(made) <= 7 * (n + 1)
    assert all(hm.expanded(r.place, "<u4").sum() < 3001 for r in made if r.place)  # in one order on both sides, also across 2 ** 63
    made = hm.counts(held, 7, 20, 4).collect()
    few = np.sum([r.few for r in made if r.chunk == hm.FEW], 0)
    c = Counter(w for d, t in rows if not hm.held_out(d) for w in [*t.encode().split(), hm.END])
    rare = [x for x in c.values() if x < 20]
    assert few[:2].tolist() == [sum(c.values()), len(c)]
    assert few[2 : 2 + hm.classes_of(20)].sum() == len(rare) and few[2 + hm.classes_of(20) : 2 + 2 * hm.classes_of(20)].sum() == sum(rare) + len(rare)


def test_scores_do_not_depend_on_the_chunks(spark):
    rows = corpus()
    one = {r.doc_id: r.score for r in hm.score(frame(spark, rows).coalesce(1), frequent=5).collect()}
    many = {r.doc_id: r.score for r in hm.score(frame(spark, rows).repartition(7), frequent=5).collect()}
    assert one.keys() == many.keys() and all(many[d] == pytest.approx(one[d], rel=1e-5) for d in one)


def test_small_input_partitions_share_a_chunk(spark):
    """What moves grows with the chunks, so their number must not follow that of the input's partitions."""
    rows = [(i, f"some words w{i}") for i in range(200)]
    docs = frame(spark, rows).repartition(60)
    held = hm.chunks(docs).collect()
    assert len(held) <= spark.sparkContext.defaultParallelism < 60
    assert sorted(d for r in held for d in r.doc_ids) == list(range(200))


def test_scores_do_not_depend_on_the_runs_of_documents(spark, monkeypatch):
    docs = frame(spark, corpus())
    want = sorted((tuple(r) for r in hm.score(docs, frequent=20).collect()), key=str)
    monkeypatch.setattr(hm, "TOKENS", 10)
    got = sorted((tuple(r) for r in hm.score(docs, frequent=20).collect()), key=str)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-6)
