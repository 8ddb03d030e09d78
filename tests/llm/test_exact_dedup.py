import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from casewatch.llm import exact_dedup, fuse_filter


@pytest.mark.parametrize("n", [1, 2, 3, 10, 100, 5000, 120_000])
def test_filter_holds_its_keys_and_few_others(n):
    draw = np.random.default_rng(n)
    keys = np.unique(draw.integers(0, 2**64, n, np.uint64))
    seed, segment, cells = fuse_filter.build(keys)
    assert fuse_filter.contains(keys, seed, segment, cells).all()
    others = draw.integers(0, 2**64, 100_000, np.uint64)
    assert fuse_filter.contains(others, seed, segment, cells).mean() < 0.01
    if n > 10_000:
        assert len(cells) < 1.2 * n


def brute(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    out = []
    for t, ids in groups.items():
        known = [d for d in ids if d is not None]
        keep, free = max(known, default=None), True
        for d in sorted(ids, key=str):
            out.append((d, keep, len(ids), d == keep and free, hashlib.sha256(t.encode()).hexdigest()))
            free = free and d != keep
    return sorted(out, key=str)


def run(spark, rows, **args):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, digest string, n int")
    return sorted((tuple(r) for r in exact_dedup.report(docs, **args).collect()), key=str)


def sample(n, seed):
    draw = random.Random(seed)
    texts = [None, "", " ", "a", "A", "long " * 30_000, "long " * 30_000 + "x"] + [f"t{i}" for i in range(60)]
    rows = [(i, draw.choice(texts) if draw.random() < 0.6 else "hot") for i in range(n)]
    return rows + rows[:20] + [(None, "hot"), (None, "none"), (None, "none"), (7, "seven"), (7, "eight")]


def test_equal_to_brute_force(spark):
    rows = sample(600, 1)
    assert run(spark, rows) == brute(rows)


def test_batches_and_buckets_do_not_change_the_result(spark):
    rows = sample(300, 2)
    assert run(spark, rows, n_batches=1) == run(spark, rows, n_batches=5, per_bucket=4) == brute(rows)


def test_colliding_digests_are_told_apart_by_bytes(spark):
    rows = sample(200, 3)
    weak = lambda text: F.encode(F.substring(F.sha2(text, 256), 1, 1), "utf-8")
    assert run(spark, rows, digest=weak) == brute(rows)


def test_empty_table_and_empty_batches(spark):
    assert run(spark, []) == []
    assert run(spark, [(4, "a")], n_batches=3) == brute([(4, "a")])


def test_a_later_batch_is_screened_by_every_snapshot(spark):
    index = exact_dedup.Snapshots(spark)
    for number in range(3):
        index.add(spark.createDataFrame([(10 * number + i, f"t{i if i < 3 else 10 * number + i}") for i in range(8)], "doc_id long, text string"))
    assert [f.count() for _, f, _ in index.taken] == [1, 1, 1] and not index.collided
    got = {(r.batch, r.text): (r.keep_id, r.group_size) for r in index.classes().collect()}
    assert len(got) == 24 and all(got[b, f"t{i}"] == (20 + i, 3) for b in range(3) for i in range(3))


def test_staying_rows_keep_their_columns(spark):
    docs = spark.createDataFrame([(1, "a", "p", 0), (2, "a", "q", 0), (2, "a", "q", 0), (3, None, "r", 0), (None, "", "s", 0)], "doc_id long, text string, row string, row_id int")
    kept = exact_dedup.deduplicated(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [(2, "a", "q", 0), (3, None, "r", 0)]
