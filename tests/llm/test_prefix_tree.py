import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from casewatch.llm import prefix_tree
from casewatch.llm.common import Shelf
from casewatch.llm.list_rank import ranks

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def ordered(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}


def brute(rows, cross=True):
    convs = ordered(rows)
    if cross:
        built = {}
        for c, own in convs.items():
            h = zlib.crc32(str(c).encode()) % 4
            built[c] = convs.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:]  # SQL's remainder has the sign of c
        convs = built
    members, end = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        end[tuple(turns)].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    saved = {k: (len(m) - 1) * (len(re.findall("[^\x20\x09-\x0d]+", k[-1][1])) if k else 0) for k, m in members.items()}
    leaves = {k: int(not children[k]) for k in members}
    for k in sorted(members, key=len, reverse=True):
        if k:
            saved[k[:-1]] += saved[k]
            leaves[k[:-1]] += leaves[k]
    out = []
    for k, m in members.items():
        ids = ",".join(map(str, sorted(end[k])))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), leaves[k], saved[k], hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, digest int, n_words string")


def run(spark, rows, **args):
    return sorted((tuple(r) for r in prefix_tree.report(frame(spark, rows), **args).select(*COLUMNS).collect()), key=str)


def sample(n_convs, seed):
    draw = random.Random(seed)
    rows = []
    for c in [*range(n_convs), -7, -20, 1005]:
        n = draw.choice([1, 1, 2, 3, 5, 8])
        hot = draw.random() < 0.4
        rows += [(c, t, draw.choice(["u", "a"]) if t > 1 else "u", "same first words" if hot and t < 3 else draw.choice(["hi", "hi  there", "", None, "x y z"])) for t in range(n)]
    rows += [(3, None, None, None), (3, None, "b", "early"), (3, 0, "u", "tie"), (3, 0, "u", "tie"), (None, 1, "u", "lost")]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, small, chunk", [(1, 1 << 15, 1 << 15), (2, 4, 2)])
def test_equal_to_brute_force(spark, seed, small, chunk):
    rows = sample(70, seed)
    assert run(spark, rows, small=small, chunk=chunk) == brute(rows)


def test_a_conversation_that_holds_most_rows(spark):
    rows = [(40, i, "u", f"w{i % 5} w") for i in range(3000)] + [(c, i, "u", f"w{i} w") for c in range(41, 50) for i in range(4)]
    rows += [(c, 0, "u", "copy " * 2000) for c in range(100, 160)]
    assert run(spark, rows, small=50, chunk=7) == brute(rows)


def test_conversations_as_given(spark):
    rows = sample(30, 5)
    got = prefix_tree.trie(*prefix_tree.as_given(prefix_tree.turns_in_order(frame(spark, rows))))
    assert sorted((tuple(r) for r in got.select(*COLUMNS).collect()), key=str) == brute(rows, cross=False)


def test_no_conversations(spark):
    assert run(spark, []) == [] and run(spark, [(None, 1, "u", "a")]) == []


def test_a_turnless_conversation_is_a_member_of_the_root(spark):
    c = next(c for c in range(20, 2000) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(c, 0, "u", "a"), (c, 1, "u", "b")]  # the first of its block is absent, its own first turns go
    assert run(spark, rows) == brute(rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


@pytest.mark.parametrize("n, small", [(1, 10), (2, 1), (3000, 40)])
def test_ranks_of_a_scattered_list(spark, n, small):
    order = list(range(n))
    random.Random(n).shuffle(order)
    rows = [(a, b, a % 13) for a, b in zip(order, [*order[1:], -1])]
    links = spark.createDataFrame(rows, "id long, next long, near long").repartition(5)
    got = {r.id: r.rank for r in ranks(links, "near", Shelf(spark, "list"), small).collect()}
    assert got == {v: n - i for i, v in enumerate(order)}


def test_prefix_names_do_not_depend_on_the_conversation(spark):
    turns = spark.createDataFrame([(c, d, f"t{d}".encode(), 1) for c in (1, 2) for d in range(1, 2100)], "conv_id long, depth long, digest binary, n_words long")
    rows = prefix_tree.prefixes(turns)
    assert rows.groupBy("depth", "p1", "p2", "q1", "q2").count().where(F.col("count") != 2).isEmpty()
    assert rows.select("p1", "p2").distinct().count() == 2099
