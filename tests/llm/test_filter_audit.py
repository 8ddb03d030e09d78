import math
import random
import re
from itertools import permutations

import numpy as np
import pandas as pd

from casewatch.llm import filter_audit


def fails(docs):
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    out = []
    for d, t, _ in docs:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        out.append({
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and d > first[t]})
    return out


def brute(docs, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    found, out = fails(docs), []
    for part in sorted({p or "" for *_, p in docs}):
        rows = [(d, f) for (d, _, p), f in zip(docs, found) if (p or "") == part]
        mine = []
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                lost = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                mine.append([part, "".join(order), step, len(left), len(lost), sum(r[1][f] for r in rows) - len(lost),
                             sum(r[1][f] and sum(r[1].values()) == 1 for r in rows), sum(r[0] in good for r in lost), sum(r[0] in toxic for r in lost)])
        total = {f: sum(r[4] for r in mine if r[1][r[2] - 1] == f) for f in "ABCDE"}
        out += [(*r, total[r[1][r[2] - 1]]) for r in mine]
    return sorted(out)


def run(spark, docs, labels):
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, lang string, mask int, part string")
    la = spark.createDataFrame([(*r, "y") for r in labels], "doc_id long, quality int, toxic int, n string")
    return sorted(tuple(r) for r in filter_audit.audit(d, la).collect())


def test_equal_to_brute_force(spark):
    draw = random.Random(4)
    many = " ".join(f"w{i}" for i in range(120))
    texts = [None, "", "short", many, many.upper(), many + " # |", "a b " * 80, "A B " * 80 + "$", "é " * 100, "long word " * 20_000]
    docs = [(i, draw.choice(texts), draw.choice(["en", "de", None, ""])) for i in range(150)]
    docs += docs[:9] + [(None, many, "en"), (None, "alone", "fr"), (3, "other", "en"), (0, many, "xx")]
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for i in range(0, 160, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    assert run(spark, docs, labels) == brute(docs, labels)


def test_empty_tables(spark):
    assert run(spark, [], []) == [] and len(run(spark, [(1, None, None)], [])) == 600


def test_gray_walk_toggles_one_filter_and_meets_every_subset():
    steps = list(filter_audit.gray_walk(5))
    subsets = [0, *(s for _, s in steps)]
    assert sorted(subsets) == list(range(32)) and all(a ^ b == 1 << f for a, b, (f, _) in zip(subsets, subsets[1:], steps))


def test_states_equal_direct_counts():
    draw = np.random.default_rng(3)
    held = pd.DataFrame({"mask": np.arange(32), **{c: draw.integers(0, 50, 32) for c in filter_audit.MEASURES}})
    states = filter_audit.walk("p", held)
    for s in range(32):
        want = held[(held["mask"] & s) == 0][list(filter_audit.MEASURES)].sum()
        assert (states.loc[states["subset"] == s, list(filter_audit.MEASURES)].iloc[0] == want).all()
    shares = filter_audit.steps_of("p", states).drop_duplicates(["filter_order", "step"])
    total = shares.assign(f=[o[k - 1] for o, k in zip(shares["filter_order"], shares["step"])]).groupby("f")["shapley"].first().sum()
    assert total == math.factorial(5) * (held["n"].sum() - held.loc[held["mask"] == 0, "n"].sum())
