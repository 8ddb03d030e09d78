import random

import numpy as np
from casewatch.llm import decontaminate as dc

ITEMS = [(i, " ".join("".join(random.Random(i * 100 + j).choices("abcdefghij", k=6)) for j in range(25))) for i in range(12)]


def distance(item, text):
    """Least edit distance of the item to any run of the text."""
    row = np.zeros(len(text) + 1, int)
    for r, c in enumerate(item):
        new = np.empty_like(row)
        new[0] = r + 1
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (np.frombuffer(text, np.uint8) != c))
        steps = np.arange(len(new))
        new = np.minimum.accumulate(new - steps) + steps
        row = new
    return int(row.min())


def edited(rng, text, edits):
    s = list(text)
    for _ in range(edits):
        at = rng.randrange(len(s))
        kind = rng.randrange(3)
        if kind == 0:
            s[at] = rng.choice("xyz")
        elif kind == 1:
            s.insert(at, rng.choice("xyz"))
        else:
            del s[at]
    return "".join(s)


def test_found_within_the_budget_as_brute_force_says():
    rng = random.Random(5)
    items = dc.Items([(k, t.encode()) for k, t in ITEMS], dc.RATE, dc.LEAST)
    for _ in range(60):
        k, t = rng.choice(ITEMS)
        around = " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(40))
        at = rng.randrange(len(around))
        text = dc.normal((around[:at] + " " + edited(rng, t, rng.randrange(0, 26)) + " " + around[at:]).encode())
        want = [i for i, x in ITEMS if distance(dc.normal(x.encode()), text) <= int(dc.RATE * len(dc.normal(x.encode())))]
        assert sorted(items.found(text)) == want


def frames(spark):
    docs = [(1, "Clean prose. " * 30, "x"), (2, "Before. " + ITEMS[3][1].upper().replace(" ", ",  ") + " after", "x"),
            (3, None, "x"), (4, "", None), (None, ITEMS[4][1], "x"), (6, ITEMS[5][1][:60], "x"), (2, "Before. " + ITEMS[3][1], "x"),
            (8, ITEMS[1][1] + " " + ITEMS[2][1], "x"), (9, "word " * 9000 + ITEMS[0][1], "x")]
    return (spark.createDataFrame(docs, "doc_id long, text string, benchmark_items string"),
            spark.createDataFrame([*ITEMS, (50, "word"), (51, None), (None, ITEMS[0][1])], "item_id long, text string"))


def test_report_and_filter(spark):
    docs, benchmark = frames(spark)
    got = sorted(((r.doc_id, r.contaminated, r["items"]) for r in dc.report(docs, benchmark).collect()), key=str)
    assert got == sorted([(1, False, []), (2, True, [3]), (2, True, [3]), (3, False, []), (4, False, []), (None, True, [4]),
                          (6, False, []), (8, True, [1, 2]), (9, True, [0])], key=str)
    left = dc.decontaminated(docs, benchmark)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [1, 3, 4, 6]
    blocks = dc.marked(docs.drop("benchmark_items"), benchmark, block_bytes=300)
    assert sorted(((r.doc_id, r.benchmark_items) for r in blocks.collect()), key=str) == [(d, i) for d, _, i in got]


def test_empty_tables(spark):
    docs, benchmark = frames(spark)
    assert dc.report(docs.limit(0), benchmark).count() == 0
    assert dc.report(docs, benchmark.limit(0)).where("contaminated").count() == 0
