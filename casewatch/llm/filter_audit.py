"""How filters interact: what each of them removes in every order in which they can be applied."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewatch.llm.common import stored

FILTERS = "ABCDE"
MEASURES = ("n", "good", "toxic")
STATES = "part string, subset int, n long, good long, toxic long"
STEPS = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


def text_failures(text: Column) -> list[Column]:
    """Conditions A to D of a text that is not null."""
    words = F.regexp_extract_all(text, F.lit("([^\\x20\\x09-\\x0D]+)"))
    n, capitals = F.size(words), F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return [
        n < 100, 100 * F.size(F.array_distinct(words)) < 80 * n,
        100 * capitals.cast("long") > 10 * F.length(text), text.rlike("[#$%&*|]"),
    ]


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents by ``part`` and ``mask`` (bit i: they fail filter i): ``n``, ``good`` and ``toxic`` among them.

    Conditions A to D depend on the text alone. E, a smaller id with the same text, holds for all rows of a
    text but those with its smallest id or none, so cells are counted first without E and then with the
    rows of the smallest ids alone; the difference fails E. No join meets a key that many rows share:
    the smallest ids come by partial aggregation and join on (text digest, id).
    """
    text, last = F.coalesce(F.col("text"), F.lit("")), 1 << (len(FILTERS) - 1)
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(text_failures(text))), F.lit(0))
    marked = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), mask.alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"))
    rows = stored(rows.groupBy("doc_id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n")), "masks")  # texts are read once
    rows = rows.join(marked, "doc_id", "left").select("doc_id", "digest", "part", "mask", "n", *[(F.coalesce(c, F.lit(0)) * F.col("n")).alias(c) for c in ("good", "toxic")])
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    firsts = rows.join(first, ["digest", "doc_id"], "left_semi")
    clean = firsts.unionByName(rows.where("doc_id IS NULL"))  # no smaller id exists, or none is known
    sums = [F.sum(c).alias(c) for c in MEASURES]
    by_text = rows.groupBy("part", "mask").agg(*sums)
    passing = clean.groupBy("part", "mask").agg(*sums)
    failing = by_text.unionByName(passing.select("part", "mask", *[(-F.col(c)).alias(c) for c in MEASURES]))
    failing = failing.select("part", (F.col("mask") + last).alias("mask"), *MEASURES)
    return passing.unionByName(failing).groupBy("part", "mask").agg(*sums).where("n > 0")


def gray_walk(n_filters: int) -> Iterator[tuple[int, int]]:
    """(filter toggled, subset of active filters after it) for every subset but the empty one."""
    subset = 0
    for i in range(1, 1 << n_filters):
        bit = (i & -i).bit_length() - 1
        subset ^= 1 << bit
        yield bit, subset


def walk(part: str, held: pd.DataFrame, n_filters: int = len(FILTERS)) -> pd.DataFrame:
    """What survives each subset of active filters, from the mask cells of one part.

    One filter is switched on or off at a time. Each cell counts the active filters it fails; the running
    survivors lose a cell when its counter leaves 0 and get it back when it returns there.
    """
    masks, sizes = held["mask"].to_numpy(), held[list(MEASURES)].to_numpy(np.int64)
    active_failures = np.zeros(len(masks), np.int64)
    survivors = sizes.sum(axis=0)
    states = np.zeros((1 << n_filters, len(MEASURES)), np.int64)
    states[0] = survivors
    for bit, subset in gray_walk(n_filters):
        fails = (masks >> bit & 1).astype(bool)
        if subset >> bit & 1:
            survivors = survivors - sizes[fails & (active_failures == 0)].sum(axis=0)
            active_failures[fails] += 1
        else:
            active_failures[fails] -= 1
            survivors = survivors + sizes[fails & (active_failures == 0)].sum(axis=0)
        states[subset] = survivors
    return pd.DataFrame({"part": part, "subset": np.arange(1 << n_filters), **dict(zip(MEASURES, states.T))})


def survivors(held: DataFrame) -> DataFrame:
    """The 32 states of every part: ``part``, ``subset`` of active filters, surviving ``n``, ``good``, ``toxic``. A part has at most 32 cells."""
    return held.groupBy("part").applyInPandas(lambda key, g: walk(key[0], g), STATES)


def steps_of(part: str, states: pd.DataFrame, names: str = FILTERS) -> pd.DataFrame:
    """Every order and step of one part, as differences of its states."""
    k, all_on = len(names), (1 << len(names)) - 1
    s = states.sort_values("subset")[list(MEASURES)].to_numpy(np.int64)
    before = [[b for b in range(1 << k) if not b >> f & 1] for f in range(k)]
    weight = [math.factorial(b.bit_count()) * math.factorial(k - 1 - b.bit_count()) for b in range(all_on)]
    shapley = [sum(weight[b] * int(s[b, 0] - s[b | 1 << f, 0]) for b in before[f]) for f in range(k)]
    out = []
    for order in permutations(range(k)):
        on, name = 0, "".join(names[f] for f in order)
        for step, f in enumerate(order, 1):
            now = on | 1 << f
            lost = s[on] - s[now]
            fails = s[0, 0] - s[1 << f, 0]
            unique = s[all_on & ~(1 << f), 0] - s[all_on, 0]
            out.append((part, name, step, s[now, 0], lost[0], fails - lost[0], unique, lost[1], lost[2], shapley[f]))
            on = now
    return pd.DataFrame(out, columns=[c.split()[0] for c in STEPS.split(", ")])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per ``part`` (language), order of the filters and step, with what the step keeps and removes.

    A null text is empty, a null language the part ''. A document without a label row is neither good nor
    toxic; of several label rows any that says so counts. Repeated rows count each; a null id is larger than
    no id, and no id is larger than it. Long texts count whole. An empty table gives no rows. Other columns,
    whatever their names, are not read.
    """
    return survivors(cells(docs, labels)).groupBy("part").applyInPandas(lambda key, g: steps_of(key[0], g), STEPS)


def oracle() -> str:
    letters = ", ".join(f"('{c}')" for c in FILTERS)
    fails = ", ".join(f"f{c}" for c in FILTERS)
    pick = " ".join(f"WHEN '{c}' THEN f{c}" for c in FILTERS)
    seen = lambda pos, want: " AND ".join(f"NOT coalesce(CASE substr(filter_order, {i}, 1) {pick} END, false)" for i in range(1, pos)) or want
    steps = "\n UNION ALL ".join(
        f"SELECT part, filter_order, {k} AS step, substr(filter_order, {k}, 1) AS letter, n, good, toxic, n_fails, "
        f"({seen(k, 'true')}) AS alive, CASE substr(filter_order, {k}, 1) {pick} END AS fails FROM grid" for k in range(1, 6))
    return f"""
    WITH words AS (
      SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body,
             regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    firsts AS (SELECT body, min(doc_id) AS first FROM words GROUP BY body),
    marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
    tested AS (
      SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
             len(w) < 100 AS fA, 100 * len(list_distinct(w)) < 80 * len(w) AS fB,
             100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 10 * length(body) AS fC,
             regexp_matches(body, '[#$%&*|]') AS fD, coalesce(doc_id > first, false) AS fE
      FROM words JOIN firsts USING (body) LEFT JOIN marks USING (doc_id)),
    held AS (
      SELECT part, {fails}, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic,
             fA::int + fB::int + fC::int + fD::int + fE::int AS n_fails FROM tested GROUP BY part, {fails}),
    l(x) AS (VALUES {letters}),
    orders AS (
      SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
    grid AS (SELECT * FROM held, orders),
    steps AS ({steps}),
    summed AS (
      SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (alive AND NOT fails), 0) AS kept,
             coalesce(sum(n) FILTER (alive AND fails), 0) AS removed, coalesce(sum(n) FILTER (NOT alive AND fails), 0) AS redundant,
             coalesce(sum(n) FILTER (fails AND n_fails = 1), 0) AS unique_fails,
             coalesce(sum(good) FILTER (alive AND fails), 0) AS good_lost, coalesce(sum(toxic) FILTER (alive AND fails), 0) AS toxic_lost
      FROM steps GROUP BY part, filter_order, step, letter)
    SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
           unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
           (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
    FROM summed
    """
