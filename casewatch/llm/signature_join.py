"""Near-duplicate documents by an inverted join over MinHash signature coordinates.

1. Texts with equal shingle sets form one class; a class is known by its smallest ``doc_id``.
2. Every class has a signature of ``COORDINATES`` minima. Each (coordinate, value) has a posting
   list of classes. Linked classes share at least ``least`` coordinates (but for one pair in some
   ten millions, see ``threshold``), so they meet in the lists of their rarest coordinates: of a
   class's lists, ordered by length, the ``least - 1`` longest are skipped, and lists of one class
   alone need no merging.
3. Lists are merged in rounds. A round joins every class of a list with one pivot of that list,
   counts the lists in which the two meet, takes for each class the pivots it meets most often,
   counts the collisions of such a pair over all coordinates, and confirms what passes on the full
   shingle sets. Confirmed pairs unite classes; a list whose classes are all in one component is
   finished. So a group of n near copies costs n comparisons a round, never n squared.
4. What a few rounds leave open is settled exactly. Short lists give all their pairs. In a longer
   list every class is known by its difference from the list's pivot, the shingles that only one of
   the two has. Linked classes differ little from each other, so unless both are linked with the
   pivot, their differences have much in common (see ``across``); classes meet under the rarest
   shingles of their differences alone. Copies that were changed at random share too few, and
   leave without a comparison, however many they are.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewatch.llm.common import Memo, Shelf, emit, lists, pieces_of, raw, stored
from casewatch.llm.components import components

COORDINATES = 32
MISSED = 1e-7
ROUNDS = 4
TRIED = 4  # pivots a class is compared with in a round; the others' turn comes in later rounds
SHORT = 8  # classes of a list whose pairs are all compared: at most three and a half for each of its rows
MIX = np.uint64(0x9E3779B97F4A7C15)


def threshold(similarity: float, coordinates: int = COORDINATES) -> int:
    """The most collisions to ask for such that a pair at ``similarity`` has fewer with a chance below ``MISSED``."""
    low = 0.0
    for k in range(coordinates + 1):
        low += comb(coordinates, k) * similarity**k * (1 - similarity) ** (coordinates - k)
        if low > MISSED:
            return max(k, 1)
    return coordinates


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


def shingle_sets(texts: list[bytes], width: int, words: Memo) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word shingles; a shorter text is one shingle as a whole."""
    sets = []
    for text in texts:
        split = text.lower().split()
        if not split:
            sets.append(np.empty(0, np.int64))
            continue
        h = np.fromiter(map(words.__getitem__, split), np.uint64, len(split))
        size = min(width, len(h))
        out = np.full(len(h) - size + 1, size, np.uint64)
        for i in range(size):
            out = mixed(out * MIX + h[i : len(h) - size + 1 + i])
        sets.append(np.unique(out).view(np.int64))
    return sets


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """A row of minima for each of the given sets, none of which is empty."""
    if not sets:
        return np.empty((0, coordinates), np.int64)
    flat = np.concatenate(sets).view(np.uint64)
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    seeds = np.random.default_rng(7).integers(1, 2**63, (coordinates, 2), np.uint64)
    rows = [np.minimum.reduceat((flat ^ a) * (b | np.uint64(1)), at) for a, b in seeds]
    return np.stack(rows, 1).view(np.int64)


def _word_memo() -> Memo:
    return Memo(xxhash.xxh3_64_intdigest)


def describe(docs: DataFrame, width: int, coordinates: int) -> DataFrame:
    """doc_id, n_shingles, h1 and h2 (hash of the set), signature (null without a set)."""
    kind = "doc_id long, n_shingles long, h1 long, h2 long, signature array<long>"
    out = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()),
                     ("signature", pa.list_(pa.int64()))])

    def run(batches):
        words = _word_memo()
        for batch in pieces_of(batches):
            sets = shingle_sets(raw(batch, "text"), width, words)
            full = [s for s in sets if len(s)]
            signed = iter(signatures(full, coordinates))
            whole = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) for s in sets]).reshape(-1, 2)
            yield emit(out, doc_id=batch.column("doc_id"), n_shingles=[len(s) for s in sets], h1=whole[:, 0],
                       h2=whole[:, 1], signature=[next(signed) if len(s) else None for s in sets])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kind)


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """node, shingles."""
    out = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches):
        words = _word_memo()
        for batch in pieces_of(batches):
            sets = shingle_sets(raw(batch, "text"), width, words)
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
            yield emit(out, node=batch.column("node"), shingles=lists(offsets, np.concatenate(sets)))

    return docs.mapInArrow(run, "node long, shingles array<long>")


def postings(classes: DataFrame, least: int) -> DataFrame:
    """key, node, weight: the lists to merge. Of a class's shared coordinates the ``least - 1`` most frequent are skipped.

    ``weight`` sums the lengths of all lists a class is in: the text that others are copies of weighs most.
    """
    rows = classes.select("node", F.explode("signature").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    ranked = rows.join(shared, "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("keys"))
    weight = F.aggregate("keys", F.lit(0).cast("long"), lambda s, k: s + k["n"]).alias("weight")
    few = F.slice("keys", 1, F.greatest(F.size("keys") - least + 1, F.lit(0)))
    return ranked.select("node", weight, F.explode(few).alias("k")).select(F.col("k.key").alias("key"), "node", "weight")


def confirmed(pairs: DataFrame, described: DataFrame, percent: int, least: int) -> DataFrame:
    """The pairs (a, b) whose signatures collide often enough and whose full sets are similar enough.

    Signatures and set sizes are met first, so full sets travel only with the pairs that pass these.
    """
    side = lambda x, *names: described.select(F.col("node").alias(x), *[F.col(n).alias(f"{x}_{n}") for n in names])
    n = F.col("a_n_shingles"), F.col("b_n_shingles")
    hits = F.aggregate(
        F.arrays_zip("a_signature", "b_signature"), F.lit(0),
        lambda s, p: s + (p["a_signature"] == p["b_signature"]).cast("int"),
    )
    light = pairs.join(side("a", "n_shingles", "signature"), "a").join(side("b", "n_shingles", "signature"), "b")
    light = light.where((100 * F.least(*n) >= percent * F.greatest(*n)) & (hits >= least)).select("a", "b")
    n = F.size("a_shingles"), F.size("b_shingles")
    both = F.size(F.array_intersect("a_shingles", "b_shingles"))
    return (
        light.join(side("a", "shingles"), "a").join(side("b", "shingles"), "b")
        .where(100 * both >= percent * (n[0] + n[1] - both)).select("a", "b")
    )


def across(left: DataFrame, lists_: DataFrame, described: DataFrame, percent: int, shelf: Shelf) -> DataFrame:
    """The pairs (a, b) to compare so that no link between components is missed.

    ``left`` has key, node, root; ``lists_`` has key, n and pivot of the lists to settle. Let D(x) be
    the shingles in which x differs from the pivot p, and c = (100 - percent) / (100 + percent). Sets x and y are
    linked just if they differ in no more than c(|x| + |y|) shingles, and they differ in
    |D(x)| + |D(y)| - 2 |D(x) & D(y)|. If both are linked with p they are in one component. If not, D(x) and
    D(y) have o >= (|D(x)| + |D(y)| - c(|x| + |y|)) / 2 > 0 shingles in common, all of them among those that
    classes of several components differ in. With these sorted by frequency, the first common one
    has o of either class's shingles at or after it, which bounds its place in both: closely in the smaller
    of the two differences, where it is rare.
    """
    less, more = F.lit(100 - percent), F.lit(100 + percent)
    few = left.join(lists_.where(F.col("n") <= SHORT).select("key"), "key", "left_semi")
    x, y = (few.select("key", F.col("node").alias(n), F.col("root").alias(f"{n}_root")) for n in "ab")
    pairs = x.join(y, "key").where("a < b AND a_root <> b_root").select("a", "b")

    many = left.join(lists_.where(F.col("n") > SHORT).select("key", "pivot"), "key").where("node <> pivot")
    many = many.select("node", "root", "pivot").distinct()
    sets = described.select("node", "shingles")
    many = many.join(sets, "node").join(sets.select(F.col("node").alias("pivot"), F.col("shingles").alias("of_pivot")), "pivot")
    many = many.select(
        "node", "root", "pivot", F.size("shingles").alias("size"), F.size("of_pivot").alias("pivot_size"),
        F.array_union(F.array_except("shingles", "of_pivot"), F.array_except("of_pivot", "shingles")).alias("apart"),
    )
    many = shelf.put(many.withColumn("n", F.size("apart")).withColumn(
        "linked", F.col("n") * more <= less * (F.col("size") + F.col("pivot_size"))), "apart")
    linked = many.where("linked").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))

    rows = many.select("node", "root", "pivot", "size", "pivot_size", "n", "linked", F.explode("apart").alias("s"))
    common = rows.groupBy("pivot", "s").agg(
        F.count("*").alias("often"), F.min("root").alias("low"), F.max("root").alias("high"), F.every("linked").alias("all")
    ).where("low <> high AND NOT all").select("pivot", "s", "often")
    rows = rows.join(common, ["pivot", "s"]).groupBy("node", "root", "pivot", "size", "pivot_size", "n", "linked").agg(
        F.sort_array(F.collect_list(F.struct("often", "s"))).alias("shared"))
    rows = rows.select("*", F.posexplode("shared").alias("at", "e")).withColumn("rest", F.size("shared") - F.col("at"))
    rest, n, size = F.col("rest"), F.col("n"), F.col("size")
    half = 2 * more * rest >= more * n + less * (F.col("pivot_size") - size)  # the other is not linked with the pivot
    rows = rows.where((percent * (n - rest) <= less * size) & (~F.col("linked") | half))
    rows = shelf.put(rows.select("pivot", F.col("e.s").alias("s"), "node", "root", "size", "n", "linked", "rest"), "posted")
    side = lambda x, df: df.select("pivot", "s", *[F.col(c).alias(f"{x}_{c}") for c in rows.columns[2:]])
    low, high = side("x", rows.where(2 * percent * (n - rest) <= less * size)), side("y", rows)
    need = (F.col("x_n") + F.col("y_n")) * more - less * (F.col("x_size") + F.col("y_size"))
    met = low.join(high, ["pivot", "s"]).where(
        (F.struct("x_n", "x_node") < F.struct("y_n", "y_node")) & (F.col("x_root") != F.col("y_root"))
        & ~(F.col("x_linked") & F.col("y_linked")) & (2 * more * F.least("x_rest", "y_rest") >= need))
    met = met.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b"))
    return pairs.unionByName(linked).unionByName(met)


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, coordinates: int = COORDINATES, rounds: int = ROUNDS
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    Words are runs without ASCII white space, A-Z lower-cased. Documents link when 100 times the
    common shingles reach ``percent`` times the united ones; ``component_id`` is the smallest
    ``doc_id`` reachable, ``kept`` marks it. Without words (null or blank text) a document links
    with nothing. A null ``doc_id`` is in no component: component_id null, kept true. Rows that
    share a ``doc_id`` count as one document. Other columns are ignored, an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    least = threshold(percent / 100, coordinates)
    rows = stored(describe(docs, width, coordinates), "signatures")
    use = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = use.groupBy("h1", "h2").agg(F.min_by("signature", "doc_id").alias("signature"), F.min("doc_id").alias("node"))
    base = Shelf(docs.sparkSession, "lists")
    lists_ = base.put(postings(classes.select("node", "signature"), least), "postings")
    nodes = lists_.select("node").distinct()
    texts = docs.withColumnRenamed("doc_id", "node").join(nodes, "node", "left_semi")
    signed = rows.select(F.col("doc_id").alias("node"), "n_shingles", "signature").join(nodes, "node", "left_semi")
    described = base.put(full_sets(texts, width).join(signed, "node"), "sets")

    labels, left, done = None, lists_.withColumn("root", F.col("node")), None
    for turn in range(rounds + 1):
        shelf = Shelf(docs.sparkSession, "round")
        if labels is not None:  # only lists that were open before, each round written once
            known = left.drop("root").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
            left = shelf.put(known.select("key", "node", "weight", "root"), "left")
        heavy = F.struct(-F.col("weight"), "node")
        by_root = left.groupBy("key", "root").agg(F.count("*").alias("n"), F.min_by("node", heavy).alias("pivot"))
        by_key = by_root.groupBy("key").agg(
            F.sum("n").alias("n"), F.count("*").alias("roots"), F.min_by("pivot", F.struct(-F.col("n"), "root")).alias("pivot")
        ).where("roots > 1")
        by_key = shelf.put(by_key, "open")
        if by_key.isEmpty():
            break
        left = left.join(by_key.select("key"), "key", "left_semi")
        if turn == rounds:
            pairs = across(left, by_key, described, percent, shelf)
        else:
            order = F.struct(F.col("weight") * (turn % 2 - 1), F.xxhash64("node", F.lit(turn)))  # the heaviest and any in turn
            pivot = left.groupBy("key").agg(F.min_by(F.struct("node", "root"), order).alias("p"))
            met = left.join(pivot, "key").where("root <> p.root").groupBy("node", F.col("p.node").alias("other"))
            best = F.reverse(F.sort_array(F.collect_list(F.struct("n", "other"))))  # as many as a class has lists, at most
            best = met.agg(F.count("*").alias("n")).groupBy("node").agg(F.slice(best, 1, TRIED).alias("best"))
            pairs = best.select("node", F.explode("best.other").alias("other")).select(
                F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")
            )
        found = confirmed(pairs.distinct(), described, percent, least)
        if labels is not None:  # what is known, as a forest of stars
            found = found.unionByName(labels.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
        labels = components(shelf.put(found, "links"), shelf)
        if done is not None:
            done.clear()
        done = shelf
    base.clear()

    out = rows.join(
        classes.select(F.col("h1").alias("c1"), F.col("h2").alias("c2"), "node"),
        (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")) & (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), "left",
    ).drop("c1", "c2")
    if labels is None:
        out = out.withColumn("component_id", F.coalesce("node", "doc_id"))
    else:
        out = out.join(labels, "node", "left").withColumn("component_id", F.coalesce("root", "node", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
