"""Ranking of a linked list whose elements lie anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewatch.llm.common import Shelf, emit

SMALL = 1 << 15  # elements that one task ranks at the end
LINK = pa.schema([("id", pa.int64()), ("next", pa.int64()), ("w", pa.int64()), ("gone", pa.bool_())])
LINKS = "id long, next long, w long, gone boolean"
END = -1


def jumped(ids: np.ndarray, follow: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each element's first successor outside the given ones, the weight up to it, and whether a given element precedes it."""
    order = np.argsort(ids)
    at = np.searchsorted(ids, follow, sorter=order)
    at = order[np.minimum(at, len(ids) - 1)]
    inside = ids[at] == follow
    at = np.where(inside, at, np.arange(len(ids)))
    preceded = np.zeros(len(ids), bool)
    preceded[at[inside]] = True
    follow, w, going = follow.copy(), w.copy(), np.flatnonzero(inside)
    hop, last = at.copy(), ~inside
    while len(going):  # pointer jumping: 2, 4, 8, ... elements at a time
        to = hop[going]
        new_w, new_follow, new_hop, end = w[going] + w[to], follow[to], hop[to], last[to]
        w[going], follow[going], hop[going], last[going] = new_w, new_follow, new_hop, end
        going = going[~end]
    return follow, w, preceded


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of the list inside a batch become one element, the run's first; the others leave with their way to the run's end."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, follow, w = (batch[c].to_numpy() for c in ("id", "next", "w"))
        follow, w, preceded = jumped(ids, follow, w)
        yield emit(LINK, id=ids, next=follow, w=w, gone=preceded)


def spliced(now: DataFrame, round_: int) -> DataFrame:
    """One round of random mates: every element throws a coin, and one with 1 after one with 0 leaves the list."""
    coin = F.pmod(F.xxhash64("id", F.lit(round_)), F.lit(2))
    zero = now.where(coin == 0)
    one = now.where(coin == 1).select(F.col("id").alias("i"), F.col("next").alias("n"), F.col("w").alias("v"))
    row = lambda i, n, w, gone: F.struct(i.alias("id"), n.alias("next"), w.alias("w"), F.lit(gone).alias("gone"))
    a, b = [F.col(c) for c in ("id", "next", "w")], [F.col(c) for c in ("i", "n", "v")]
    both = F.array(row(a[0], b[1], a[2] + b[2], False), row(*b, True))
    alone = F.when(b[0].isNull(), F.array(row(*a, False))).otherwise(F.array(row(*b, False)))
    met = zero.join(one, zero["next"] == one["i"], "full_outer")
    return met.select(F.explode(F.when(a[0].isNotNull() & b[0].isNotNull(), both).otherwise(alone)).alias("row")).select("row.*")


def ranks(links: DataFrame, near: str, shelf: Shelf, small: int = SMALL) -> DataFrame:
    """(``id``, ``rank``): how many elements follow each, itself included.

    ``links`` has ``id``, ``next`` (-1 at the end) and a column ``near`` that successive elements tend to
    share. Runs that meet in a batch of rows of one ``near`` range are contracted first. Random-mate rounds
    then take out about a quarter of the elements each, until at most ``small`` are left for one task.
    What left the list is ranked on the way back, each round from the element it pointed to. Every round is
    a written table; it is the same however often its tasks run, and no row holds more than one link.
    """
    start = links.repartitionByRange(near).sortWithinPartitions(near).select("id", "next", F.lit(1).cast("long").alias("w"))
    held = shelf.put(start.mapInArrow(contracted, LINKS), "runs")
    left, now = [held.where("gone")], held.where("NOT gone").drop("gone")
    while now.count() > small:
        held = shelf.put(spliced(now, len(left)), f"mates-{len(left)}")
        left.append(held.where("gone"))
        now = held.where("NOT gone").drop("gone")
    known = shelf.put(now.coalesce(1).mapInArrow(whole, "id long, rank long"), "ranked-last")
    for depth, gone in reversed(list(enumerate(left))):
        after = known.select(F.col("id").alias("next"), F.col("rank").alias("after"))
        found = gone.join(after, "next", "left").select("id", (F.col("w") + F.coalesce("after", F.lit(0))).alias("rank"))
        known = shelf.put(known.unionByName(found), f"ranked-{depth}")
    return known


def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranks of the few elements that are left."""
    batches = [b for b in batches if b.num_rows]
    if batches:
        ids, follow, w = (np.concatenate([b[c].to_numpy() for b in batches]) for c in ("id", "next", "w"))
        _, w, _ = jumped(ids, follow, w)
        yield emit(pa.schema([("id", pa.int64()), ("rank", pa.int64())]), id=ids, rank=w)
