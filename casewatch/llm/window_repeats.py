"""Repeated windows of token sequences, found through anchors.

Each window of ``width`` tokens has an anchor chosen by its content alone, so equal windows have
their anchors at equal offsets. Consecutive windows with one anchor form an extent. Extents with
equal content are equal window by window; only where an anchor's content has several different
extents (the edges of a repeat) single windows are compared. So a long repeat costs one row per
anchor and not one per token, and the comparison is still exact.

Rows travel as packed columns, one blob for each map task and bucket. Of equal keys a map task
sends only its first row to the key's bucket; the others are known to be repeats and are dealt out
evenly. A passage that stands in a third of all documents therefore costs its bucket one row per
map task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewatch.llm.common import Batches, emit, pieces_of

MIX = np.uint64(0x9E3779B97F4A7C15)
BASE = 0x5851F42D4C957F2D
SHIFT = np.uint64(28)
LOW = np.uint64((1 << 28) - 1)
FLUSH = 400_000
ROWS = 192  # documents at a time


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            grow = lambda b: np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, b, np.uint64), dtype=np.uint64)))
            self.up, self.down = grow(BASE), grow(pow(BASE, -1, 1 << 64))
        return self.up[:n], self.down[:n]


POWERS = Powers()


class Fingerprints:
    """Hashes of any run of letters in constant time."""

    def __init__(self, letters: np.ndarray):
        up, self.down = POWERS(len(letters) + 1)
        self.sums = np.zeros(len(letters) + 1, np.uint64)
        np.cumsum(letters * up[:-1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


@dataclass
class Sequences:
    """A slice of documents as one token sequence.

    ``letters``: one hash per letter; a window of ``width`` tokens has ``width - overlap`` letters.
    ``anchor``: per window the number of its anchor. ``place``: where anchors stand. ``core``: one or
    two hash columns of anchors' content. ``bounds``: the documents' first tokens, and the end.
    """

    letters: np.ndarray
    anchor: np.ndarray
    place: Callable[[np.ndarray], np.ndarray]
    core: Callable[[np.ndarray], list[np.ndarray]]
    bounds: np.ndarray


def windows_of(bounds: np.ndarray, width: int, total: int) -> np.ndarray:
    """For each window start, whether the window lies in one document."""
    good = np.zeros(max(total - width + 1, 0), bool)
    step = np.zeros(len(good) + 1, np.int64)
    lengths = np.diff(bounds)
    fits = lengths >= width
    np.add.at(step, bounds[:-1][fits], 1)
    np.add.at(step, bounds[1:][fits] - width + 1, -1)
    return np.cumsum(step[:-1]) > 0


def planes(column: np.ndarray) -> bytes:
    """A column's bytes, all first bytes before all second ones: small numbers then compress well."""
    return column.view(np.uint8).reshape(len(column), -1).T.tobytes()


def blobs(rows: dict[str, np.ndarray], bucket: np.ndarray, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    parts = {n: np.split(c[order], cuts) for n, c in rows.items()}
    keys = bucket[order][np.concatenate(([0], cuts))] if len(order) else bucket[:0]
    for at in range(0, len(keys), 64):
        some = range(at, min(at + 64, len(keys)))
        yield emit(schema, bucket=keys[at : at + 64], blob=[b"".join(planes(parts[n][i]) for n in parts) for i in some],
                   n=[len(parts["doc"][i]) for i in some])


BLOBS = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("blob", pa.binary())])
BLOBS_SQL = "bucket int, n int, blob binary"


def sent(rows: dict[str, np.ndarray], keys: list[str], route: Callable, n: int) -> Iterator[pa.RecordBatch]:
    """Rows of one map task as blobs; of each key the first by (doc, place) goes to its bucket.

    ``mark`` tells what a map task knows: 0 alone, 1 first of several here, 2 not the first.
    """
    order = np.lexsort([rows["place"], rows["doc"], *[rows[k] for k in reversed(keys)]])
    rows = {k: c[order] for k, c in rows.items()}
    same = np.ones(max(len(order) - 1, 0), bool)
    for k in keys:
        same &= rows[k][1:] == rows[k][:-1]
    twice = same & (rows["doc"][1:] == rows["doc"][:-1]) & (rows["place"][1:] == rows["place"][:-1])
    after = np.concatenate(([False], same)) if len(order) else same
    mark = np.where(after, 2, 0)
    differs = same & ~twice
    mark[:-1][differs & ~after[:-1]] = 1
    keep = np.ones(len(order), bool)
    keep[1:] = ~twice  # a row of the input that repeats a document
    rows = {k: c[keep] for k, c in rows.items()}
    mark, bucket = mark[keep], route(rows)[:] if len(order) else np.empty(0, np.int64)
    spread = mixed(rows["doc"].view(np.uint64) + rows["place"].view(np.uint64)) % np.uint64(n)
    bucket = np.where(mark == 2, spread.astype(np.int64), bucket)
    yield from blobs(rows | {"mark": mark.astype(np.uint8)}, bucket.astype(np.int32), BLOBS)


def received(batches: Batches, names: list[str]) -> dict[str, np.ndarray]:
    """All rows of the buckets in this partition."""
    got: dict[str, list] = {n: [] for n in names}
    for batch in batches:
        for size, blob in zip(batch.column("n").to_pylist(), batch.column("blob").to_pylist()):
            at = 0
            for n in names:
                kind = np.uint8 if n == "mark" else np.int64 if n in ("doc", "place") else np.uint64
                width = np.dtype(kind).itemsize
                flat = np.frombuffer(blob, np.uint8, size * width, at).reshape(width, size)
                got[n].append(np.ascontiguousarray(flat.T).reshape(-1).view(kind))
                at += size * width
    return {n: np.concatenate(c) if c else np.empty(0, np.uint64) for n, c in got.items()}


def multikey_order(columns: list[np.ndarray]) -> np.ndarray:
    """Order by the first column, then each run of equals by the next, and so on (multikey quicksort by columns)."""
    order = np.argsort(columns[0], kind="quicksort")
    run = np.concatenate(([False], columns[0][order][1:] == columns[0][order][:-1])) if len(order) else order.astype(bool)
    for column in columns[1:]:
        tied = run | np.concatenate((run[1:], [False])) if len(run) else run
        where = np.flatnonzero(tied)
        if not len(where):
            break
        group = np.cumsum(~run)[where]
        inner = np.lexsort([column[order[where]], group])
        order[where] = order[where[inner]]
        value = column[order]
        run[1:] &= value[1:] == value[:-1]
    return order


FOUND = pa.schema([("doc", pa.int64()), ("place", pa.int64()), ("kind", pa.int8())])
FOUND_SQL = "doc long, place long, kind byte"
REPEAT, COMPARE = 1, 2


def judge(rows: dict[str, np.ndarray], keys: list[str], core: list[str], first_stays: bool) -> Iterator[pa.RecordBatch]:
    """Repeats and, where ``core`` is given, the first rows whose single windows are to be compared."""
    done = rows["mark"] == 2
    out = [(rows["doc"][done], rows["place"][done], REPEAT)]
    rows = {k: c[~done] for k, c in rows.items()}
    order = multikey_order([rows[k] for k in keys] + [rows["doc"], rows["place"]])
    rows = {k: c[order] for k, c in rows.items()}
    n = len(order)
    if n:
        def runs(names):
            new = np.zeros(n, bool)
            new[0] = True
            for k in names:
                new[1:] |= rows[k][1:] != rows[k][:-1]
            return new
        first = runs(keys)
        twin = np.concatenate(([False], (rows["doc"][1:] == rows["doc"][:-1]) & (rows["place"][1:] == rows["place"][:-1]))) & ~first
        again = ~first & ~twin
        if not first_stays:
            label = np.cumsum(first) - 1
            many = np.bincount(label, weights=again | (rows["mark"] == 1)) > 0
            again = many[label]
        else:  # twins of a repeat are repeats, twins of the first are the first
            at = np.maximum.accumulate(np.where(twin, 0, np.arange(n)))
            again = again[at]
        out.append((rows["doc"][again], rows["place"][again], REPEAT))
        if core:
            group = np.cumsum(runs(core)) - 1
            several = np.bincount(group, weights=first) > 1
            look = first & several[group]
            out.append((rows["doc"][look], rows["place"][look], COMPARE))
    for doc, place, kind in out:
        for at in range(0, len(doc), 20_000):
            yield emit(FOUND, doc=doc[at : at + 20_000], place=place[at : at + 20_000],
                       kind=np.full(len(doc[at : at + 20_000]), kind, np.int8))


def repeats(
    docs: DataFrame, read: Callable[[pa.RecordBatch], Sequences], width: int, overlap: int, cores: int, n: int,
    route: Callable, first_stays: bool,
) -> DataFrame:
    """``docs`` (doc, text) with ``ranges``: (first window << 32 | windows) of every run of repeated windows.

    ``first_stays``: the first of equal windows, by (doc, place), is no repeat; else all of them are.
    """
    core = [f"core{i}" for i in range(cores)]
    keys = [*core, "extent"]

    def extents(batch):
        seq = read(batch)
        good = windows_of(seq.bounds, width, len(seq.letters) + overlap)
        p = np.flatnonzero(good)
        if not len(p):
            return None
        anchor = seq.anchor[p]
        new = np.ones(len(p), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (p[1:] != p[:-1] + 1)
        at = np.flatnonzero(new)
        lo, hi = p[at], p[np.concatenate((at[1:], [len(p)])) - 1]
        where = anchor[at]
        whose = np.searchsorted(seq.bounds, lo, side="right") - 1
        prints = Fingerprints(seq.letters)
        extent = mixed(prints(lo, hi + width - overlap) + (seq.place(where) - lo).astype(np.uint64))
        doc = batch.column("doc").to_numpy()[whose]
        return dict(zip(core, seq.core(where))) | {
            "extent": extent, "doc": doc, "place": ((lo - seq.bounds[whose]) << 32) | (hi - lo + 1)}

    def compared(batch):
        """Single windows of the extents to compare."""
        seq = read(batch)
        prints = Fingerprints(seq.letters)
        spans = batch.column("compare")
        count = np.array([len(x) for x in spans], np.int64)
        place = spans.flatten().to_numpy().astype(np.int64)
        whose = np.repeat(np.arange(len(count)), count)
        size = place & 0xFFFFFFFF
        start = np.repeat(place >> 32, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        whose = np.repeat(whose, size)
        at = start + seq.bounds[whose]
        return {"extent": prints(at, at + width - overlap), "doc": batch.column("doc").to_numpy()[whose], "place": (start << 32) | 1}

    def mapper(make, names, route):
        def run(batches):
            kept, size = [], 0
            for batch in pieces_of(batches, ROWS):
                rows = make(batch)
                if rows is not None and len(rows["doc"]):
                    kept.append(rows)
                    size += len(rows["doc"])
                if size > FLUSH:
                    yield from sent({k: np.concatenate([r[k] for r in kept]) for k in kept[0]}, names, route, n)
                    kept, size = [], 0
            if kept:
                yield from sent({k: np.concatenate([r[k] for r in kept]) for k in kept[0]}, names, route, n)
        return run

    def reducer(names, core):
        def run(batches):
            rows = received(batches, [*names, "doc", "place", "mark"])
            if len(rows["doc"]):
                yield from judge(rows, names, core, first_stays)
        return run

    found = docs.mapInArrow(mapper(extents, keys, route), BLOBS_SQL).repartitionById(n, "bucket").mapInArrow(
        reducer(keys, core), FOUND_SQL
    ).groupBy("doc").agg(
        F.collect_list(F.when(F.col("kind") == REPEAT, F.col("place"))).alias("whole"),
        F.collect_list(F.when(F.col("kind") == COMPARE, F.col("place"))).alias("compare"),
    )
    both = docs.join(found, "doc", "left")
    by_hash = lambda rows: (rows["extent"] % np.uint64(n)).astype(np.int64)
    single = both.where(F.size("compare") > 0).mapInArrow(mapper(compared, ["extent"], by_hash), BLOBS_SQL).repartitionById(
        n, "bucket"
    ).mapInArrow(reducer(["extent"], []), FOUND_SQL).groupBy("doc").agg(F.collect_list("place").alias("single"))
    none = F.array().cast("array<long>")
    return both.join(single, "doc", "left").withColumn(
        "ranges", F.concat(F.coalesce("whole", none), F.coalesce("single", none))
    ).drop("whole", "compare", "single")


def covered(ranges, width: int, total: int) -> np.ndarray:
    """Which of ``total`` tokens the windows cover."""
    step = np.zeros(total + 1, np.int64)
    ranges = np.asarray(ranges, np.int64)
    lo, size = ranges >> 32, ranges & 0xFFFFFFFF
    end = np.minimum(lo + size + width - 1, total)
    lo = np.minimum(lo, total)
    np.add.at(step, lo, 1)
    np.add.at(step, end, -1)
    return np.cumsum(step[:-1]) > 0


def sliding_least(values: np.ndarray, size: int) -> np.ndarray:
    """The least of every ``size`` consecutive values."""
    done, least = 1, values
    while 2 * done <= size:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    rest = size - done
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
