"""Benchmark decontamination by q-gram lemma filtering.

A document region within ``e`` edits of an item of m characters shares at least m - q + 1 - q * e of
its q-grams, on diagonals (place in the document less place in the item) no more than ``e`` apart.
Shared q-grams are counted in overlapping bands of 2e + 1 diagonals; only bands that meet the bound
are verified, by a banded alignment of the whole item. The items go over all documents in blocks of
bounded size. Characters are the UTF-8 bytes of the normalised text: A-Z lower-cased, every run of
other ASCII than letters and digits one space.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewatch.llm.common import per_batch, raw

Q = 8
RATE = 0.08
LEAST = 24
BLOCK_BYTES = 2 << 20
TABLE = 22
PLAIN = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256)
)


def normal(text: bytes) -> bytes:
    return b" ".join(text.translate(PLAIN).split())


def grams(data: np.ndarray) -> np.ndarray:
    """The q-gram of eight bytes at each place, as a number."""
    h = data.astype(np.uint64)
    for size in (1, 2, 4):
        h = (h[:-size] << np.uint64(8 * size)) | h[size:] if len(h) > size else h[:0]
    return h


def slots(g: np.ndarray) -> np.ndarray:
    return (g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE)


class Items:
    """The q-grams of a block of benchmark items, ready for lookup."""

    def __init__(self, items: list[tuple[int, bytes]], rate: float, least: int):
        self.ids, self.texts, gram, item, place = [], [], [], [], []
        for key, text in items:
            text = normal(text)
            if len(text) < max(least, Q):
                continue
            g = grams(np.frombuffer(text, np.uint8))
            gram.append(g)
            item.append(np.full(len(g), len(self.ids)))
            place.append(np.arange(len(g)))
            self.ids.append(key)
            self.texts.append(np.frombuffer(text, np.uint8))
        size = np.array([len(t) for t in self.texts], np.int64)
        self.edits = np.minimum((rate * size).astype(np.int64), (size - Q) // Q)
        self.bound = size - Q + 1 - Q * self.edits
        join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
        gram, item, place = join(gram, np.uint64), join(item, np.int64), join(place, np.int64)
        order = np.argsort(gram, kind="stable")
        self.grams, self.item, self.place = gram[order], item[order], place[order]
        self.table = np.zeros(1 << TABLE, bool)
        self.table[slots(self.grams)] = True

    def found(self, text: bytes) -> list[int]:
        """Ids of the items that a document holds within their edit budgets."""
        if len(text) < Q or not self.ids:
            return []
        data = np.frombuffer(text, np.uint8)
        g = grams(data)
        at = np.flatnonzero(self.table[slots(g)])
        if not len(at):
            return []
        first, last = np.searchsorted(self.grams, g[at]), np.searchsorted(self.grams, g[at], side="right")
        count = last - first
        at, first, count = at[count > 0], first[count > 0], count[count > 0]
        if not len(at):
            return []
        which = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        item, place = self.item[which], self.place[which]
        diagonal = np.repeat(at, count) - place
        hits = np.bincount(item, minlength=len(self.ids))
        out = []
        for i in np.flatnonzero(hits >= self.bound):
            mine = item == i
            if self.verified(data, int(i), diagonal[mine], place[mine]):
                out.append(self.ids[i])
        return out

    def verified(self, data: np.ndarray, i: int, diagonal: np.ndarray, place: np.ndarray) -> bool:
        e, bound = int(self.edits[i]), int(self.bound[i])
        step = e + 1  # bands of 2e + 1 diagonals, each e + 1 further: any e + 1 neighbours lie in one
        low = int(diagonal.min())
        band = np.concatenate(((diagonal - low) // step, (diagonal - low) // step - 1))
        pairs = np.unique((band + 1) * len(self.texts[i]) + np.concatenate((place, place)))
        bands, n = np.unique(pairs // len(self.texts[i]) - 1, return_counts=True)
        return any(aligned(self.texts[i], data, low + int(b) * step, 2 * step, e) for b in bands[n >= bound])


def aligned(item: np.ndarray, data: np.ndarray, low: int, width: int, edits: int) -> bool:
    """Whether the item is within ``edits`` of some run of ``data`` near the diagonals from ``low`` on."""
    first = low - edits
    size = width + 2 * edits + 1
    steps = np.arange(size)
    far = edits + 1
    row = np.where((first + steps >= 0) & (first + steps <= len(data)), 0, far)
    padded = first + steps
    for r in range(len(item)):
        at = padded + r  # the character of the document that this diagonal reads
        inside = (at >= 0) & (at < len(data))
        same = np.zeros(size, bool)
        same[inside] = data[at[inside]] == item[r]
        new = np.where(inside, row + ~same, far)
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)  # item character left out
        new = np.minimum.accumulate(new - steps) + steps  # document characters put in
        row = np.minimum(new, far)
        row[(at + 1 < 0) | (at + 1 > len(data))] = far
        if row.min() > edits:
            return False
    return bool(row.min() <= edits)


def blocks_of(benchmark: DataFrame, block_bytes: int) -> list[list[tuple[int, bytes]]]:
    """The benchmark in blocks of about ``block_bytes``: each is sent whole to every task."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).where(
        "item_id IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"]
    n = max(1, -(-int(size or 0) // block_bytes))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [[(r[0], bytes(r[1])) for r in items.where(block == i).orderBy("item_id", "text").toLocalIterator()] for i in range(n)]


def marked(
    docs: DataFrame, benchmark: DataFrame, rate: float = RATE, least: int = LEAST, block_bytes: int = BLOCK_BYTES,
    column: str = "benchmark_items",
) -> DataFrame:
    """``docs`` with ``column``: the sorted ids of the items each text holds (array<long>, empty if none).

    An item counts if some region of the document is within ``rate`` of the item's length in edits;
    items shorter than ``least`` characters, null ones and those without an id are no evidence.
    Null and empty texts hold nothing; rows repeat as they come. A column of that name is replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    docs = docs.drop(column)
    schema = to_arrow_schema(docs.schema).append(pa.field(column, pa.list_(pa.int64())))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    sent = [docs.sparkSession.sparkContext.broadcast(b) for b in blocks_of(benchmark, block_bytes)]
    ready: dict[int, Items] = {}

    def run(batch):
        texts = [normal(t) for t in raw(batch, "text")]
        found: list[set] = [set() for _ in texts]
        for k, block in enumerate(sent):
            if len(sent) > 1 or k not in ready:
                ready.clear()
                ready[k] = Items(block.value, rate, least)
            for mine, text in zip(found, texts):
                mine.update(ready[k].found(text))
        arrays = [batch.column(n).cast(schema.field(n).type) for n in schema.names[:-1]]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array([sorted(f) for f in found], pa.list_(pa.int64()))], schema=schema)

    return docs.mapInArrow(per_batch(run), f"{fields}, `{column}` array<long>")


def decontaminated(docs: DataFrame, benchmark: DataFrame, **args) -> DataFrame:
    """The documents that hold no benchmark item, with their own columns."""
    name = "benchmark_items"
    while name in docs.columns:
        name += "_"
    return marked(docs, benchmark, column=name, **args).where(F.size(name) == 0).drop(name)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, contaminated, n_items, items."""
    found = marked(docs.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id", (F.size("benchmark_items") > 0).alias("contaminated"),
        F.size("benchmark_items").cast("long").alias("n_items"), F.col("benchmark_items").alias("items"),
    )
