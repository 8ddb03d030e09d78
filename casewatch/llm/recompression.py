"""Repeated word windows, found by recompression.

Rounds rename a token sequence: runs of one symbol become a symbol, then, with the symbols divided
into left and right ones, each left symbol followed by a right one becomes a symbol. A name is a
hash of what it stands for, so every Spark task gives equal content the same name, and no table of
names has to be gathered. With each symbol go the words that decide it: its own and those of the
neighbours that were looked at. A symbol decided inside a window is the same wherever that window
stands, so the window takes the least symbol of the highest level it has as its anchor; shared
anchors reveal long repeats, and fingerprints of the words around them verify these
(``window_repeats``).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewatch.llm.common import Memo, emit, parts, per_batch, raw
from casewatch.llm.window_repeats import LOW, MIX, Sequences, covered, mixed, repeats

LEVELS = 4
UNSEEN = 1 << 40  # a place beyond any sequence


def renamed(name, lo, hi, level: int):
    """One round: names of symbols and, for each, the words [lo, hi) that decide it."""
    salt = mixed(np.array([level + 1], np.uint64))
    # runs: whether a symbol goes on depends on both neighbours; beyond an end nothing is known
    lo, hi = np.concatenate(([-1], lo[:-1])), np.concatenate((hi[1:], [UNSEEN]))
    new = np.ones(len(name), bool)
    new[1:] = name[1:] != name[:-1]
    at = np.flatnonzero(new)
    size = np.diff(np.concatenate((at, [len(name)])))
    end = at + size - 1
    name = np.where(size > 1, mixed(name[at] * MIX + size.astype(np.uint64) + salt), name[at])
    lo, hi = lo[at], hi[end]
    # pairs: a left symbol looks at the next one, a right symbol at the one before
    right = (mixed(name + salt) & np.uint64(1)).astype(bool)
    before, after = np.concatenate(([-1], lo[:-1])), np.concatenate((hi[1:], [UNSEEN]))
    lo, hi = np.where(right, before, lo), np.where(right, hi, after)
    pair = np.zeros(len(name), bool)
    pair[:-1] = ~right[:-1] & right[1:]
    second = np.concatenate(([False], pair[:-1]))
    joined = np.where(pair, mixed(mixed(name + salt) + np.concatenate((name[1:], name[-1:])) * MIX), name)
    hi = np.where(pair, np.concatenate((hi[1:], hi[-1:])), hi)
    lo = np.where(pair, np.minimum(lo, np.concatenate((lo[1:], lo[-1:]))), lo)
    return joined[~second], lo[~second], hi[~second]


def anchors(words: np.ndarray, width: int, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per window the number of its anchor; per anchor its place and its name."""
    count = len(words) - width + 1
    p = np.arange(count)
    anchor, places, names, used = np.full(count, -1), [], [], 0
    name, lo, hi = words, np.arange(len(words)), np.arange(1, len(words) + 1)
    rounds = [(name, lo, hi)]
    for level in range(levels):
        name, lo, hi = renamed(name, lo, hi, level)
        rounds.append((name, np.minimum.accumulate(lo[::-1])[::-1], np.maximum.accumulate(hi)))
    for level in range(levels, -1, -1):
        name, lo, hi = rounds[level]
        todo = np.flatnonzero(anchor < 0)
        if not len(todo):
            break
        places.append(lo)
        names.append(mixed(name * MIX + np.array([level], np.uint64)))
        used += len(name)
        a = np.searchsorted(lo, p[todo])
        b = np.searchsorted(hi, p[todo] + width, side="right")
        some = b > a
        todo, a, b = todo[some], a[some], b[some]
        if not len(todo):
            continue
        keys = (names[-1] & ~LOW) | np.arange(len(name), dtype=np.uint64)
        depth = np.log2(b - a).astype(np.int64)
        least, table = np.empty(len(todo), np.uint64), keys
        for d in range(int(depth.max()) + 1):
            here = depth == d
            least[here] = np.minimum(table[a[here]], table[b[here] - (1 << d)])
            if d < depth.max():
                table = np.concatenate((np.minimum(table[: -(1 << d)], table[1 << d :]), table[len(table) - (1 << d) :]))
        anchor[todo] = (least & LOW).astype(np.int64) + used - len(name)
    return anchor, np.concatenate(places), np.concatenate(names)


def word_sequences(texts: list[bytes], width: int, memo: Memo) -> Sequences:
    split = [t.split() for t in texts]
    bounds = np.concatenate(([0], np.cumsum([len(s) for s in split], dtype=np.int64)))
    words = np.fromiter((memo[w] for s in split for w in s), np.uint64, int(bounds[-1]))
    if len(words) < width:
        return Sequences(np.empty(0, np.uint64), np.empty(0, np.int64), lambda at: at, lambda at: [], bounds)
    anchor, place, name = anchors(words, width)
    return Sequences(mixed(words), anchor, lambda at: place[at], lambda at: [name[at]], bounds)


def remove_repeats(docs: DataFrame, width: int = 35, target: int = 24 << 20) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256, kept (the words left, joined by a space).

    A word goes if a window of ``width`` words that covers it starts anywhere else as well; all
    copies go. A null text has no words. Rows that repeat both id and text are one document and do
    not count against each other; different texts under one id, or without one, are all cut by the
    ranges found in any. Other columns are ignored. An empty table gives no rows.
    """
    least = np.iinfo(np.int64).min
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(least))).alias("doc"), "text")
    n = parts(docs.sparkSession, docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"], target)
    memo = {}

    def read(batch):
        words = memo.get("words") or memo.setdefault("words", Memo(xxhash.xxh3_64_intdigest))
        return word_sequences(raw(batch, "text"), width, words)

    found = repeats(docs, read, width, 0, 1, n, lambda rows: (rows["core0"] % np.uint64(n)).astype(np.int64), False)
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()),
                     ("kept", pa.string())])

    def cut(batch):
        made = []
        for text, ranges in zip(raw(batch, "text"), batch.column("ranges").to_pylist()):
            words = text.split()
            total = len(words)
            if ranges:
                gone = covered(ranges, width, total)
                words = [w for w, x in zip(words, gone.tolist()) if not x]
            made.append((total, total - len(words), b" ".join(words)))
        doc = [None if d == least else d for d in batch.column("doc").to_pylist()]
        yield emit(out, doc_id=doc, n_words=[m[0] for m in made], n_removed=[m[1] for m in made],
                   kept_sha256=[hashlib.sha256(m[2]).hexdigest() for m in made], kept=[m[2].decode() for m in made])

    return found.select("doc", "text", "ranges").mapInArrow(
        per_batch(cut), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
    )
