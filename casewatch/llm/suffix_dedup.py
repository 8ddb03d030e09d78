"""Repeated byte strings, found by sorting sampled suffixes.

Suffixes are sampled by content: of every 100-byte window the suffix at its least 32-byte gram. Splitters
sampled from the documents range-partition the suffixes by their leading eight bytes. A bucket sorts its suffixes
by multikey quicksort (eight bytes, the gram's fingerprint, then that of the text around it)
and compares neighbours. The splitters are values of the leading token, so no run of equal leading
tokens is cut by a boundary between buckets; a run too long for one bucket has been shortened by
the map tasks before (``window_repeats``), which is how it is compared across them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewatch.llm.common import emit, parts, per_batch, raw
from casewatch.llm.window_repeats import LOW, MIX, Sequences, covered, mixed, repeats, sliding_least

GRAM = 32
SAMPLE = 2000  # documents of which the splitters are taken
HALF = np.uint64(0xFFFFFFFF00000000)  # half a fingerprint tells grams with one beginning apart
BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * MIX)


def leading(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each place, as a number that sorts like them."""
    out = np.zeros(len(at), np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | data[at + i]
    return out


def byte_sequences(texts: list[bytes], width: int) -> Sequences:
    data = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
    if len(data) < width:
        return Sequences(np.empty(0, np.uint64), np.empty(0, np.int64), lambda at: at, lambda at: [], bounds)
    h, size = BYTE[data], 1
    for step in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93,
                 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3):
        h = h[:-size] * np.uint64(step) + (h[size:] ^ (h[size:] >> np.uint64(31)))
        size *= 2
    letters = mixed(h)
    keys = (letters & ~LOW) | np.arange(len(letters), dtype=np.uint64)
    anchor = (sliding_least(keys, width - GRAM + 1) & LOW).astype(np.int64)
    return Sequences(letters, anchor, lambda at: at, lambda at: [leading(data, at), letters[at] & HALF], bounds)


def remove_repeats(docs: DataFrame, width: int = 100, target: int = 24 << 20) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary).

    A byte goes if a string of ``width`` bytes that covers it also starts earlier: in a document with
    a smaller ``doc_id``, or in the same one. A null text is empty. A null ``doc_id`` comes before
    all others. Rows that repeat both id and text are one document, each with its result; different
    texts under one id are all cut by the ranges found in any. Other columns are ignored. An empty
    table gives no rows, a text shorter than ``width`` stays whole.
    """
    spark = docs.sparkSession
    least = np.iinfo(np.int64).min
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(least))).alias("doc"), "text")
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("rows")).first()
    n = parts(spark, size["bytes"], target)

    def read(batch):
        return byte_sequences(raw(batch, "text"), width)

    def sample(batch):
        seq = read(batch)
        at = np.unique(seq.anchor)
        yield emit(pa.schema([("lead", pa.int64())]), lead=seq.core(at)[0].view(np.int64) if len(at) else [])

    some = docs.sample(min(1.0, SAMPLE / max(size["rows"], 1)), seed=1).mapInArrow(per_batch(sample), "lead long").toPandas()
    leads = np.sort(some["lead"].to_numpy(np.int64).view(np.uint64))
    cuts = np.unique(leads[np.linspace(0, len(leads), n, endpoint=False, dtype=np.int64)[1:]]) if len(leads) else leads
    found = repeats(docs, read, width, GRAM - 1, 2, n, lambda rows: np.searchsorted(cuts, rows["core0"], side="right"), True)
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                     ("kept_sha256", pa.string()), ("kept", pa.binary())])

    def cut(batch):
        texts, made = raw(batch, "text"), []
        for text, ranges in zip(texts, batch.column("ranges").to_pylist()):
            if not ranges:
                made.append((0, 0, text))
                continue
            gone = covered(ranges, width, len(text))
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
            made.append((int(gone.sum()), spans, np.frombuffer(text, np.uint8)[~gone].tobytes()))
        doc = [None if d == least else d for d in batch.column("doc").to_pylist()]
        yield emit(out, doc_id=doc, n_bytes=[len(t) for t in texts], n_removed=[m[0] for m in made], n_spans=[m[1] for m in made],
                   kept_sha256=[hashlib.sha256(m[2]).hexdigest() for m in made], kept=[m[2] for m in made])

    return found.select("doc", "text", "ranges").mapInArrow(
        per_batch(cut), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
