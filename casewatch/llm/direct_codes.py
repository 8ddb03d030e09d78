"""Token ids in files of directly addressable codes.

An id is cut into 8-bit chunks, low chunk first. Level l holds the l-th chunk of every id that has
one; a bitmap beside each level says which ids go on in the next, and a rank directory (ones before
each block of 512 bits) finds the place there. Any id, or any run of ids, is read from a few byte
ranges; nothing around it is decoded.

Layout of a file, little-endian: ``DACF``, uint32 levels, uint64 ids, uint64 documents; per level
uint64 codes, uint64 place of codes, uint64 place of bitmap, uint64 place of ranks; int64 document
ids; uint8 null flags of those; uint64 starts (documents + 1); then the levels.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casewatch.llm.common import emit, parts, per_batch, pieces_of
from casewatch.session import scratch

MAGIC, BLOCK = b"DACF", 512


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# --- the codes ---------------------------------------------------------------------------

def pack(doc_ids: list, ids: list[np.ndarray]) -> bytes:
    """One file's bytes for documents in the given order."""
    values = np.concatenate(ids).astype(np.uint32) if ids else np.empty(0, np.uint32)
    total, levels = len(values), []
    while True:
        more = values > 0xFF
        bits = np.packbits(more, bitorder="little")
        ones = np.concatenate(([0], np.cumsum(more, dtype=np.uint64)[BLOCK - 1 :: BLOCK]))
        levels.append(((values & 0xFF).astype(np.uint8), bits, ones.astype("<u8")))
        if not more.any():
            break
        values = values[more] >> 8
    starts = np.concatenate(([0], np.cumsum([len(x) for x in ids], dtype=np.uint64))).astype("<u8")
    head = 24 + 32 * len(levels)
    at = head + 9 * len(ids) + starts.nbytes
    table, body = [], []
    for codes, bits, ones in levels:
        table += [len(codes), at, at + codes.nbytes, at + codes.nbytes + bits.nbytes]
        at += codes.nbytes + bits.nbytes + ones.nbytes
        body += [codes.tobytes(), bits.tobytes(), ones.tobytes()]
    return b"".join([
        MAGIC, np.array([len(levels)], "<u4").tobytes(), np.array([total, len(ids)], "<u8").tobytes(),
        np.array(table, "<u8").tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.array([d is None for d in doc_ids], np.uint8).tobytes(), starts.tobytes(), *body,
    ])


class Codes:
    """Random access to the ids of a file; ``read(place, size)`` returns bytes of it."""

    def __init__(self, read):
        self.read = read
        head = read(0, 24)
        if head[:4] != MAGIC:
            raise ValueError("no file of directly addressable codes")
        n_levels = int(np.frombuffer(head, "<u4", 1, 4)[0])
        self.n_ids, self.n_docs = (int(x) for x in np.frombuffer(head, "<u8", 2, 8))
        self.levels = np.frombuffer(read(24, 32 * n_levels), "<u8").reshape(-1, 4).astype(int)
        self.docs_at = 24 + 32 * n_levels

    def __len__(self) -> int:
        return self.n_ids

    def __getitem__(self, i: int) -> int:
        return int(self.run(i, i + 1)[0])

    def run(self, first: int, end: int) -> np.ndarray:
        """The ids from ``first`` up to ``end``."""
        out = np.zeros(end - first, np.uint32)
        where, a, b = np.arange(end - first), first, end
        for depth, (_, codes, bitmap, ranks) in enumerate(self.levels):
            if a == b:
                break
            out[where] |= np.frombuffer(self.read(codes + a, b - a), np.uint8).astype(np.uint32) << np.uint32(8 * depth)
            block = a // BLOCK
            start = block * BLOCK
            bits = np.unpackbits(
                np.frombuffer(self.read(bitmap + start // 8, (b + 7) // 8 - start // 8), np.uint8), bitorder="little"
            )[: b - start]
            before = int(np.frombuffer(self.read(ranks + 8 * block, 8), "<u8")[0]) + int(bits[: a - start].sum())
            more = bits[a - start:].astype(bool)
            where = where[more]
            a, b = before, before + len(where)
        return out

    def documents(self) -> tuple[list, np.ndarray]:
        """Document ids (null as None) and starts, with the end of the last."""
        n = self.n_docs
        got = self.read(self.docs_at, 17 * n + 8)
        ids, null = np.frombuffer(got, "<i8", n), np.frombuffer(got, np.uint8, n, 8 * n)
        return [None if x else int(d) for d, x in zip(ids, null)], np.frombuffer(got, "<u8", n + 1, 9 * n).astype(int)


# --- encoding ----------------------------------------------------------------------------

LETTERS, MARKS = "[A-Za-zÀ-ÖØ-öø-ÿ]", r"[!-/:-@\[-`{-~]"  # lower-cased the same way everywhere; ASCII punctuation
PLAIN = f"^(?P<core>{LETTERS}+)(?P<tail>{MARKS}*)$"
CUTS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def cuts_marks(coder) -> bool:
    """Whether the vocabulary lower-cases and codes a run of letters apart from the punctuation behind it."""
    rules = json.loads(coder.to_str())
    flat = lambda x, key: [y for part in x.get(key, [x]) for y in ([part] if part is x else flat(part, key))] if x else []
    norm, cuts = flat(rules["normalizer"], "normalizers"), flat(rules["pre_tokenizer"], "pretokenizers")
    return (
        [x["type"] for x in norm] == ["NFC", "Replace", "Lowercase"] and norm[1]["pattern"] == {"Regex": "\\s+"}
        and [x["type"] for x in cuts] == ["Split", "ByteLevel"] and cuts[0]["pattern"] == {"Regex": CUTS} and cuts[0]["invert"]
        and cuts[0]["behavior"] == "Removed" and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"]
        and not rules["post_processor"]
        and not any(re.fullmatch(f"{LETTERS}*{MARKS}*", x["content"]) for x in rules["added_tokens"])
    )


class WordCoder:
    """Ids of whole texts by a vocabulary that never joins across white space.

    Texts are cut at ASCII white space only, which the vocabulary drops; anything else stays inside the word
    that the library gets. The words of a batch are numbered first and only its distinct words looked up.
    Where the vocabulary itself cuts there, a word of plain letters is coded apart from the punctuation behind it, in
    lower case. Only what is not remembered goes to the library, many words to a call. Two
    generations of at most about ``most`` words are remembered.
    """

    def __init__(self, path: str, most: int = 300_000, together: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.coder, self.most, self.together = Tokenizer.from_file(path), most, together
        self.cuts_marks = cuts_marks(self.coder)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def code(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words, 4 bytes each."""
        coded = list(map(self.known.get, words))
        missing = [i for i, ids in enumerate(coded) if ids is None]
        if self.older and missing:
            for i, ids in zip(missing, map(self.older.get, map(words.__getitem__, missing))):
                coded[i] = ids
            self.known.update((words[i], coded[i]) for i in missing if coded[i] is not None)
            missing = [i for i in missing if coded[i] is None]
        for at in range(0, len(missing), 64 * self.together):
            some = missing[at : at + 64 * self.together]
            groups = [[words[i] for i in some[lo : lo + self.together]] for lo in range(0, len(some), self.together)]
            found = self.coder.encode_batch(groups, is_pretokenized=True, add_special_tokens=False)
            ids = [e.ids for e in found]
            flat = np.fromiter(chain.from_iterable(ids), "<u4", sum(map(len, ids))).tobytes()
            of = np.fromiter(chain.from_iterable(e.word_ids for e in found), np.int64, len(flat) // 4)
            of += self.together * np.repeat(np.arange(len(ids)), list(map(len, ids)))
            sizes = np.concatenate(([0], 4 * np.cumsum(np.bincount(of, minlength=len(some)))))
            for i, (a, b) in zip(some, pairwise(sizes.tolist())):
                coded[i] = self.known[words[i]] = flat[a:b]
        if len(self.known) > self.most:
            self.known, self.older = {}, self.known
        return coded

    def coded(self, words: pa.Array) -> pa.Array:
        """The ids of the words of an array, as a binary array."""
        numbered = words.dictionary_encode()
        return pa.array(self.code(numbered.dictionary.to_pylist()), pa.binary()).take(numbered.indices)

    def column(self, texts: pa.Array | list[bytes], end: bytes = b"") -> pa.Array:
        """The ids of each text, and ``end`` behind them, as a binary column; a null text is empty."""
        if not len(texts):
            return pa.array([], pa.binary())
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_binary())
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        numbered = split.values.dictionary_encode()
        distinct = numbered.dictionary  # also the empty string that stands where a text begins or ends with a blank
        if self.cuts_marks:
            plain = pc.extract_regex(distinct, PLAIN)
            core = pc.coalesce(pc.utf8_lower(pc.struct_field(plain, "core")), distinct)
            tail = pc.fill_null(pc.struct_field(plain, "tail"), "")
            coded = pc.binary_join_element_wise(self.coded(core), self.coded(tail), pa.scalar(b"", pa.binary()))
        else:
            coded = self.coded(distinct)
        ids = coded.take(numbered.indices)
        bounds = np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1, 4 * ids.offset)[split.offsets.to_numpy()] // 4
        flat, last = np.frombuffer(ids.buffers()[2], "<u4", bounds[-1]), np.frombuffer(end, "<u4")
        flat = np.insert(flat, np.repeat(bounds[1:], len(last)), np.tile(last, len(texts)))
        bounds = (4 * (bounds + len(last) * np.arange(len(bounds)))).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(flat.tobytes())])

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        return self.column(texts).to_pylist()


@lru_cache(maxsize=2)
def coder(path: str) -> WordCoder:
    return WordCoder(path)


# --- writing and reading -------------------------------------------------------------------

def _filesystem(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def splitters(docs: DataFrame, n: int) -> list[int]:
    """Ids that cut the documents into ``n`` runs of about equal text; a long text counts for more."""
    weight = F.least(F.lit(4096), 1 + F.coalesce(F.octet_length("text"), F.lit(0)) / 4096).cast("int")
    some = docs.select(F.explode(F.array_repeat("doc_id", weight)).alias("d")).agg(
        F.percentile_approx("d", [i / n for i in range(1, n)] or [0.5], 20 * n).alias("p")
    ).first()["p"]
    return sorted(set(some or []))


def write(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 1, target: int = 16 << 20) -> DataFrame:
    """Encode every text and write the ids, in ascending ``doc_id`` order, as files below ``folder``.

    Returns the manifest (file, bucket, n_docs, n_ids), itself stored below ``folder``. Files of
    failed or doubled task attempts have names of their own and are in no manifest. A null text is
    empty and has the end id only; rows with a null ``doc_id`` come first; equal ids go by their
    tokens; an empty table has no files. Buckets are runs of ``doc_id`` of about ``target`` bytes.
    """
    path, spark = path or default_vocabulary(), docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"]
    n = parts(spark, size, target)
    cuts = np.array(splitters(docs, n), np.int64)
    coded = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("ids", pa.binary())])
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches):
        for batch in pieces_of(batches, 2048):  # more texts at a time have fewer distinct words
            ids = coder(path).column(batch.column("text"), end)
            doc = batch.column("doc_id")
            bucket = np.searchsorted(cuts, doc.fill_null(np.iinfo(np.int64).min).to_numpy(), side="right")
            yield emit(coded, bucket=bucket.astype(np.int32), doc_id=doc, ids=ids)

    made = pa.schema([("file", pa.string()), ("bucket", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def save(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        bucket, doc = table.column("bucket")[0].as_py(), table.column("doc_id").to_pylist()
        ids = [np.frombuffer(x, "<u4") for x in table.column("ids").to_pylist()]
        name = f"{folder.rstrip('/')}/ids-{bucket:06d}-{uuid.uuid4().hex}.dac"
        fs, place = _filesystem(name)
        fs.create_dir(os.path.dirname(place), recursive=True)
        with fs.open_output_stream(place) as out:
            out.write(pack(doc, ids))
        yield emit(made, file=[name], bucket=[bucket], n_docs=[len(doc)], n_ids=[sum(map(len, ids))])

    rows = docs.mapInArrow(encode, "bucket int, doc_id long, ids binary")
    rows = rows.repartitionById(max(n, len(cuts) + 1), "bucket").sortWithinPartitions("doc_id", "ids")
    rows.mapInArrow(save, "file string, bucket int, n_docs long, n_ids long").write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 (of little-endian uint32)."""
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("file", "bucket", before.alias("base"))  # one row per file
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def load(batch):
        for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
            fs, place = _filesystem(name)
            with fs.open_input_file(place) as file:
                codes = Codes(lambda at, size: file.read_at(size, at))
                doc, starts = codes.documents()
                for lo in range(0, len(doc), 2048):
                    some = range(lo, min(lo + 2048, len(doc)))
                    ids = codes.run(starts[lo], starts[some.stop]).astype("<u4")
                    crc = [zlib.crc32(ids[starts[i] - starts[lo] : starts[i + 1] - starts[lo]].tobytes()) for i in some]
                    yield emit(out, doc_id=[doc[i] for i in some], start=[base + int(starts[i]) for i in some],
                               n_tokens=[int(starts[i + 1] - starts[i]) for i in some], ids_crc32=crc)

    return files.repartition(n, "file").mapInArrow(
        per_batch(load), "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def write_and_read(docs: DataFrame, path: str | None = None) -> DataFrame:
    return read(write(docs, scratch(docs.sparkSession, "token-ids"), path))
