"""Language-model scores by a hidden Markov model.

Texts are read once into chunks: the documents of a map task as numbers into the chunk's own word
list. What moves in a round is a number for each chunk and each of its frequent words, so chunks are as large as a task's memory
allows: map tasks read as many input partitions as fill one, while there are tasks enough for all cores. Everything that grows with the vocabulary stays in distributed tables; a chunk gets the
sums of its own words only, from a file of the shared folder written for it, so no vocabulary
is broadcast or collected and no text is shuffled. Words are dealt into buckets by hash; a chunk sends
a bucket one row, with the sums of its frequent words as single-precision numbers, and gets one
back. A round deletes what the round before it wrote.

Training is Baum-Welch: each task adds up the expected transitions and emissions of its chunk,
Spark groups them by bucket, and the sums over all chunks are the next parameters. A word that training saw at
least ``frequent`` times has emissions of its own; rarer ones share those of their count's power
of two, divided among them by their counts, and unseen words share the one unseen type of the
unigram model. As in that model every type has one count more, divided among the states as their
tokens are, and emissions are backed off a little to the unigram probabilities, so every text has a
proper probability. Scoring runs the scaled forward recursion over each whole text.
"""

from __future__ import annotations

import random
import zlib
from array import array
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewatch.llm.common import Shelf, arrow_uri, emit, parts, pieces_of, raw, stored

STATES = 4
ROUNDS = 4
FREQUENT = 50
BACK_OFF = 5.0  # pseudo-count of the unigram distribution in every state
SEGMENT = 512  # tokens of a training sequence; a longer text is several
CHUNK = 48 << 20  # bytes of text in a chunk; up to half more where input partitions do not fit
TOKENS = 4 << 20  # tokens of the documents that are scored at a time
BUCKET = 64 << 20  # bytes of a bucket of words in a round, at about PAIR for each chunk and word
PAIR = 32
END = b"\n"  # no word holds white space

CHUNKS = pa.schema([(n, t) for n, t in (
    ("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int32())),
    ("ids", pa.binary()), ("words", pa.binary()), ("n_words", pa.int64()))])
CHUNKS_SQL = "chunk long, doc_ids array<long>, held array<boolean>, lengths array<int>, ids binary, words binary, n_words long"


def held_out(doc_id) -> bool:
    """crc32 of the id as text, modulo 7, is 2; a null id is the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def chunks(docs: DataFrame) -> DataFrame:
    """The documents as word numbers, a chunk to a row. Input partitions are read in one task up to the size of a chunk."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"]
    docs = docs.coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, -(-int(size or 0) // CHUNK)))

    class Numbers(dict):
        def __missing__(self, word):
            value = self[word] = len(self)
            return value

    def run(batches):
        numbers, docs_, lengths, ids, size = Numbers(), [], [], array("I"), 0

        def flush():
            words = np.fromiter(map(xxhash.xxh3_64_intdigest, numbers), np.uint64, len(numbers))
            numbers.clear()  # the list is long: not beside the copies of the ids
            return emit(CHUNKS, chunk=[random.SystemRandom().getrandbits(63)], doc_ids=[docs_], held=[[held_out(d) for d in docs_]], lengths=[lengths],
                        ids=[squeezed(np.frombuffer(ids, np.uint32).astype("<u4", copy=False))], words=[words.tobytes()], n_words=[len(words)])

        for batch in pieces_of(batches, 128):
            texts = raw(batch, "text")
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts):
                words = text.lower().split()
                words.append(END)
                ids.extend(map(numbers.__getitem__, words))
                lengths.append(len(words))
                docs_.append(doc)
                size += len(text)
            if size > CHUNK * 3 // 2:
                yield flush()
                docs_, lengths, ids, size = [], [], array("I"), 0
        if docs_:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, CHUNKS_SQL)


class Chunk:
    """A row of ``chunks``."""

    def __init__(self, row):
        self.name, self.doc_ids = row["chunk"], row["doc_ids"]
        self.held, self.lengths = np.array(row["held"], bool), np.array(row["lengths"], np.int64)
        self.ids, self.words = expanded(row["ids"], "<u4"), np.frombuffer(row["words"], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))[:-1]

    def runs(self, size: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """The documents in runs of about ``size`` tokens: which they are, their ids, starts among these, and lengths."""
        ends = np.flatnonzero(np.diff(np.cumsum(self.lengths) // size)) + 1
        for a, b in zip([0, *ends], [*ends, len(self.lengths)]):
            starts, lengths = self.starts[a:b], self.lengths[a:b]
            yield slice(a, b), self.ids[starts[0] : starts[-1] + lengths[-1]], starts - starts[0], lengths


def _each(batches):
    for batch in pieces_of(batches, 1):
        yield Chunk({n: batch.column(n)[0].as_buffer() if n in ("ids", "words") else batch.column(n)[0].as_py() for n in batch.schema.names})


def squeezed(a: np.ndarray) -> bytes:
    """The bytes of an array, those of like weight together, compressed."""
    if not a.size:
        return b""
    flat = np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(a.size, a.itemsize).T)
    return flat.nbytes.to_bytes(8, "little") + pa.compress(pa.py_buffer(flat), "zstd", asbytes=True)


def expanded(b: bytes | pa.Buffer, kind) -> np.ndarray:
    kind = np.dtype(kind)
    if not len(b):
        return np.empty(0, kind)
    b = memoryview(b)
    flat = pa.decompress(b[8:], int.from_bytes(b[:8], "little"), "zstd")
    return np.ascontiguousarray(np.frombuffer(flat, np.uint8).reshape(kind.itemsize, -1).T).view(kind)[:, 0]


def noise(words: np.ndarray, s: int) -> np.ndarray:
    """Between 0.1 and 1.1 by ``xxhash64(word, s)`` as Spark computes it for a long and an int."""
    p1, p2, p3, p4, p5 = map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))

    def mix(h):
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return h ^ (h >> np.uint64(32))

    with np.errstate(over="ignore"):
        h = mix(turn((np.uint64(42) + p5 + np.uint64(8)) ^ (turn(words.view(np.uint64) * p2, 31) * p1), 27) * p1 + p4)
        h = mix(turn((h + p5 + np.uint64(4)) ^ (np.uint64(s) * p1), 23) * p2 + p3)
    return 0.1 + h.view(np.int64) % 1_000_003 / 1_000_003


def buckets_of(words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the words by bucket and word, and where each of the ``n`` buckets begins in it."""
    order = np.argsort(words.view(np.uint64), kind="stable")
    bucket = (words.view(np.uint64)[order] >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)
    return order, np.searchsorted(bucket, np.arange(n + 1))


FEW = -1  # the "chunk" of a row of sums over all words or chunks


def counts(held: DataFrame, buckets: int, frequent: int, states: int) -> DataFrame:
    """chunk, bucket, c (count in all training documents of each of the chunk's words of the bucket), place (of the
    frequent ones among those of the bucket), few.

    A chunk meets the others in one row for each bucket of words. Rows of chunk ``FEW`` have sums over the
    bucket's words: tokens, types, types and count mass of each rare class, first emission sums.
    """
    cells = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("words", pa.binary()), ("c", pa.binary())])
    out = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("c", pa.binary()), ("place", pa.binary()), ("few", pa.list_(pa.float64()))])
    classes = classes_of(frequent)

    def run(batches):
        for x in _each(batches):
            c = np.zeros(len(x.words), "<u4")
            for run, ids, _, lengths in x.runs(TOKENS):
                c += np.bincount(ids[np.repeat(~x.held[run], lengths)], minlength=len(c)).astype("<u4")
            order, at = buckets_of(x.words, buckets)
            own = [(b, order[at[b] : at[b + 1]]) for b in range(buckets) if at[b] < at[b + 1]]
            yield emit(cells, bucket=[b for b, _ in own], chunk=[x.name] * len(own),
                       words=[x.words[some].tobytes() for _, some in own], c=[squeezed(c[some]) for _, some in own])

    def add(table):
        chunk, bucket = table.column("chunk").to_pylist(), table.column("bucket")[0].as_py()
        words = [np.frombuffer(w, "<u8") for w in table.column("words").to_pylist()]  # in the order of the chunks
        distinct, of = np.unique(np.concatenate(words), return_inverse=True)
        c = np.concatenate([expanded(x, "<u4") for x in table.column("c").to_pylist()])
        total = np.bincount(of, c, len(distinct)).astype("<i8")  # sums below 2 ** 53 are exact
        symbol = symbol_of(total, frequent)
        place = np.where(symbol < 0, np.cumsum(symbol < 0) - 1, -1)
        mass = np.bincount(symbol[symbol > 0], total[symbol > 0] + 1, classes)
        often = [float((total * noise(distinct, s))[symbol < 0].sum()) for s in range(states)]
        types = np.bincount(symbol[symbol > 0], minlength=classes)
        few = [float(total.sum()), float((total > 0).sum()), *types.astype(float), *mass.astype(float), *often]
        of = np.split(of, np.cumsum([len(w) for w in words])[:-1])
        return pa.Table.from_batches([emit(
            out, chunk=[*chunk, FEW], bucket=[bucket] * (len(chunk) + 1), c=[*(squeezed(total[i]) for i in of), None],
            place=[*(squeezed(gaps(place[i][place[i] >= 0])) for i in of), None], few=[None] * len(chunk) + [few])])

    rows = held.mapInArrow(run, "bucket int, chunk long, words binary, c binary")
    return rows.groupBy("bucket").applyInArrow(add, "chunk long, bucket int, c binary, place binary, few array<double>")


def gaps(places: np.ndarray) -> np.ndarray:
    """Ascending numbers as steps from one to the next."""
    return np.diff(places, prepend=0).astype("<u4")


def summed(rows: DataFrame, shelf: Shelf, name: str) -> tuple[str, DataFrame, np.ndarray]:
    """Write rows by chunk, each chunk's below a folder of its own: where Arrow finds them, the table, and the sum of its few."""
    kept = shelf.put(rows.repartition("chunk"), name, "chunk")
    few = kept.where(F.col("chunk") == FEW).select(F.posexplode("few").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"))
    return arrow_uri(rows.sparkSession, shelf.path(kept)), kept, np.array([r["x"] for r in few.orderBy("at").collect()])


def fetched(uri: str, chunk: int, n: int) -> list[dict]:
    """The ``n`` rows filed for a chunk, by bucket; an error if they are not all there."""
    from pyarrow.fs import FileSelector, FileSystem
    from pyarrow.parquet import read_table

    if not n:
        return []
    fs, root = FileSystem.from_uri(uri)
    files = [f.path for f in fs.get_file_info(FileSelector(f"{root}/chunk={chunk}")) if f.path.endswith(".parquet")]
    got = pa.concat_tables([read_table(f, filesystem=fs, partitioning=None) for f in files])
    if got.num_rows != n:
        raise OSError(f"{uri}/chunk={chunk} holds {got.num_rows} of {n} rows")
    return got.sort_by("bucket").to_pylist()


def classes_of(frequent: int) -> int:
    return int(log2(frequent)) + 2 if frequent > 1 else 1


def symbol_of(c: np.ndarray, frequent: int) -> np.ndarray:
    """The class of a rare word by its count: 0 unseen, else 1 + the power of two; -1 for a frequent one."""
    out = np.where(c > 0, np.log2(np.maximum(c, 1)).astype(np.int64) + 1, 0)
    return np.where(c >= frequent, -1, out)


def by_time(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token places ordered by time and then sequence (longest first), with the offset and size of each time."""
    order = np.argsort(-lengths, kind="stable")
    lengths, starts = lengths[order], starts[order]
    longest = int(lengths[0]) if len(lengths) else 0
    alive = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(longest), side="right")
    offset = np.concatenate(([0], np.cumsum(alive)))
    time = np.repeat(np.arange(longest), alive)
    rank = np.arange(offset[-1]) - offset[time]
    return starts[rank] + time, offset, order


def forward(ids, starts, lengths, emission, start, moves) -> np.ndarray:
    """Natural log likelihood of each sequence; nothing is kept from step to step but the current states."""
    place, offset, order = by_time(starts, lengths)
    symbols = ids[place]
    out, state = np.zeros(len(lengths)), None
    for t in range(len(offset) - 1):
        seen = emission[symbols[offset[t] : offset[t + 1]]]
        state = start * seen if t == 0 else (state[: len(seen)] @ moves) * seen
        scale = state.sum(1)
        state /= scale[:, None]
        out[: len(seen)] += np.log(scale)
    result = np.empty_like(out)
    result[order] = out
    return result


def expected(ids, starts, lengths, emission, start, moves, n_symbols):
    """Expected emissions (symbol x state), transitions and first states over the sequences."""
    states = len(start)
    emitted, moved, first = np.zeros((n_symbols, states)), np.zeros((states, states)), np.zeros(states)
    longest_first = np.argsort(-lengths, kind="stable")
    group = np.cumsum(lengths[longest_first]) // 200_000
    for g in np.unique(group):
        mine = longest_first[group == g]
        place, offset, _ = by_time(starts[mine], lengths[mine])
        symbols = ids[place]
        seen = emission[symbols]
        a, scale = np.empty_like(seen), np.empty(len(seen))
        for t in range(len(offset) - 1):
            now = slice(offset[t], offset[t + 1])
            x = start * seen[now] if t == 0 else (a[offset[t - 1] : offset[t - 1] + offset[t + 1] - offset[t]] @ moves) * seen[now]
            scale[now] = x.sum(1)
            a[now] = x / scale[now, None]
        b = np.ones_like(seen)
        ahead = seen / scale[:, None]
        for t in range(len(offset) - 3, -1, -1):
            n = offset[t + 2] - offset[t + 1]
            nxt = slice(offset[t + 1], offset[t + 2])
            b[offset[t] : offset[t] + n] = (ahead[nxt] * b[nxt]) @ moves.T
        gamma = a * b
        for s in range(states):
            emitted[:, s] += np.bincount(symbols, gamma[:, s], n_symbols)
        first += gamma[: offset[1]].sum(0)
        later = np.arange(offset[1], len(seen))
        time = np.repeat(np.arange(1, len(offset) - 1), np.diff(offset)[1:])
        before = offset[time - 1] + later - offset[time]
        moved += moves * (a[before].T @ (ahead[later] * b[later]))
    return emitted, moved, first


def segments(starts: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    n = -(-lengths // size)
    which = np.repeat(np.arange(len(lengths)), n)
    step = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * size
    return starts[which] + step, np.minimum(lengths[which] - step, size)


def score(
    docs: DataFrame, states: int = STATES, rounds: int = ROUNDS, frequent: int = FREQUENT, back_off: float = BACK_OFF,
    segment: int = SEGMENT,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    ``base_score`` is the add-one unigram log10 probability, ``score`` the model's. A null text is
    empty: its end token only. Without training documents every token is unseen. Repeated rows count
    as often as they stand; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    classes = classes_of(frequent)
    held, shelf = stored(chunks(docs), "chunks"), Shelf(spark, "rounds")
    size = held.agg(F.sum("n_words").alias("pairs")).first()["pairs"]
    buckets = parts(spark, (size or 0) * PAIR, BUCKET)
    filed_counts, _, few = summed(counts(held, buckets, frequent, states), Shelf(spark, "counts"), "by-chunk")
    few = few if len(few) else np.zeros(2 + 2 * classes + states)
    n_train, types = int(few[0]), int(few[1])
    mass = float(n_train + types + 1)
    types_of, shared = few[2 : 2 + classes].copy(), few[2 + classes : 2 + 2 * classes].copy()  # types and count mass of each class
    types_of[0] = shared[0] = 1.0

    often = few[2 + 2 * classes :]  # emission sums of all frequent words
    class_sums = np.random.default_rng(11).uniform(0.1, 1.1, (classes, states)) * (shared - types_of)[:, None]
    start = np.full(states, 1 / states)
    moves = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)  # states begin as lasting ones
    cells = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("place", pa.binary()), ("v", pa.binary()), ("few", pa.list_(pa.float64()))])
    out = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("v", pa.binary()), ("few", pa.list_(pa.float64()))])

    def parameters(often, class_sums):
        """What normalises the emissions of each state: its share of the types' one count more, and its mass; class emissions."""
        whole = often + class_sums.sum(0)
        share = whole / whole.sum() if whole.sum() else np.full(states, 1 / states)
        all_ = whole + share * (types + 1) + back_off
        return share, all_, (class_sums + types_of[:, None] * share + back_off * (shared / mass)[:, None]) / all_

    def emissions(x: Chunk, path: str | None, share: np.ndarray, all_: np.ndarray, by_class: np.ndarray):
        """For each of the chunk's words: count, symbol (frequent words after the classes), emission, class share; the
        frequent words in the order of their buckets, and by bucket their number and their places there."""
        order, at = buckets_of(x.words, buckets)
        rows = fetched(filed_counts, x.name, int((np.diff(at) > 0).sum()))
        c = np.zeros(len(x.words), np.int64)
        c[order] = np.concatenate([expanded(r["c"], "<i8") for r in rows])
        symbol = symbol_of(c, frequent)
        table = np.zeros((len(c), states))
        table[symbol >= 0] = by_class[symbol[symbol >= 0]]
        own = order[symbol[order] < 0]
        places = [(r["bucket"], r["place"]) for r in rows if r["place"]]
        if path is None:
            sums = np.stack([c[own] * noise(x.words[own], s) for s in range(states)], 1)
        else:
            sums = np.concatenate([np.empty((0, states)), *(expanded(r["v"], "<f4").reshape(-1, states) for r in fetched(path, x.name, len(places)))])
        table[own] = (sums + share + back_off * ((c[own] + 1) / mass)[:, None]) / all_
        class_share = np.where(symbol >= 0, (c + 1) / np.maximum(shared[np.maximum(symbol, 0)], 1), 1.0)
        return c, symbol, table, class_share, own, places

    def added(table):
        """The sums of a bucket's words over all chunks, back to each chunk that has them."""
        bucket, cell = table.column("bucket")[0].as_py(), table.column("chunk").to_numpy() != FEW
        few = [np.array(x) for x in table.column("few").to_pylist() if x is not None]
        table = table.filter(pa.array(cell))
        places = [np.cumsum(expanded(x, "<u4"), dtype=np.int64) for x in table.column("place").to_pylist()]
        sums = np.zeros((max((int(x[-1]) for x in places), default=-1) + 1, states))
        for x, v in zip(places, table.column("v").to_pylist()):
            sums[x] += expanded(v, "<f4").reshape(-1, states)
        sums = sums.astype("<f4")
        chunk = [*table.column("chunk").to_pylist(), *([FEW] if few else [])]
        return pa.Table.from_batches([emit(
            out, chunk=chunk, bucket=[bucket] * len(chunk), v=[*(squeezed(sums[x].ravel()) for x in places), *([None] if few else [])],
            few=[*[None] * len(places), *([sum(few)] if few else [])])])

    path = before = None  # the sums of the round before
    for turn in range(rounds):
        share, all_, by_class = parameters(often, class_sums)

        def count(batches, path=path, share=share, all_=all_, by_class=by_class, start=start, moves=moves):
            for x in _each(batches):
                c, symbol, table, _, own, places = emissions(x, path, share, all_, by_class)
                lo, n = segments(x.starts[~x.held], x.lengths[~x.held], segment)
                emitted, moved, first = expected(x.ids, lo, n, table, start, moves, len(c)) if len(lo) else (
                    np.zeros((len(c), states)), np.zeros((states, states)), np.zeros(states))
                by = np.zeros((classes, states))
                np.add.at(by, symbol[symbol >= 0], emitted[symbol >= 0])
                few = np.concatenate([by.ravel(), moved.ravel(), first, emitted[own].sum(0)])
                ends = np.cumsum([len(expanded(p, "<u4")) for _, p in places])[:-1] if places else []
                v = [squeezed(e.astype("<f4").ravel()) for e in np.split(emitted[own], ends)] if places else []
                yield emit(cells, bucket=[*(b for b, _ in places), x.name % buckets], chunk=[*[x.name] * len(places), FEW],
                           place=[*(p for _, p in places), None], v=[*v, None], few=[*[None] * len(places), few])

        rows = held.mapInArrow(count, "bucket int, chunk long, place binary, v binary, few array<double>")
        rows = rows.groupBy("bucket").applyInArrow(added, "chunk long, bucket int, v binary, few array<double>")
        own_shelf = Shelf(spark, "emissions") if turn == rounds - 1 else shelf  # the last are still to be read
        path, filed_rows, few = summed(rows, own_shelf, "emissions")
        if before is not None:
            shelf.drop(before)
        before = filed_rows
        few = few if len(few) else np.zeros(classes * states + states * states + 2 * states)
        by, moved, first, often = np.split(few, np.cumsum([classes * states, states * states, states]))
        class_sums = by.reshape(classes, states)
        moves = moved.reshape(states, states) + 1
        moves /= moves.sum(1, keepdims=True)
        start = first + 1
        start /= start.sum()

    share, all_, by_class = parameters(often, class_sums)
    shelf.clear()
    made = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                      ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def final(batches):
        for x in _each(batches):
            c, _, table, class_share, *_ = emissions(x, path, share, all_, by_class)
            base, rest, known = np.log10((c + 1) / mass), np.log10(class_share), (c > 0).astype(np.int64)
            for run, ids, starts, lengths in x.runs(TOKENS):
                likely = forward(ids, starts, lengths, table, start, moves) / np.log(10)
                add = lambda v: np.add.reduceat(v[ids], starts)  # noqa: E731  each text has its end token
                yield emit(made, doc_id=x.doc_ids[run], held_out=x.held[run], n_tokens=lengths, n_known=add(known),
                           train_tokens=np.full(len(lengths), n_train), base_score=add(base), score=likely + add(rest))

    return spark.createDataFrame([], "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                                 "base_score double, score double") if held.isEmpty() else held.mapInArrow(
        final, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
