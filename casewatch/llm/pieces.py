"""SentencePiece encoding and decoding by a streaming Viterbi search.

The best segmentation maximises the summed piece scores. Open nodes lie within one maximum
piece length of the reading position. Their backpointer paths are followed until they meet; the
pieces before that boundary are committed and forgotten, so the state stays a short window. (Only
text on which two paths never meet, such as one letter thousands of times, keeps its pointers.)
Some boundaries are certain from the vocabulary alone: no piece runs across a meta space that
follows another character, nor across a character that occurs in no longer piece. A text is cut
there first, and the pieces between two such boundaries are remembered for a partition, so a repeated
word costs one lookup.

The model file gives pieces and scores; the search reads any of them as a unigram model, also a
file whose scores are merge ranks. Equal scores: the longer last piece wins. A character without
a piece becomes its UTF-8 bytes where the model has byte pieces, else the unknown id.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewatch.llm.common import Memo, emit, lists, per_batch, pieces_of

SPACE = "▁"
UNKNOWN_PENALTY = 10.0


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceModel:
    """Pieces and scores of a SentencePiece model file, searched by the streaming Viterbi."""

    def __init__(self, pieces: list[tuple[str, float, str]], prefix: bool = True):
        """``pieces``: (text, score, kind) by id; kinds are normal, byte, unknown, control."""
        self.prefix = prefix
        self.table = {p: (i, s) for i, (p, s, kind) in enumerate(pieces) if kind == "normal"}
        self.longest = max(map(len, self.table), default=1)
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == "unknown"), 0)
        self.bytes = {int(p[1:-1], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == "byte"}
        self.unknown_score = min((s for _, s in self.table.values()), default=0.0) - UNKNOWN_PENALTY
        self.tree = self.grown()
        self.surface = np.array([
            p.replace(SPACE, " ").encode() if kind == "normal"
            else bytes([int(p[1:-1], 16)]) if kind == "byte" else b" \xe2\x81\x87 " if kind == "unknown" else b""
            for p, _, kind in pieces
        ], object)
        joins_space = any(SPACE in p.lstrip(SPACE) for p in self.table)
        joins_line = any("\n" in p and len(p) > 1 for p in self.table)
        line = "" if joins_line else "\n"
        self.certain = re.compile(
            r"(?s).+" if joins_space else f"{SPACE}+[^{SPACE}{line}]*|[^{SPACE}{line}]+" + (f"|{line}" if line else "")
        )
        self.memo = Memo(lambda span: array("I", self.whole(span)).tobytes())

    @classmethod
    def load(cls, path: str) -> PieceModel:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        def kind(i):
            if sp.is_byte(i):
                return "byte"
            if sp.is_unknown(i):
                return "unknown"
            return "control" if sp.is_control(i) or sp.is_unused(i) else "normal"
        return cls([(sp.id_to_piece(i), sp.get_score(i), kind(i)) for i in range(sp.get_piece_size())])

    def grown(self) -> dict:
        """The pieces letter by letter: letter -> (score, the tree behind it); no piece ends at a score of minus infinity."""
        scores, inner, leaf = {}, {}, {}
        for piece, (_, score) in self.table.items():
            for n in range(1, len(piece)):
                scores.setdefault(piece[:n], self.unknown_score if n == 1 else -np.inf)
            scores[piece] = score
        scores.pop("", None)
        for piece in sorted(scores, key=len, reverse=True):  # what lies behind a letter is there before it
            inner.setdefault(piece[:-1], {})[piece[-1]] = scores[piece], inner.get(piece, leaf)
        return inner.get("", leaf)

    def reach(self, text: str, score: list[float], back: list[int], at: int, end: int) -> None:
        """The best scores and last pieces' starts of all places that a piece from ``at`` up to ``end`` leads to."""
        tree, longest, unknown = self.tree, self.longest, self.unknown_score
        for at in range(at, end):
            here, stop, node = score[at], at, tree
            for letter in text[at : at + longest]:
                found = node.get(letter)
                if found is None:
                    if stop == at and here + unknown > score[at + 1]:
                        score[at + 1], back[at + 1] = here + unknown, at
                    break
                stop += 1
                value, node = found
                value += here
                if value > score[stop]:  # the earlier start, so the longer piece, keeps ties
                    score[stop], back[stop] = value, at

    def search(self, blocks: Iterable[str]) -> Iterator[int]:
        """Ids of the best segmentation of the joined blocks, committed while they are read."""
        longest = self.longest
        text, at, score, back = "", 0, [0.0], [0]  # all of them from the last committed boundary on
        blocks = iter(blocks)
        last, look = False, 8 * longest
        while not last:
            block = next(blocks, None)
            last = block is None
            text += block or ""
            end = len(text) if last else len(text) - longest
            size = len(text) + 1
            score += [-np.inf] * (size - len(score))
            back += [0] * (size - len(back))
            while at < end:
                stop = min(end, max(look, at + 1))
                self.reach(text, score, back, at, stop)
                at = stop
                if at >= look:
                    paths = {i for i in range(at, min(at + longest, size)) if score[i] > -np.inf}
                    while len(paths) > 1:  # step the path that reaches furthest back, until all meet
                        top = max(paths)
                        paths.remove(top)
                        paths.add(back[top])
                    met = paths.pop()
                    look = 8 * longest if met else 2 * at  # paths that do not meet are followed more rarely
                    if met:
                        yield from self.trace(text, back, met)
                        kept = score[met]
                        text, score, back = text[met:], [x - kept for x in score[met:]], [max(x - met, 0) for x in back[met:]]
                        at, end, size = at - met, end - met, size - met
        yield from self.trace(text, back, len(text))

    def whole(self, text: str) -> Iterable[int]:
        """Ids of one text; one shorter than the window has no boundary to commit on the way."""
        if len(text) >= 8 * self.longest:
            return self.search((text,))
        score, back = [0.0] + [-np.inf] * len(text), [0] * (len(text) + 1)
        self.reach(text, score, back, 0, len(text))
        return self.trace(text, back, len(text))

    def trace(self, text: str, back: list[int], to: int) -> list[int]:
        cuts = [to]
        while cuts[-1]:
            cuts.append(back[cuts[-1]])
        cuts.reverse()
        return [i for a, b in zip(cuts, cuts[1:]) for i in self.ids(text[a:b])]

    def ids(self, text: str) -> list[int]:
        found = self.table.get(text)
        if found:
            return [found[0]]
        return [self.bytes[b] for b in text.encode()] if self.bytes else [self.unknown]

    def encode(self, text: str) -> np.ndarray:
        """All ids of a text; an empty text has none."""
        if not text:
            return np.empty(0, np.uint32)
        marked = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        return np.frombuffer(b"".join(map(self.memo.__getitem__, self.certain.findall(marked))), np.uint32)

    def decode(self, ids: Iterable[int]) -> bytes:
        """The text's bytes. Control ids vanish; the space put before the text is taken off."""
        out = b"".join(self.surface[np.asarray(ids, np.int64)].tolist())
        return out[1:] if self.prefix and out[:1] == b" " else out


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    return PieceModel.load(path)


def encode(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``text`` and ``ids`` (array<int>) of every row, rows with a null id included.

    A null text counts as empty and has no ids. Repeated rows stay as they are. Other columns are
    left out, whatever their names. No shuffle: a lost task is simply run again.
    """
    path = path or default_model()
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = pa.schema([("doc_id", _arrow_type(source)), ("text", pa.string()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        use = model(path)
        try:
            for batch in pieces_of(batches):
                found = [use.encode(t) for t in batch.column("text").to_pylist()]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in found])))
                ids = np.concatenate(found).astype(np.int32) if found else np.empty(0, np.int32)
                yield emit(schema, doc_id=batch.column("doc_id"), text=batch.column("text"), ids=lists(offsets, ids))
        finally:
            use.memo.forget()

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, text string, ids array<int>")


def decode(codes: DataFrame, path: str | None = None) -> DataFrame:
    """The rows of ``encode`` with ``decoded``, the text made of the ids.

    Bytes that are no UTF-8 (byte ids out of order) become U+FFFD. Null ids decode to an empty text.
    """
    path = path or default_model()
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(codes.schema).append(pa.field("decoded", pa.string()))

    def run(batch):
        use = model(path)
        texts = [
            use.decode(x.values.to_numpy(zero_copy_only=False) if x.is_valid else ()).decode("utf-8", "replace")
            for x in batch.column("ids")
        ]
        yield emit(schema, decoded=texts, **{n: batch.column(n) for n in batch.schema.names})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in codes.schema)
    return codes.mapInArrow(per_batch(run), f"{fields}, decoded string")


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encodes and decodes every text: ids' count and hash, the decoded text's hash, and whether it is the text."""
    return decode(encode(docs, path), path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"),
        F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.col("text")).alias("restored"),
    )


def _arrow_type(df: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema["doc_id"].dataType)
