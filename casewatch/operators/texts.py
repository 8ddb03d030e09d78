"""Mentions of dictionary terms in text, and hooks for a user's scoring and embedding functions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewatch.operators.dedupe import keep_first
from casewatch.operators.keys import spread_nulls
from casewatch.sources.sinks import read_if_present

def _in_word(ch: str) -> bool:
    return ch.isalnum() or ch == "_"


class TermFinder:
    """Left-to-right, non-overlapping, longest whole-word matches of (term, label) entries in a text.

    Terms are filed under their first run of word characters. A text is read run by run, and only the terms
    filed under the run are tried, the longest first, so the cost of a text does not grow with the number of
    terms. A term that starts with another character is filed under that character.
    """

    def __init__(self, terms: Iterable[tuple[str, str]]):
        labels = {term.lower(): label for term, label in reversed(list(terms)) if term}
        filed: dict[str, list[str]] = {}
        for term in labels:
            filed.setdefault(re.match(r"\w+|\W", term)[0], []).append(term)
        self.filed = {  # the term, its length, whether a word ends with it
            first: [(t, len(t), _in_word(t[-1]), labels[t]) for t in sorted(some, key=len, reverse=True)]
            for first, some in filed.items()
        }
        words = [first for first in filed if _in_word(first[0])]
        others = "".join(re.escape(first) for first in filed if not _in_word(first))
        # few first words are looked for themselves, which skips the rest of the text faster
        run = "(?:" + "|".join(map(re.escape, words)) + r")(?!\w)" if 0 < len(words) <= 64 else r"\w+"
        self.runs = re.compile(run + (f"|[{others}]" if others else "")).finditer

    def find(self, text: str) -> Iterator[tuple[str, str, int, int]]:
        """(text as written, label, start, end) of every match."""
        lowered, at = text.lower(), 0
        if len(lowered) != len(text):
            # rare letters change length when lowered; keep positions of the original
            lowered = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        filed = self.filed
        for run in self.runs(lowered):
            entries = filed.get(run[0])
            start = run.start()
            if entries is None or start < at or (start and _in_word(lowered[start - 1])):
                continue
            for term, n, ends_word, label in entries:
                end = start + n
                if lowered.startswith(term, start) and not (ends_word and end < len(lowered) and _in_word(lowered[end])):
                    yield text[start:end], label, start, end
                    at = end
                    break


def mentions(
    df: DataFrame, terms: Sequence[tuple[str, str]], id_col: str = "review_id",
    text_col: str = "review_text",
) -> DataFrame:
    """All mentions of (term, label) entries: id, text as written, label, start, end (exclusive).

    Whole words, any case, left to right without overlap, longest term first; of two entries
    for a term the first counts. One pass over the text, whatever the number of terms.
    Positions of every match are beyond the built-in functions, hence the Arrow function; it writes
    flat columns, and texts without a match leave nothing behind.
    """
    finder = TermFinder(terms)
    kind = df.select(id_col).schema[0].dataType
    schema = T.StructType([
        T.StructField(id_col, kind), T.StructField("entity_text", T.StringType()), T.StructField("entity_label", T.StringType()),
        T.StructField("start_char", T.IntegerType()), T.StructField("end_char", T.IntegerType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32()]
        for batch in batches:
            rows, found = [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                if text:
                    hits = list(finder.find(text))
                    found += hits
                    rows += [row] * len(hits)
            columns = zip(*found) if found else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                names=schema.fieldNames(),
            )

    return df.select(id_col, text_col).mapInArrow(run, schema)


def with_hash(df: DataFrame, text_col: str = "review_text") -> DataFrame:
    """With ``_hash``, the SHA-256 of the text; rows without a text have keys of their own."""
    return df.withColumn("_hash", spread_nulls(F.sha2(F.col(text_col), 256), *df.columns))


def distinct_texts(hashed: DataFrame, text_col: str = "review_text") -> DataFrame:
    """(``_hash``, ``_text``), one row a text; copies are combined before the shuffle."""
    return hashed.where(F.col(text_col).isNotNull()).groupBy("_hash").agg(F.first(text_col).alias("_text"))


def score_texts(
    df: DataFrame, score: Callable[[list[str]], list[str]], text_col: str = "review_text",
    out: str = "raw_output", store: OutputStore | None = None, unique: DataFrame | None = None,
) -> DataFrame:
    """Add the output of ``score`` for each text, scoring identical texts once.

    Texts are grouped by SHA-256, scored in Arrow batches and joined back on the hash. A
    text that very many rows share is combined before the shuffle, and its rows are split
    by the skew-join rule on the way back. If ``score`` fails on a batch its texts are scored one by
    one, and a text that fails alone has null output.

    With a ``store``, texts it holds from earlier batches are not scored again, new outputs are
    added to it, and a column ``cached`` says which rows came from it.

    With ``unique``, as by ``distinct_texts``, ``df`` has ``_hash`` and needs no text column: of the unique texts
    those of its rows are scored.
    """
    if unique is None:
        hashed = with_hash(df, text_col)
        unique = distinct_texts(hashed, text_col)
    else:
        hashed, unique = df, unique.join(df.select("_hash"), "_hash", "left_semi")

    def alone(text: str) -> str | None:
        try:
            return score([text])[0]
        except Exception:  # the user's function: one text must not end the job
            return None

    def outputs(some: list[str]) -> list[str | None]:
        try:
            return score(some)
        except Exception:
            return [alone(text) for text in some]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"_hash": batch["_hash"], out: outputs(batch["_text"].tolist())}, dtype=object)

    if store is None:
        scored = unique.mapInPandas(run, f"_hash string, {out} string")
        return hashed.join(scored, "_hash", "left").drop("_hash")
    known = store.earlier(df.sparkSession)
    fresh = unique if known is None else unique.join(known.select("_hash"), "_hash", "left_anti")
    store.add(fresh.mapInPandas(run, f"_hash string, {out} string").withColumnRenamed(out, "output"))
    found = store.own(df.sparkSession).withColumn("cached", F.lit(False))
    if known is not None:
        found = found.unionByName(known.withColumn("cached", F.lit(True)))
    found = found.withColumnRenamed("output", out)
    return (
        hashed.join(found, "_hash", "left").withColumn("cached", F.coalesce("cached", F.lit(False))).drop("_hash")
    )


@dataclass(frozen=True)
class OutputStore:
    """Outputs of a scoring function by (SHA-256 of the text, attempt), kept from batch to batch.

    Every batch writes its own version, so a batch that runs again replaces what it added and sees only
    what was there before it. Texts without an output are not kept: a later batch tries them again.
    """

    path: str
    batch: int
    attempt: int = 1

    def _version(self, number: int) -> str:
        return f"{self.path.rstrip('/')}/attempt={self.attempt}/version={number}"

    def earlier(self, spark: SparkSession) -> DataFrame | None:
        """(``_hash``, ``output``) of earlier batches, one row a hash; None where there are none."""
        held = read_if_present(spark, f"{self.path.rstrip('/')}/attempt={self.attempt}")
        if held is None or "version" not in held.columns:
            return None
        held = held.where((F.col("version") < self.batch) & F.col("output").isNotNull())
        return keep_first(held, ["_hash"], [F.col("version")]).select("_hash", "output")

    def add(self, scored: DataFrame) -> None:
        scored.write.mode("overwrite").parquet(self._version(self.batch))

    def own(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self._version(self.batch))


def embed_texts(
    df: DataFrame, embed: Callable[[list[str]], list[list[float]]], text_col: str = "text"
) -> DataFrame:
    """(text, embedding) for each distinct text, embedded in Arrow batches."""
    unique = df.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text")).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"text": batch["text"], "embedding": list(embed(batch["text"].tolist()))})

    return unique.mapInPandas(run, "text string, embedding array<double>")
