"""Best partner of every left row in a catalog, under any scoring function.

The catalog is meant to be small (a vocabulary). Its size is measured before a row of it moves:
within the bounds it is broadcast and the left rows stream past it; beyond them both sides are
stored as blocks of bounded size, every pair of blocks meets in a Cartesian product that reads them from
there, and the winners of each pair of partitions are reduced. No row is copied by a shuffle and no pair of
rows is ever written out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewatch.operators.dedupe import keep_first
from casewatch.session import scratch
from casewatch.sources.sinks import replace_table

# Scorer factory: catalog frame -> (left frame -> frame of result rows, one per left row).
Prepare = Callable[[pd.DataFrame], Callable[[pd.DataFrame], pd.DataFrame]]

MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 256 << 20
BLOCK_ROWS = 20_000
BLOCK_BYTES = 8 << 20


def measured(catalog: DataFrame, row_bytes: Column, *more: Column) -> tuple:
    """Rows and bytes of a catalog, and ``more`` aggregates of the same pass, before a row of it moves."""
    rows, held, *rest = catalog.agg(F.count(F.lit(1)), F.coalesce(F.sum(row_bytes), F.lit(0)), *more).first()
    return rows, held, *rest


def stream_past(left: DataFrame, catalog: DataFrame, key: str, prepare: Prepare, schema: T.StructType) -> DataFrame:
    """Result rows of the left rows against a catalog of a measured size, which is broadcast."""
    head = catalog.toPandas()
    if head.empty:
        return nothing(left, key, schema)
    shared = left.sparkSession.sparkContext.broadcast(head)

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = prepare(shared.value)
        for batch in batches:
            yield score(batch)

    return left.mapInPandas(stream, schema)


def nothing(left: DataFrame, key: str, schema: T.StructType) -> DataFrame:
    """Result rows against an empty catalog: score 0, no partner."""
    empty = {f.name: F.lit(None).cast(f.dataType) for f in schema} | {"_score": F.lit(0.0)}
    return left.select(*[F.col(key) if n == key else c.alias(n) for n, c in empty.items()])


def winners_first(found: DataFrame, key: str) -> DataFrame:
    """The highest score per key, then the lowest ``_form`` where there is one, then the lowest place."""
    return keep_first(found, [key], [F.col("_score").desc(), *[F.col("_form").asc()] * ("_form" in found.columns), F.col("_place").asc()])


def by_block(prepare: Prepare, schema: T.StructType) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The scorer of one pair of blocks, for a cogroup."""
    names = schema.fieldNames()

    def block(rows: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(columns=names) if rows.empty or part.empty else prepare(part)(rows)

    return block


def packed(df: DataFrame, block_rows: int, name: str) -> DataFrame:
    """The rows as Arrow streams of at most ``block_rows`` rows, one a row of the column ``name``, dealt evenly and stored."""
    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, parts[0].schema) as writer:
            writer.write_table(pa.Table.from_batches(parts).combine_chunks())
        return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=[name])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                parts.append(batch.slice(at, block_rows - n))
                n, at = n + parts[-1].num_rows, at + parts[-1].num_rows
                if n == block_rows:
                    yield block(parts)
                    parts, n = [], 0
        if parts:
            yield block(parts)

    spark = df.sparkSession
    blocks = df.mapInArrow(pack, f"{name} binary").repartition(spark.sparkContext.defaultParallelism)
    return replace_table(blocks, scratch(spark, name))


def better(new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
    """Row by row the result with the higher score, then the lower place; NaN counts as highest, as in Spark's order."""
    score, known = (f["_score"].fillna(np.inf).to_numpy() for f in (new, old))
    wins = (score > known) | ((score == known) & (new["_place"].to_numpy() < old["_place"].to_numpy()))
    return new.where(pd.Series(wins, new.index), old).astype(new.dtypes.to_dict())


def best_partner(
    left: DataFrame, catalog: DataFrame, key: str, prepare: Prepare, schema: T.StructType,
    rows: int, held: int, max_broadcast_rows: int = MAX_BROADCAST_ROWS, block_rows: int = BLOCK_ROWS,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """One result row per left row; ``key`` is unique on the left and part of ``schema``.

    ``schema`` has the columns ``_score`` and ``_place``; see ``winners_first`` for the order. ``rows`` and
    ``held`` are the size of the catalog as ``measured``. Beyond the broadcast a task holds two blocks, and a left row
    is shuffled as one result for each partition of the stored catalog.
    """
    if rows == 0:
        return nothing(left, key, schema)
    if rows <= max_broadcast_rows and held <= max_broadcast_bytes:
        return stream_past(left, catalog, key, prepare, schema)
    block_rows = max(1, min(block_rows, BLOCK_BYTES * rows // max(held, 1)))
    pairs = packed(left, block_rows, "_asked").hint("shuffle_replicate_nl").crossJoin(packed(catalog, block_rows, "_known"))
    names = schema.fieldNames()

    def frame(data: pa.Buffer) -> pd.DataFrame:
        return pa.ipc.open_stream(data).read_pandas()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, asked, found = None, None, None
        for batch in batches:
            for one, other in zip(batch.column("_asked"), batch.column("_known")):
                data = one.as_buffer()
                if last is None or not data.equals(last):  # a block meets all blocks of a partition in turn
                    if found is not None:
                        yield pa.RecordBatch.from_pandas(found, preserve_index=False)
                    last, found = pa.py_buffer(data.to_pybytes()), None
                    asked = frame(last)
                new = prepare(frame(other.as_buffer()))(asked)[names]
                found = new if found is None else better(new, found)
        if found is not None:
            yield pa.RecordBatch.from_pandas(found, preserve_index=False)

    return winners_first(pairs.mapInArrow(meet, schema), key)
