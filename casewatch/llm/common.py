"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewatch.session import scratch

Batches = Iterator[pa.RecordBatch]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame below the shared scratch folder and read it back: cuts its lineage."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Shelf:
    """The written tables of one job, in a folder of its own below the shared scratch folder.

    ``put`` writes a frame and reads it back, which cuts its lineage; ``drop`` deletes a table whose
    successor is written. Results that are still to be read must not be dropped.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.paths = spark, scratch(spark, name), {}

    def put(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        """``by``: columns whose values get folders of their own."""
        path = f"{self.base}/{len(self.paths)}-{name}"
        (df.write.partitionBy(*by) if by else df.write).parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(kept)] = (path, kept)
        return kept

    def path(self, df: DataFrame) -> str:
        return self.paths[id(df)][0]

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            self._delete(self.paths[id(df)][0])

    def clear(self) -> None:
        """Delete all tables of the job."""
        self._delete(self.base)

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def arrow_uri(spark: SparkSession, path: str) -> str:
    """A path as Spark resolves it, in the form that Arrow reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    scheme, _, rest = full.partition(":")
    scheme = "s3" if scheme in ("s3a", "s3n") else scheme
    return f"{scheme}://" + (rest[2:] if rest.startswith("//") else rest)


def parts(spark: SparkSession, n_bytes: int, each: int) -> int:
    """Partitions for so many bytes, no fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(n_bytes or 0) // each))


def raw(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column as UTF-8 bytes, null as empty."""
    return [v or b"" for v in batch.column(name).cast(pa.large_binary()).to_pylist()]


def emit(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A batch of the given columns, cast to the schema."""
    arrays = [
        c.cast(f.type) if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type)
        for f in schema
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def lists(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    """A list column from flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))


def sliced(flat: np.ndarray, lengths: Iterable[int]) -> list[np.ndarray]:
    return np.split(flat, np.cumsum(list(lengths))[:-1])


def pieces_of(batches: Batches, rows: int = 512) -> Batches:
    """The batches in slices of few rows: what Python holds at a time stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def per_batch(fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]) -> Callable[[Batches], Batches]:
    """A function of one batch as the function over a partition's batches that Spark calls."""
    def run(batches: Batches) -> Batches:
        for batch in pieces_of(batches):
            yield from fn(batch)
    return run


def row_key(*columns: str) -> Column:
    """A 64-bit key of a row's values; equal rows share it, nulls count as values of their own."""
    return F.xxhash64(*[c for n in columns for c in (F.col(n).isNull(), F.col(n))])


class Memo(dict):
    """A bounded cache: missing keys come from ``fill``; of two generations the older one is dropped."""

    def __init__(self, fill: Callable, most: int = 300_000):
        super().__init__()
        self.fill, self.most, self.old = fill, most, {}

    def __missing__(self, key):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        value = self[key] = self.fill(key) if value is None else value
        return value

    def forget(self) -> None:
        """Drop everything and give the memory back: an idle Python worker stands beside the next stages."""
        self.clear()
        self.old = {}
        pa.default_memory_pool().release_unused()


def free_prefix(df: DataFrame) -> str:
    """A prefix that no column of ``df`` starts with, in any case: for helper columns beside a user's."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix
