"""CSV files with line breaks inside quotes, read by as many tasks as a file has splits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Splits whose quote counts may be broadcast; with 128 MB each this is over 10 TB of files in one call.
MAX_SPLITS = 100_000
PIECE = pa.schema([("file", pa.string()), ("split", pa.int64()), ("place", pa.int64()), ("edge", pa.bool_()), ("text", pa.string())])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (file, split, inside, line) in file order to pieces of records.

    A record starts at every line before which the file holds an even number of quotes. ``place`` numbers the records that
    start in a split; -1 is what stands before the first of them. ``edge`` marks the pieces that may go on in
    another split: the one before and the last.
    """
    at, odd, place, held, rows = None, 0, -1, [], []

    def ended(edge: bool):
        if held:
            rows.append((*at, place, edge or place < 0, "\n".join(held)))
            held.clear()

    for batch in batches:
        quotes = pc.count_substring(batch["line"], '"').to_numpy(zero_copy_only=False)
        for file, split, inside, line, odd_line in zip(
            *(batch[c].to_pylist() for c in ("file", "split", "inside", "line")), (quotes % 2).astype(np.int8).tolist()
        ):
            if (file, split) != at:
                ended(True)
                at, odd, place = (file, split), inside, -1
            if not odd:
                ended(False)
                place += 1
            held.append(line)
            odd ^= odd_line
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PIECE)], schema=PIECE)
            rows.clear()
    ended(True)
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PIECE)], schema=PIECE)


def records(spark: SparkSession, path: str) -> DataFrame | None:
    """(``file``, ``split``, ``place``, ``text``) of every record; None if the files have too many splits for a broadcast.

    Quotes inside a quoted field are doubled, so a line break belongs to a record if and only if an odd number of
    quotes stands before it. The quotes of each split are counted, summed over the splits before it, and every
    split is then cut on its own. Only the first and last pieces of splits are shuffled to be joined.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").alias("line"))
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    counted = lines.groupBy("file", "split").agg((F.sum(quotes) % 2).cast("int").alias("odd"))
    if counted.count() > MAX_SPLITS:
        return None
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    inside = counted.select("file", "split", (F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2).cast("int").alias("inside"))
    pieces = lines.join(F.broadcast(inside), ["file", "split"]).select("file", "split", "inside", "line").mapInArrow(
        _pieces, "file string, split long, place long, edge boolean, text string")
    upto = Window.partitionBy("file").orderBy("split", "place").rowsBetween(Window.unboundedPreceding, 0)
    owner = F.max(F.when(F.col("place") >= 0, F.struct("split", "place"))).over(upto)
    edges = pieces.where("edge").withColumn("owner", owner).groupBy("file", "owner").agg(
        F.array_sort(F.collect_list(F.struct("split", "place", "text"))).alias("parts"))
    joined = edges.select("file", "owner.split", "owner.place", F.array_join("parts.text", "\n").alias("text"))
    return pieces.where("NOT edge").select("file", "split", "place", "text").unionByName(joined)


def read_quoted(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A CSV file, or folder of files, with a header line each, quotes doubled and line breaks in quotes; all columns text.

    The result is that of Spark's multi-line reader, which gives a file to one task; this one
    splits large files. Files end their lines with \\n or \\r\\n.
    """
    options = {"sep": sep, "escape": '"'}
    plain = spark.read.options(**options, header="true")
    columns = plain.csv(path).columns
    found = records(spark, path)
    if found is None:
        return plain.option("multiLine", "true").csv(path)
    schema = ", ".join(f"c{i} string" for i in range(len(columns)))
    text = F.regexp_replace("text", "\r$", "")
    rows = found.where((F.col("split") > 0) | (F.col("place") > 0)).where(text != "")
    return rows.select(F.from_csv(text, schema, options).alias("row")).select(
        *[F.col(f"row.c{i}").alias(c) for i, c in enumerate(columns)])
