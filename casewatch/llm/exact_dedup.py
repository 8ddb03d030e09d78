"""Exact duplicates against immutable snapshots, each screened by binary-fuse filters."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewatch.llm import fuse_filter
from casewatch.llm.common import Shelf, emit

PER_BUCKET = 250_000  # digests of a bucket, and of an incoming group screened at a time, on average
FILTER = pa.schema([("bucket", pa.int64()), ("seed", pa.int64()), ("segment", pa.int64()), ("cells", pa.binary()), ("n_keys", pa.int64()), ("n_rows", pa.int64())])
POSITIVE = pa.schema([("entry", pa.int64())])


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def bucket_of(n: int) -> Column:
    return F.pmod(F.shiftright("key", 20), F.lit(n))


def filter_of(rows: pa.Table) -> pa.Table:
    """The filter over the keys of one bucket."""
    keys = np.unique(rows["key"].to_numpy().view(np.uint64))
    seed, segment, cells = fuse_filter.build(keys)
    one = {"bucket": [rows["bucket"][0].as_py()], "seed": [seed], "segment": [segment], "cells": [cells], "n_keys": [len(keys)], "n_rows": [rows.num_rows]}
    return pa.Table.from_batches([emit(FILTER, **one)])


def screen(incoming: pa.Table, filters: pa.Table) -> pa.Table:
    """Entries of an incoming group whose key the filter of its bucket may hold."""
    if not (incoming.num_rows and filters.num_rows):
        return POSITIVE.empty_table()
    seed, segment, cells = (filters[c][0].as_py() for c in ("seed", "segment", "cells"))
    maybe = fuse_filter.contains(incoming["key"].to_numpy().view(np.uint64), seed, segment, cells)
    return incoming.select(["entry"]).filter(pa.array(maybe)).cast(POSITIVE)


class Snapshots:
    """An index of distinct texts that grows by whole batches.

    Each batch is grouped by its own texts first and becomes an immutable snapshot: one row a distinct
    text (``entry``, ``digest``, ``text``, ``last`` id, ``n`` rows) and one static filter a bucket of its
    digests. The digests of a later batch are screened by the filters of every snapshot; only positives
    are looked up in the snapshot's exact rows, by digest and then by the bytes of the text.

    Texts equal in all bytes are one class, however many digests collide: where two texts of one digest
    have been seen, the last join uses the texts too. A null text counts as empty, a null id loses to any
    other. Copies within a batch meet by partial aggregation, so a text that a third of all rows share
    reaches its group once a partition. Snapshots live below the shared scratch folder.
    """

    def __init__(self, spark: SparkSession, digest: Callable[[Column], Column] = sha256, per_bucket: int = PER_BUCKET):
        self.spark, self.digest, self.per_bucket = spark, digest, per_bucket
        self.shelf, self.taken, self.homes, self.collided = Shelf(spark, "snapshots"), [], [], False

    def add(self, batch: DataFrame, key: str = "doc_id", text: str = "text") -> None:
        """Group a batch, match it with the earlier snapshots, and keep it as the next one."""
        number = len(self.taken)
        words = batch.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        found = words.groupBy("text").agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("n"))
        found = found.select("text", "last", "n", self.digest(F.col("text")).alias("digest"), F.monotonically_increasing_id().alias("entry"))
        found = self.shelf.put(found.withColumn("key", F.xxhash64("digest")), f"entries-{number}")
        n_found = found.count()
        home = found.select("entry", F.lit(number).alias("home"), F.col("entry").alias("home_entry"))
        for earlier, (entries, filters, n_buckets) in enumerate(self.taken):
            pairs = self._matched(found, n_found, entries, filters, n_buckets)
            self.collided = self.collided or not pairs.where("NOT same").isEmpty()
            here = pairs.where("same").select("entry", F.lit(earlier).alias("h"), F.col("old").alias("e"))
            home = home.join(here, "entry", "left").select(
                "entry", F.when(F.col("h") < F.col("home"), F.col("h")).otherwise(F.col("home")).alias("home"),
                F.when(F.col("h") < F.col("home"), F.col("e")).otherwise(F.col("home_entry")).alias("home_entry"))
        n_buckets = max(1, -(-n_found // self.per_bucket))
        filters = found.select("key", bucket_of(n_buckets).alias("bucket")).groupBy("bucket")
        filters = self.shelf.put(filters.applyInArrow(filter_of, "bucket long, seed long, segment long, cells binary, n_keys long, n_rows long"), f"filters-{number}")
        self.collided = self.collided or not filters.where("n_keys < n_rows").isEmpty()
        self.taken.append((found, filters, n_buckets))
        self.homes.append(self.shelf.put(home, f"homes-{number}") if number else home)

    def _matched(self, found: DataFrame, n_found: int, entries: DataFrame, filters: DataFrame, n_buckets: int) -> DataFrame:
        """(``entry``, ``old``, ``same``): positives beside the exact rows of their digest, and whether the bytes agree."""
        splits = max(1, -(-n_found // (n_buckets * self.per_bucket)))  # a larger batch meets copies of the filters
        group = found.select("entry", "key", bucket_of(n_buckets).alias("bucket"), F.pmod("key", F.lit(splits)).alias("split"))
        sent = filters.withColumn("split", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(splits - 1).cast("long"))))
        positive = group.groupBy("bucket", "split").cogroup(sent.groupBy("bucket", "split")).applyInArrow(screen, "entry long")
        positive = found.select("entry", "digest").join(positive, "entry")
        exact = entries.select("digest", F.col("entry").alias("old")).join(positive, "digest")
        exact = self.shelf.put(exact.select("entry", "old"), "positives")  # few columns of the exact rows are read up to here
        new = found.select("entry", "text").join(exact, "entry")
        old = entries.select(F.col("entry").alias("old"), F.col("text").alias("stored"))
        pairs = new.join(old, "old").select("entry", "old", (F.col("text") == F.col("stored")).alias("same"))
        return self.shelf.put(pairs, "pairs")

    def classes(self) -> DataFrame:
        """One row a text and snapshot that holds it: ``batch``, ``digest``, ``text``, and of its class ``keep_id`` and ``group_size`` over all batches."""
        rows = None
        for number, ((found, *_), home) in enumerate(zip(self.taken, self.homes)):
            one = found.join(home, "entry") if number else found.select("*", F.lit(0).alias("home"), F.col("entry").alias("home_entry"))
            one = one.select(F.lit(number).alias("batch"), "digest", "text", "last", "n", "home", "home_entry")
            rows = one if rows is None else rows.unionByName(one)
        total = rows.groupBy("home", "home_entry").agg(F.max("last").alias("keep_id"), F.sum("n").alias("group_size"))
        return rows.drop("last", "n").join(total, ["home", "home_entry"]).drop("home", "home_entry")


def indexed(docs: DataFrame, batch: Column, n_batches: int, **args) -> Snapshots:
    """The rows of ``docs`` added batch by batch; ``batch`` numbers them from 0."""
    index = Snapshots(docs.sparkSession, **args)
    for number in range(n_batches):
        index.add(docs.where(batch == number))
    return index


def report(docs: DataFrame, batch: Column | None = None, n_batches: int = 3, **args) -> DataFrame:
    """One row for every row of ``docs``: ``doc_id``, ``keep_id`` (largest id with the same text), ``group_size`` (rows with that text), ``kept``, ``text_sha256``.

    The rows arrive in ``n_batches`` batches, by default dealt by a hash of the id; the result does not
    depend on that. Null texts count as empty; a null id loses to any other, and a group of null ids
    has a null ``keep_id``. Where several rows repeat the staying id and text, one of them is kept. Texts
    of any length count whole. An empty table gives no rows; other columns, whatever their names, are not read.
    """
    arrival = F.pmod(F.xxhash64("doc_id"), F.lit(n_batches)) if batch is None else batch
    index = indexed(docs, arrival, n_batches, **args)
    text = F.coalesce(F.col("text"), F.lit(""))
    by: Sequence[str] = ["digest", "text"] if index.collided else ["digest"]
    own = docs.select("doc_id", index.digest(text).alias("digest"), F.sha2(text, 256).alias("text_sha256"), text.alias("text"))
    own = own.groupBy("doc_id", "text_sha256", *by).agg(F.count(F.lit(1)).alias("n"))
    multiple = index.classes().where("group_size > 1").select(*by, "keep_id", "group_size").distinct()
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return (
        own.join(multiple, by, "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
        .select(
            "doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
            F.when(F.col("group_size").isNull(), F.lit(True)).otherwise(stays).alias("kept"), "text_sha256")
    )


def deduplicated(docs: DataFrame, **args) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of equal texts one row with the largest id.

    Of rows that repeat that id and text any one stays. Nulls, long texts and empty tables as in ``report``.
    """
    free = "row"
    while free in docs.columns:
        free += "_"
    text = F.coalesce(F.col("text"), F.lit(""))
    keep = report(docs.select("doc_id", "text"), **args).where("kept").select(F.col("doc_id").alias(f"{free}_id"), F.col("text_sha256").alias(free))
    keyed = docs.withColumn(free, F.sha2(text, 256))
    held = keyed.join(keep, (keyed["doc_id"].eqNullSafe(keep[f"{free}_id"])) & (keyed[free] == keep[free]), "left_semi")
    return held.dropDuplicates(["doc_id", free]).select(*[F.col(f"`{c}`") for c in docs.columns])


def oracle() -> str:
    return """
    WITH t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents)
    SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
           row_number() OVER (PARTITION BY body ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(body) AS text_sha256
    FROM t
    """
