"""Readers for case-report quarters, review files, vocabulary files, labels and tables."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewatch import constants as K
from casewatch.functions.text import first_case
from casewatch.sources.quoted import read_quoted

log = logging.getLogger(__name__)


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower() for c in df.columns])


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack frames by column name; a column one of them lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def list_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Paths and sizes of the files below a folder; contents are not read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob).load(folder).select("path", "length")
    )


def quarters(spark: SparkSession, folder: str) -> DataFrame:
    """(quarter, file_type, path): one file per quarter and type.

    Looks in ``faers_ascii_<quarter>/ascii/``, or in the quarter folder itself where it has
    no ``ascii`` folder, for names that begin with the type and end in ``.txt``, in any
    case. A ``.txt`` folder of part files counts as one file. Of several matches the first
    by path is taken.
    """
    below = rf"/{K.QUARTER_DIR_PREFIX}([^/]+)/((?:ascii/)?)([^/]+\.(?i:txt))(?:/[^/]+)?$"
    kind = first_case((F.upper("name").startswith(t), F.lit(t)) for t in K.QUARTER_FILE_TYPES)
    found = (
        list_files(spark, folder)
        .select(
            F.regexp_extract("path", below, 1).alias("quarter"),
            (F.regexp_extract("path", below, 2) != "").alias("nested"),
            F.regexp_extract("path", below, 3).alias("name"),
            F.regexp_replace("path", r"(\.(?i:txt))/[^/]+$", "$1").alias("path"),
        )
        .where("quarter != ''").withColumn("file_type", kind).where("file_type is not null")
    )
    best = found.groupBy("quarter", "file_type").agg(
        F.min(F.struct((~F.col("nested")).alias("flat"), "path")).alias("best")
    )
    nested = found.groupBy("quarter").agg(F.bool_or("nested").alias("has_nested"))
    return (
        best.join(nested, "quarter").where(~(F.col("has_nested") & F.col("best.flat")))
        .select("quarter", "file_type", F.col("best.path").alias("path"))
    )


def discover_quarters(spark: SparkSession, folder: str) -> dict[str, dict[str, str]]:
    """The same as a plain dict for planning reads: a handful of paths per quarter."""
    out: dict[str, dict[str, str]] = {}
    for row in quarters(spark, folder).orderBy("quarter", "file_type").collect():
        out.setdefault(row.quarter, {})[row.file_type] = row.path
    return out


def read_dollar(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A ``$``-separated file with a header, all columns as strings, names in lower case.

    Surplus fields of a row are dropped, missing ones are null, bytes that are not UTF-8
    become the replacement character. Of ``columns`` those the file has are kept.
    """
    df = lower_names(spark.read.option("sep", "$").option("header", "true").csv(path))
    if columns is None:
        return df
    missing = [c for c in columns if c.lower() not in df.columns]
    if missing:
        log.warning("columns %s not found in %s", missing, path)
    return df.select(*[c.lower() for c in columns if c.lower() in df.columns])


def read_quarters(
    spark: SparkSession, found: Mapping[str, Mapping[str, str]], file_type: str
) -> DataFrame | None:
    """All files of a type stacked; None if no quarter has one. Each file has its own header."""
    frames = [read_dollar(spark, files[file_type]) for files in found.values() if file_type in files]
    return union_all(frames) if frames else None


def read_reviews(
    spark: SparkSession, folder: str, files: Sequence[tuple[str, str]] = K.REVIEW_FILES
) -> DataFrame:
    """The review files present, stacked, with ``source`` from the file name.

    Quoted review text runs over line breaks; ``read_quoted`` still splits large files. A file that cannot
    be opened is left out with a warning.
    """
    present = {
        row[0]
        for row in list_files(spark, folder)
        .select(F.regexp_extract("path", r"/(drugsCom[^/]+\.[ct]sv)(?:/[^/]+)?$", 1)).distinct().collect()
    }
    frames = []
    for name, label in files:
        if name not in present:
            continue
        try:
            read = read_quoted(spark, f"{folder.rstrip('/')}/{name}", "\t" if name.endswith(".tsv") else ",")
        except (PySparkException, Py4JJavaError) as error:
            log.warning("%s left out: %s", name, str(error).splitlines()[0])
            continue
        frames.append(lower_names(read).withColumn("source", F.lit(label)))
    if not frames:
        raise FileNotFoundError(f"no review files in {folder}")
    return union_all(frames)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """A vocabulary text file; the separator is read off its first line, names in upper case."""
    head = spark.read.text(path).first()
    line = head[0] if head else ""
    sep = "\t" if "\t" in line and "|" not in line else "|"
    df = spark.read.option("sep", sep).option("header", "true").csv(path)
    return df.toDF(*[c.strip().upper() for c in df.columns])


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label rows that name at least one drug."""
    df = read_quoted(spark, path)
    return df.where(F.col("drugs_gt").isNotNull() & (F.col("drugs_gt") != ""))


def table_counts(tables: Mapping[str, DataFrame | None]) -> DataFrame:
    """Rows per table; a table that does not exist yet counts 0."""
    spark = next(t for t in tables.values() if t is not None).sparkSession

    def count(name: str, table: DataFrame | None) -> DataFrame:
        label = F.lit(name).alias("table_name")
        if table is None:
            return spark.range(1).select(label, F.lit(0).cast("long").alias("n"))
        return table.agg(F.count(F.lit(1)).alias("n")).select(label, "n")

    return union_all([count(n, t) for n, t in tables.items()])
