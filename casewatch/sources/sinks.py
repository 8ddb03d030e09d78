"""Writers: full replace, stored lookup, labelling sheet, metrics, and a versioned result table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewatch.operators.dedupe import keep_first


def stamped(df: DataFrame, column: str) -> DataFrame:
    """With the time of the write: one value for all rows of a job."""
    return df.withColumn(column, F.current_timestamp())


def replace_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write the table anew and return it as read back. The path must not be an input of ``df``."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.parquet(path)


def read_if_present(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def stored_or_built(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The stored table if there is one, else build and store it."""
    stored = read_if_present(spark, path)
    return stored if stored is not None else replace_table(build(), path)


def label_sheet(reviews: DataFrame, n: int = 50, preview: int = 200) -> DataFrame:
    """The first ``n`` event-mentioning reviews by id, with a preview and empty label columns."""
    return (
        reviews.where("has_ae_mention").orderBy("review_id").limit(n)
        .select(
            "review_id", "drug_norm",
            F.substring("review_text", 1, preview).alias("review_text_preview"),
            *(F.lit("").alias(c) for c in ("drugs_gt", "reactions_gt", "severity_gt", "notes")),
        )
    )


def write_csv(df: DataFrame, path: str) -> None:
    """CSV that ``read_labels`` and spreadsheet programs read back: quotes doubled."""
    df.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def write_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_version(df: DataFrame, path: str, version: int) -> None:
    """Write one batch as its own partition; writing the same version again replaces it."""
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/version={version}")


def current_rows(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The latest version of every key: last write wins, no batch rewrites older ones."""
    return keep_first(table, keys, [F.col("version").desc()]).drop("version")


def next_version(table: DataFrame | None) -> int:
    """The number of the next batch of a versioned table."""
    last = None if table is None else table.agg(F.max("version")).first()[0]
    return 0 if last is None else last + 1


def compact_versions(spark: SparkSession, path: str, keys: Sequence[str], out: str) -> DataFrame:
    """The current rows as one version below a new path; later batches go on from its number."""
    table = spark.read.parquet(path)
    append_version(current_rows(table, keys), out, next_version(table) - 1)
    return spark.read.parquet(out)
