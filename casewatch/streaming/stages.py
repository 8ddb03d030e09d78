"""Ingest in stages that resume after the last finished one."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from casewatch import constants as K
from casewatch.plans import ingest
from casewatch.sources.readers import discover_quarters, read_quarters
from casewatch.sources.sinks import read_if_present, replace_table, stamped

STAGES = ("cases", "drugs", "reactions")


def _marks(out: str) -> str:
    return f"{out.rstrip('/')}/finished"


def run_stages(
    spark: SparkSession, out: str, builders: Mapping[str, Callable[[], DataFrame]], least: Mapping[str, int] | None = None
) -> list[str]:
    """Build each table that is not finished yet; returns the names of those built.

    A stage is finished once its mark, a one-row table with the row count, is written
    after the table itself. An interrupted stage has no mark and is built again. Rows are counted while
    they are written; a stage with fewer than ``least`` rows ends the run and gets no mark.
    """
    built = []
    for name, build in builders.items():
        mark = f"{_marks(out)}/table_name={name}"
        if read_if_present(spark, mark) is None:
            seen = Observation(name)
            replace_table(build().observe(seen, F.count(F.lit(1)).alias("n")), f"{out.rstrip('/')}/{name}")
            n = seen.get["n"]
            if n < (least or {}).get(name, 0):
                raise ValueError(f"only {n} rows in {name}, expected at least {least[name]}")
            replace_table(spark.createDataFrame([(n,)], "n long"), mark)
            built.append(name)
    return built


def ingest_reports(
    spark: SparkSession, raw: str, out: str, least: int = K.MIN_INGESTED_CASES, **drug_args
) -> list[str]:
    """Quarter folders to the tables cases, drugs and reactions below ``out``.

    Later stages read the stored cases, so a resumed run does not repeat finished work.
    Seriousness comes from the outcome files where there are any. Fewer than ``least`` cases end the run.
    """
    found = discover_quarters(spark, raw)

    def need(kind: str) -> DataFrame:
        df = read_quarters(spark, found, kind)
        if df is None:
            raise FileNotFoundError(f"no {kind} file below {raw}")
        return df

    def stored_cases() -> DataFrame:
        return spark.read.parquet(f"{out.rstrip('/')}/cases")

    def cases() -> DataFrame:
        table = ingest.build_cases(need("DEMO"))
        outcomes = read_quarters(spark, found, "OUTC")
        if outcomes is None:
            return stamped(table, "created_at")
        flagged = ingest.apply_seriousness(table, ingest.case_seriousness(outcomes))
        return stamped(flagged, "created_at")

    return run_stages(spark, out, {
        "cases": cases,
        "drugs": lambda: ingest.build_drugs(need("DRUG"), stored_cases(), **drug_args),
        "reactions": lambda: ingest.build_reactions(need("REAC"), stored_cases()),
    }, {"cases": least})


def stage_status(spark: SparkSession, out: str) -> DataFrame:
    """(table_name, n, finished) per stage; unfinished stages count 0 rows."""
    wanted = spark.createDataFrame([(s,) for s in STAGES], "table_name string")
    marks = read_if_present(spark, _marks(out))
    if marks is None:
        return wanted.select("table_name", F.lit(0).cast("long").alias("n"), F.lit(False).alias("finished"))
    return wanted.join(marks, "table_name", "left").select(
        "table_name", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNotNull().alias("finished")
    )
