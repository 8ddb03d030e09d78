"""Streaming triage of arriving model outputs, with the open attempts of every report as keyed state."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from casewatch import constants as K
from casewatch.operators.names import Vocabulary
from casewatch.plans.triage import score_outputs
from casewatch.sources.sinks import append_version

HELD = "held string, done boolean"


def decide(held: dict[int, list], min_confidence: float, max_attempts: int) -> int | None:
    """The attempt that decides a report: the first confident one before which none is missing, or the last allowed one."""
    for attempt in range(1, max_attempts + 1):
        if attempt not in held:
            return None
        if held[attempt][0] >= min_confidence:
            return attempt
    return max_attempts


def decided_attempts(
    outputs: DataFrame, key: str = "report_id", vocabulary: Vocabulary = K.DRUG_KEYWORDS,
    min_confidence: float = K.MIN_CONFIDENCE, max_attempts: int = K.MAX_ATTEMPTS, idle_ms: int | None = None,
) -> DataFrame:
    """The attempts of each report up to the deciding one, once that has arrived: (key, attempt, raw, drug_norm, cached).

    ``outputs`` is a stream of (key, attempt, raw) and may have drug_norm and cached. Attempts may come in any order
    and more than once; of different rows for one attempt the first to arrive counts, within a micro-batch the
    least. The state of a report is one row for each of its ``max_attempts`` attempts, kept by a streaming
    aggregation; the query runs in update mode. With ``idle_ms`` a report's state, open or decided, is forgotten when
    nothing has arrived for it in that time; it is then kept by a function with timers, which costs
    milliseconds a report. Without, it stays.
    """
    extra = {"drug_norm": F.lit(None).cast("string"), "cached": F.lit(False)}
    rows = outputs.where(F.col("attempt").between(1, max_attempts) & F.col(key).isNotNull())
    rows = rows.withColumns({c: v for c, v in extra.items() if c not in rows.columns})
    scored = score_outputs(rows, vocabulary).select(key, F.col("attempt").cast("int"), "raw", "drug_norm", "cached", "confidence")
    if idle_ms is not None:
        return _until_idle(scored, key, min_confidence, max_attempts, idle_ms)

    # a batch has one time, also when it is run again; what is decided never changes after its last attempt arrived
    now = F.current_timestamp()
    row = F.struct("arrived", "confidence", "raw", "drug_norm", F.coalesce("cached", F.lit(False)).alias("cached"))
    numbers = range(1, max_attempts + 1)
    held = scored.withColumn("arrived", now).groupBy(key).agg(*[F.min(F.when(F.col("attempt") == i, row)).alias(f"_{i}") for i in numbers])
    # null as soon as an attempt is missing, as for ``decide``
    last = F.lit(max_attempts)
    for i in reversed(numbers):
        confident = F.col(f"_{i}.confidence") >= min_confidence
        last = F.when(F.col(f"_{i}").isNull(), F.lit(None)).when(confident, F.lit(i)).otherwise(last)
    used = held.withColumn("_last", last).where("_last is not null").select(
        key, F.slice(F.array(*[f"_{i}" for i in numbers]), 1, F.col("_last")).alias("_used"), now.alias("_now")
    )
    fresh = used.where(F.exists("_used", lambda t: t["arrived"] == F.col("_now")))
    return fresh.select(key, F.posexplode("_used").alias("_at", "_try")).select(
        key, (F.col("_at") + 1).alias("attempt"), "_try.raw", "_try.drug_norm", "_try.cached"
    )


def _until_idle(scored: DataFrame, key: str, min_confidence: float, max_attempts: int, idle_ms: int) -> DataFrame:
    """The same for state that is forgotten: the attempts of an open report, or a mark once it is decided."""
    columns = [key, "attempt", "raw", "drug_norm", "cached"]

    def update(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known, done = state.get if state.exists else ("{}", False)
        if not done:
            held = {int(a): v for a, v in json.loads(known).items()}
            new: dict[int, list] = {}
            for batch in batches:
                for a, raw, drug, cached, confidence in batch[["attempt", "raw", "drug_norm", "cached", "confidence"]].itertuples(index=False):
                    row = [float(confidence), *(None if pd.isna(v) else v for v in (raw, drug)), bool(cached)]
                    if int(a) not in held and (int(a) not in new or str(row) < str(new[int(a)])):
                        new[int(a)] = row
            held |= new
            last = decide(held, min_confidence, max_attempts)
            if last is not None:
                used = range(1, last + 1)
                yield pd.DataFrame({
                    key: [name[0]] * last, "attempt": list(used), **{c: [held[a][i] for a in used] for i, c in enumerate(columns[2:], 1)}})
            done = last is not None
            state.update(("" if done else json.dumps(held), done))
        state.setTimeoutDuration(idle_ms)

    out = f"`{key}` {scored.schema[key].dataType.simpleString()}, attempt int, raw string, drug_norm string, cached boolean"
    return scored.groupBy(key).applyInPandasWithState(update, out, HELD, "update", GroupStateTimeout.ProcessingTimeTimeout)


def stream_triage(
    spark: SparkSession, source: str, out: str, triage_batch: Callable[[DataFrame], DataFrame],
    key: str = "report_id", files_per_batch: int | None = None, vocabulary: Vocabulary = K.DRUG_KEYWORDS, **rules,
) -> None:
    """Triage what has arrived in ``source`` since the last run, then stop.

    Below ``out``: ``results`` with one version per micro-batch, and the stream's ``checkpoint`` with the state of
    ``decided_attempts`` (``rules`` are its arguments). A micro-batch reads its new rows and the state of
    their reports; no result table is read. Each report is triaged once, when it is decided. A batch that is
    run again after a failure replaces its own version; none rewrites older ones.
    """
    out = out.rstrip("/")
    reader = spark.readStream.schema(spark.read.parquet(source).schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def run(batch: DataFrame, version: int) -> None:
        batch.persist()  # triage reads it more than once; each reading would update the state again
        try:
            append_version(triage_batch(batch), f"{out}/results", version)
        finally:
            batch.unpersist()

    (
        decided_attempts(reader.parquet(source), key, vocabulary, **rules).writeStream.outputMode("update").foreachBatch(run)
        .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    )


def stream_results(spark: SparkSession, out: str) -> DataFrame:
    """The result table as it stands; a report has one row, as it is decided once."""
    return spark.read.parquet(f"{out.rstrip('/')}/results").drop("version")
