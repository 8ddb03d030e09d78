"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime settings the plans count on: re-planning from measured sizes, and splitting of
# oversized join partitions even where that costs one more exchange above the join.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # long texts: Arrow batches are cut by size as well as by rows
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
    "spark.sql.session.timeZone": "UTC",
}


def tune(
    spark: SparkSession, shuffle_bytes: int | None = None, partition_bytes: int = 128 << 20
) -> SparkSession:
    """Apply the runtime settings above to a session.

    ``shuffle_bytes``, the size of the largest shuffle to expect, raises the number of
    shuffle partitions to keep each near ``partition_bytes``. Adaptive execution merges
    partitions that turn out small but never cuts the whole more finely than this number.
    """
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    if shuffle_bytes is not None:
        now = int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.conf.set("spark.sql.shuffle.partitions", str(max(now, -(-shuffle_bytes // partition_bytes))))
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder the session names in ``spark.checkpoint.dir``.

    A session without that setting gets a temporary folder, but only in local mode: on a
    cluster the executors would each see their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="casewatch-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}/{name}"
