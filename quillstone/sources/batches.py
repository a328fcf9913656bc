"""How many bytes of rows go to or from a Python worker at a time."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of rows that go to or from a Python worker at a time.
BATCH = 4_000_000


def small_batches(spark: SparkSession) -> None:
    """Arrow batches by bytes rather than rows, so that ten thousand long texts
    don't make one; a smaller limit that the session has stays. Results don't
    depend on it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, "64m").lower().rstrip("b")
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(now[-1:], 1)
    size = int(now.rstrip("kmg") or 0) * unit
    if size <= 0 or size > BATCH:
        spark.conf.set(name, str(BATCH))
