"""The shared folder, lineage cuts and Arrow batches of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratum.sources.scratch import new_folder, shared_folder, written

__all__ = ["bounded_batches", "cut", "new_folder", "shared_folder", "written"]

#: Bytes of an Arrow batch at most: a Python worker holds one, and so does its executor for it.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """From here on, Arrow batches of BATCH_BYTES at most, unless the session asks for smaller ones: texts are long, and workers are small."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not now.rstrip("b").isdigit() or not 0 < int(now.rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and go on from there: a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
