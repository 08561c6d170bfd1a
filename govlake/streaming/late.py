"""Rows that come after the watermark: a dead-letter output beside the stream.

The watermark in force for a micro-batch is the latest event time of all
earlier batches less the delay, as Spark keeps it for the stateful operators of
a query.  A row at or before it is late: the windows and sessions it belongs to
may be closed.  ``split_late`` writes each batch's rows in time and its late
rows side by side and counts both, in one pass over the batch; no row is lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .streams import WATERMARK, _exists

LEDGER = "batch_id bigint, watermark timestamp, next_watermark timestamp, n_rows bigint, n_late bigint"


def watermark_before(spark: SparkSession, path: str, batch_id: int):
    """The watermark that earlier batches left (None before the first one that
    had a time); one small row per batch."""
    if not _exists(spark, f"{path}/ledger"):
        return None
    ledger = spark.read.schema(LEDGER).parquet(f"{path}/ledger")
    return ledger.filter(F.col("batch_id") < batch_id).agg(F.max("next_watermark")).first()[0]


def split_late(path: str, delay: str = WATERMARK, time_col: str = "event_time"):
    """foreachBatch function: rows of a batch under ``path/rows``, partitioned
    by ``late`` and ``batch``, and one line per batch under ``path/ledger``
    (read them with ``late_rows`` and ``late_ledger``).

    A replayed batch overwrites its own folders and sees the watermark of the
    batches before it, so replays give the same files.  A row without a time is
    never late."""
    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mark = watermark_before(spark, path, batch_id)
        bound = F.lit(mark).cast("timestamp")
        late = F.coalesce(F.col(time_col) <= bound, F.lit(False))
        out = batch.withColumns({"watermark": bound, "late": late})
        rows = f"{path}/rows/batch={batch_id}"
        out.write.mode("overwrite").partitionBy("late").parquet(rows)
        # counted from what was written: the batch itself is read once
        got = spark.read.schema(out.schema).parquet(rows).agg(
            F.count("*").alias("n"), F.count_if("late").alias("n_late"),
            (F.max(time_col) - F.expr(f"INTERVAL {delay}")).alias("mark")).first()
        marks = [m for m in (mark, got["mark"]) if m is not None]
        spark.createDataFrame([(batch_id, mark, max(marks, default=None), got["n"], got["n_late"])], LEDGER) \
            .write.mode("overwrite").parquet(f"{path}/ledger/batch={batch_id}")
    return apply


def late_rows(spark: SparkSession, path: str, late: bool = True) -> DataFrame:
    """The dead letters (or, with ``late=False``, the rows in time); the choice
    prunes folders."""
    return spark.read.parquet(f"{path}/rows").filter(F.col("late") == F.lit(late)).drop("late")


def late_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Per micro-batch: its watermark, rows and late rows."""
    return spark.read.schema(LEDGER).parquet(f"{path}/ledger").select(
        "batch_id", "watermark", "n_rows", "n_late")


def follow_late(events: DataFrame, path: str, checkpoint: str, delay: str = WATERMARK):
    """Split what is available of a stream of events and stop; returns the query."""
    q = (events.withWatermark("event_time", delay).writeStream.foreachBatch(split_late(path, delay))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return q
