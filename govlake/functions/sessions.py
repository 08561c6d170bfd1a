"""Gap sessions per user as columns (used where a per-event session id is
needed; the aggregate form uses ``session_window``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessionize(events: DataFrame, gap_minutes: int, user_col: str = "user_id",
               ts_col: str = "timestamp", tie_col: str | None = "event_id",
               unit: str = "day") -> DataFrame:
    """Adds ``session_start``: a new session starts when the gap to the
    user's previous event is more than ``gap_minutes``.

    Both steps (previous event, last session start) are bucketed scans, so a
    very active user is spread over day buckets instead of one task."""
    from .scan import bucket_of, last_non_null, previous_value
    order = [ts_col] + ([tie_col] if tie_col else [])
    b = events.withColumn("_bucket", bucket_of(ts_col, unit))
    p = previous_value(b, [user_col], order, ts_col, "_prev")
    new = F.when(F.col("_prev").isNull()
                 | (F.col(ts_col) > F.col("_prev") + F.expr(f"INTERVAL {gap_minutes} MINUTES")),
                 F.col(ts_col))
    p = p.withColumn("_new", new)
    return last_non_null(p, [user_col], order, "_new", "session_start") \
        .drop("_prev", "_new", "_bucket")
