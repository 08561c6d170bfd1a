"""Writers: audit and compliance events by day (SNK-1, SNK-2).

Writes go to a folder the caller names (on a cluster, a shared folder).  One
directory per day replaces the reference's one file per day, so readers prune
by partition, and the day comes from the event's own timestamp (K26).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def audit_line(events: DataFrame, top_level=("timestamp", "event_type", "user_id", "action",
                                             "success")) -> DataFrame:
    """One JSON object per event: the top-level fields and a ``details`` object
    made of the remaining columns."""
    rest = [c for c in events.columns
            if c not in top_level and c not in ("event_date", "error", "session_id")]
    extra = [F.col(c) for c in ("session_id", "error") if c in events.columns]
    obj = F.struct(
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        *[F.col(c) for c in top_level if c != "timestamp"],
        F.struct(*[F.col(c) for c in rest]).alias("details"), *extra)
    return events.select(F.to_date("timestamp").alias("event_date"),
                         F.to_json(obj).alias("value"))


def write_audit(events: DataFrame, path: str, fmt: str = "json") -> str:
    """SNK-1: append events, one partition per day, as JSON lines (compressed: the
    lines repeat their field names and phrases) or Parquet.

    A compressed file is read by one task; ``rebalance`` cuts a large day into
    several files."""
    if fmt == "json":
        audit_line(events).hint("rebalance", "event_date") \
            .write.mode("append").partitionBy("event_date").option("compression", "gzip").text(path)
    else:
        events.withColumn("event_date", F.to_date("timestamp")).hint("rebalance", "event_date") \
            .write.mode("append").partitionBy("event_date").parquet(path)
    return path


def write_compliance(records: DataFrame, path: str) -> str:
    """SNK-2: compliance records routed to one folder per framework and day.

    ``records``: framework, timestamp, event_type, user_id, details (struct)."""
    out = records.select(
        "framework", F.to_date("timestamp").alias("event_date"),
        F.to_json(F.struct(
            F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
            "event_type", "user_id", "details")).alias("value"))
    out.hint("rebalance", "framework", "event_date") \
        .write.mode("append").partitionBy("framework", "event_date").text(path)
    return path
