"""Alert windows (STR-4 .. STR-8 in batch form).  The same column logic runs
on streams in ``govlake.streaming``; thresholds are the reference's
documented bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import exact_percentiles

FRAUD_SPIKE_MIN = 10          # more than 10 fraud reports in one hour
ERROR_WARN, ERROR_CRIT = 0.05, 0.10
BLOCK_WARN = 0.20
LATENCY_P95_MS = 5000
BACKLOG_MAX = 100
FINE_BUCKETS = ("second", "minute", "hour")


def _window(duration: str, slide: str | None = None) -> Column:
    w = F.window("timestamp", duration, slide) if slide else F.window("timestamp", duration)
    return w.alias("w")


def fraud_spike_counts(events: DataFrame, duration="1 hour", slide="5 minutes") -> DataFrame:
    """STR-4: fraud reports per sliding window, flagged above the bound."""
    f = events.filter(F.col("action") == "fraud_report")
    g = f.groupBy(_window(duration, slide)).agg(F.count("*").alias("fraud_reports"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "fraud_reports",
                    (F.col("fraud_reports") > FRAUD_SPIKE_MIN).alias("alert"))


def error_rate_levels(events: DataFrame, duration="1 hour") -> DataFrame:
    """STR-5: error rate per window: warn over 5 %, critical over 10 %."""
    ok = F.coalesce(F.col("success"), F.lit(True))
    g = events.groupBy(_window(duration)).agg(F.count("*").alias("requests"),
                                              F.count_if(~ok).alias("errors"))
    rate = F.round(F.try_divide(F.col("errors").cast("double"), F.col("requests")), 6)
    return g.select(F.col("w.start").alias("window_start"), "requests", "errors",
                    rate.alias("error_rate"),
                    F.when(rate > ERROR_CRIT, "critical").when(rate > ERROR_WARN, "warning")
                    .otherwise("ok").alias("level"))


def block_rate_levels(events: DataFrame, duration="1 hour") -> DataFrame:
    """STR-6: share of events that are safety blocks (by event type, since
    blocks are logged as successes, K35): warn over 20 %."""
    g = events.groupBy(_window(duration)).agg(
        F.count("*").alias("requests"),
        F.count_if(F.col("event_type") == "safety_block").alias("blocks"))
    rate = F.round(F.try_divide(F.col("blocks").cast("double"), F.col("requests")), 6)
    return g.select(F.col("w.start").alias("window_start"), "requests", "blocks",
                    rate.alias("block_rate"),
                    F.when(rate > BLOCK_WARN, "warning").otherwise("ok").alias("level"))


def latency_levels(events: DataFrame, duration="1 hour") -> DataFrame:
    """STR-7 (batch): exact p95 latency per window; warn above 5 s."""
    w = events.select(F.window("timestamp", duration).start.alias("window_start"), "latency_ms")
    p = exact_percentiles(w, ["window_start"], "latency_ms", [0.95], ["p95_ms"], digits=4)
    return p.select("window_start", F.col("n").alias("requests"), "p95_ms",
                    F.when(F.col("p95_ms") > LATENCY_P95_MS, "warning").otherwise("ok")
                    .alias("level"))


def backlog(tickets: DataFrame, bucket: str = "hour") -> DataFrame:
    """STR-8 (batch): pending tickets after every create (+1) and resolve
    (-1) event, exactly, with the largest backlog per ``bucket`` and an alert
    above 100.

    Events of one moment are counted first (creates come before resolves, so
    the highest value after an event of a moment is the backlog before it plus
    its creates, or less one where it has none).  Running sums then go over
    the moments of a second, the seconds of an hour and the buckets, so the
    largest window has a bounded number of rows whatever the number of tickets."""
    moments = tickets.select(F.explode(F.array(
        F.struct(F.col("created_at").alias("ts"), F.lit(1).alias("up"), F.lit(0).alias("down")),
        F.struct(F.col("resolved_at").alias("ts"), F.lit(0).alias("up"), F.lit(1).alias("down"))))
        .alias("e")).filter("e.ts is not null").groupBy("e.ts") \
        .agg(F.sum("e.up").alias("up"), F.sum(F.col("e.up") - F.col("e.down")).alias("net"))
    level = moments.withColumns({
        "peak": F.when(F.col("up") > 0, F.col("up")).otherwise(-1),
        "second": F.date_trunc("second", "ts").cast("timestamp_ntz"),
        "hour": F.date_trunc("hour", "ts").cast("timestamp_ntz"),
        "bucket": F.date_trunc(bucket, "ts").cast("timestamp_ntz")})

    def lifted(x: DataFrame, keys: list[str], order: str) -> DataFrame:
        """Peaks and sums per ``keys`` of rows that follow each other by ``order``."""
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        x = x.withColumn("before", F.coalesce(F.sum("net").over(w), F.lit(0)))
        return x.groupBy(*keys).agg(F.max(F.col("before") + F.col("peak")).alias("peak"),
                                    F.sum("net").alias("net"))

    per = lifted(level, ["bucket", "hour", "second"], "ts")
    if bucket in FINE_BUCKETS:      # one hour holds the whole bucket
        per = lifted(per, ["bucket"], "second")
    else:
        per = lifted(lifted(per, ["bucket", "hour"], "second"), ["bucket"], "hour")
    per = per.withColumnRenamed("peak", "max_local")
    w_b = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("before", F.coalesce(F.sum("net").over(w_b), F.lit(0)))
    return per.select(F.col("bucket").alias("window_start"),
                      (F.col("before") + F.col("max_local")).cast("bigint").alias("max_pending"),
                      (F.col("before") + F.col("net")).cast("bigint").alias("pending_at_end"),
                      ((F.col("before") + F.col("max_local")) > BACKLOG_MAX).alias("alert"))
