"""STR-4 to STR-7 as events: an alert is raised once, changed when its level
changes and cleared once, however many overlapping windows show it.

Two stateful operators in one query: counts per sliding window (append mode, so
a window counts once the watermark has passed it), then an edge detector that
keeps the last level of each rule.  Windows leave the first operator in the
order of their ends from batch to batch, so the detector sees each rule's
windows in order.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import alerts as AL
from .streams import WATERMARK

OUT = "rule string, window_end timestamp, event string, level string, previous_level string, value double"
_NAMES = [c.split()[0] for c in OUT.split(", ")]


def rule_levels(requests: Column, errors: Column, blocks: Column, slow: Column, timed: Column,
                fraud: Column) -> Column:
    """The rules of a window as (rule, level, value).  More than 5 % of timed
    requests over the latency bound is a p95 above it."""
    def share(part: Column, whole: Column) -> Column:
        return F.coalesce(F.round(F.try_divide(part.cast("double"), whole), 6), F.lit(0.0))

    def rule(name: str, value: Column, level: Column) -> Column:
        return F.struct(F.lit(name).alias("rule"), level.alias("level"), value.alias("value"))

    error, block, late = share(errors, requests), share(blocks, requests), share(slow, timed)
    count = fraud.cast("double")
    return F.array(
        rule("error_rate", error, F.when(error > AL.ERROR_CRIT, "critical")
             .when(error > AL.ERROR_WARN, "warning").otherwise("ok")),
        rule("block_rate", block, F.when(block > AL.BLOCK_WARN, "warning").otherwise("ok")),
        rule("latency_p95", late, F.when(late > 0.05, "warning").otherwise("ok")),
        rule("fraud_spike", count, F.when(count > AL.FRAUD_SPIKE_MIN, "critical").otherwise("ok")))


class EdgeDetector(StatefulProcessor):
    """The last level of a rule; a row for every change of it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.level = handle.getValueState("level", "level string")

    def handleInputRows(self, key, rows, timerValues):
        windows = sorted(w for chunk in rows for w in zip(chunk["window_end"], chunk["level"], chunk["value"]))
        last = self.level.get()[0] if self.level.exists() else "ok"
        out = []
        for end, level, value in windows:
            if level != last:
                event = "raised" if last == "ok" else "cleared" if level == "ok" else "changed"
                out.append((key[0], end, event, level, last, value))
                last = level
        self.level.update((last,))
        yield pd.DataFrame(out, columns=_NAMES)

    def close(self) -> None:
        pass


def alert_edges(events: DataFrame, duration: str = "1 hour", slide: str = "5 minutes",
                delay: str = WATERMARK) -> DataFrame:
    """Alert events of a stream of audit events."""
    latency = F.try_variant_get(F.col("details"), "$.latency_ms", "double")
    ok = F.coalesce(F.col("success"), F.lit(True))
    windows = events.withWatermark("event_time", delay).groupBy(
        F.window("event_time", duration, slide).alias("w")).agg(
        F.count("*").alias("requests"), F.count_if(~ok).alias("errors"),
        F.count_if(F.col("event_type") == "safety_block").alias("blocks"),
        F.count_if(latency > AL.LATENCY_P95_MS).alias("slow"), F.count(latency).alias("timed"),
        F.count_if(F.col("action") == "fraud_report").alias("fraud"))
    rules = windows.select(F.col("w.end").alias("window_end"), F.explode(rule_levels(
        *(F.col(c) for c in ("requests", "errors", "blocks", "slow", "timed", "fraud")))).alias("r"))
    return rules.select("window_end", "r.rule", "r.level", "r.value").groupBy("rule") \
        .transformWithStateInPandas(EdgeDetector(), OUT, "Append", "None")
