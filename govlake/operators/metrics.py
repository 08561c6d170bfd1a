"""Usage, errors, latency and cost over the audit log (MET-1 .. MET-10,
WIN-3 .. WIN-5).  The reference documents these and codes none of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ts_ntz

from .. import schemas as S
from ..functions.joins import join_null_safe
from ..functions.quantiles import exact_percentiles
from ..functions.sessions import sessionize

LLM_ACTIONS = ["safety_layer2_analysis", "safety_decision_made"]
ML_ACTIONS = ["safety_layer1_check"]
TOOL_EVENTS = ["tool_call", "account_access", "transaction_query"]
# Cost per token of a language-model call and per machine-learning check (USD).
LLM_COST_PER_TOKEN = "0.000002"
ML_COST_PER_CALL = "0.0001"
COST = "decimal(18,8)"


def stage() -> Column:
    """Step of the request pipeline an event belongs to."""
    a, e = F.col("action"), F.col("event_type")
    return (F.when(a.isin(*ML_ACTIONS), "safety_check").when(a.isin(*LLM_ACTIONS), "llm_call")
            .when(e.isin(*TOOL_EVENTS), "tool_call").otherwise("other"))


def model() -> Column:
    a = F.col("action")
    return F.when(a.isin(*LLM_ACTIONS), "llm").when(a.isin(*ML_ACTIONS), "ml").otherwise("none")


def cost() -> Column:
    a = F.col("action")
    return (F.when(a.isin(*LLM_ACTIONS), F.col("tokens") * F.lit(LLM_COST_PER_TOKEN).cast(COST))
            .when(a.isin(*ML_ACTIONS), F.lit(ML_COST_PER_CALL).cast(COST))
            .otherwise(F.lit(0).cast(COST))).cast(COST)


def latency_percentiles(events: DataFrame) -> DataFrame:
    """MET-1: exact p50, p95, p99 of latency per stage and end to end."""
    staged = events.select(stage().alias("stage"), "latency_ms")
    every = events.select(F.lit("end_to_end").alias("stage"), "latency_ms")
    return exact_percentiles(staged.unionByName(every), ["stage"], "latency_ms",
                             [0.5, 0.95, 0.99], digits=4)


#: Accuracy of the latency sketches, and the rank error it keeps (one side).
SKETCH_K = 800
SKETCH_RANK_ERROR = 0.01
SKETCH_PS = (0.5, 0.95, 0.99)
PERIODS = ("day", "week", "month")


def latency_sketches(events: DataFrame) -> DataFrame:
    """MET-1 for large data: one KLL sketch of the latencies per (day, stage),
    a few kilobytes each.  Stored, they answer for any longer period by merging;
    a new day is added without reading an older event."""
    e = events.filter(F.col("latency_ms").isNotNull()).select(
        F.to_date("timestamp").alias("day"), stage().alias("stage"), F.col("latency_ms").cast("double").alias("ms"))
    return e.groupBy("day", "stage").agg(F.kll_sketch_agg_double("ms", F.lit(SKETCH_K)).alias("sketch"))


def merged_percentiles(sketches: DataFrame, periods=PERIODS) -> DataFrame:
    """(period, start, stage, n, p50_ms, p95_ms, p99_ms) from sketches alone."""
    spans = F.explode(F.array(*[F.struct(F.lit(p).alias("period"), F.to_date(F.date_trunc(p, "day")).alias("start"))
                                for p in periods]))
    merged = sketches.select(spans.alias("s"), "stage", "sketch").groupBy("s.period", "s.start", "stage") \
        .agg(F.kll_merge_agg_double("sketch", F.lit(SKETCH_K)).alias("sketch"))
    return merged.select("period", "start", "stage", F.kll_sketch_get_n_double("sketch").alias("n"), *[
        F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(f"p{round(100 * p)}_ms") for p in SKETCH_PS])


def sketch_rank_errors(percentiles: DataFrame, events: DataFrame) -> DataFrame:
    """Each percentile's true ranks (the shares of events below and up to it)
    against SKETCH_RANK_ERROR; equal latencies are counted first."""
    days = events.filter(F.col("latency_ms").isNotNull()).groupBy(
        F.to_date("timestamp").alias("day"), stage().alias("stage"), F.col("latency_ms").cast("double").alias("ms")) \
        .agg(F.count("*").alias("k"))
    out = None
    for period in PERIODS:
        asked = percentiles.filter(F.col("period") == period)
        values = days.withColumn("start", F.to_date(F.date_trunc(period, "day")))
        met = join_null_safe(values, asked, ["start", "stage"])
        checks = []
        for p in SKETCH_PS:
            name = f"p{round(100 * p)}"
            below = F.sum(F.when(F.col("ms") < F.col(f"{name}_ms"), F.col("k")).otherwise(0)) / F.sum("k")
            upto = F.sum(F.when(F.col("ms") <= F.col(f"{name}_ms"), F.col("k")).otherwise(0)) / F.sum("k")
            checks.append(((below <= p + SKETCH_RANK_ERROR) & (upto >= p - SKETCH_RANK_ERROR)).alias(f"{name}_within"))
        part = met.groupBy(F.lit(period).alias("period"), "start", "stage").agg(
            F.sum("k").alias("n_events"), F.max("n").alias("n_sketch"), *checks)
        out = part if out is None else out.unionByName(part)
    return out


def request_volume(events: DataFrame) -> DataFrame:
    """MET-2: requests per minute, hour and day in one pass (each event is
    expanded into its three buckets before one aggregation)."""
    b = F.array(*[F.struct(F.lit(g).alias("grain"), F.date_trunc(g, "timestamp").cast("timestamp_ntz").alias("bucket"))
                  for g in ("minute", "hour", "day")])
    return events.select(F.explode(b).alias("b")).groupBy("b.grain", "b.bucket") \
        .agg(F.count("*").alias("n"))


DAILY_TYPES = ["safety_block", "escalation_created", "tool_call"]


def daily_event_volume(events: DataFrame) -> DataFrame:
    """MET-3: safety blocks, escalations and tool calls per day (pivot over
    fixed values, so no extra pass to find them)."""
    p = events.filter(F.col("event_type").isin(*DAILY_TYPES)) \
        .groupBy(F.to_date("timestamp").alias("day")).pivot("event_type", DAILY_TYPES).count()
    return p.select("day", *[F.coalesce(F.col(t), F.lit(0)).cast("bigint").alias(t)
                             for t in DAILY_TYPES])


def error_breakdown(events: DataFrame) -> DataFrame:
    """MET-4: errors per day by class."""
    ok = F.coalesce(F.col("success"), F.lit(True))
    a, e = F.coalesce(F.col("action"), F.lit("")), F.col("event_type")
    return events.groupBy(F.to_date("timestamp").alias("day")).agg(
        F.count_if((e == "safety_block") | (a.startswith("safety_") & ~ok))
        .alias("failed_safety_checks"),
        F.count_if(e.isin(*TOOL_EVENTS) & ~ok).alias("failed_tool_calls"),
        F.count_if(a.isin(*LLM_ACTIONS) & ~ok).alias("model_errors"),
        F.count_if(a.contains("failed")).alias("database_errors"),
        F.count_if(e == "auth_failure").alias("access_denials"),
        F.count("*").alias("events"))


def accounts_accessed_daily(events: DataFrame) -> DataFrame:
    """MET-5: distinct accounts accessed and fraud reports per day."""
    acc = F.when(F.col("event_type") == "account_access", F.col("account_id"))
    return events.groupBy(F.to_date("timestamp").alias("day")).agg(
        F.count_distinct(acc).alias("accounts_accessed"),
        F.count_if(F.col("action") == "fraud_report").alias("fraud_reports"))


def accounts_accessed_daily_approx(events: DataFrame, rsd: float = 0.02) -> DataFrame:
    """MET-5, large-data variant: HyperLogLog distinct count."""
    acc = F.when(F.col("event_type") == "account_access", F.col("account_id"))
    return events.groupBy(F.to_date("timestamp").alias("day")).agg(
        F.approx_count_distinct(acc, rsd).alias("accounts_accessed"),
        F.count_if(F.col("action") == "fraud_report").alias("fraud_reports"))


def _tool() -> Column:
    m = F.create_map(*[x for k, v in S.ACTION_TOOL.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[F.col("action")], F.lit("none"))


def cost_rollup(events: DataFrame) -> DataFrame:
    """MET-6: cost per user, day, month, tool and model, and in total
    (grouping sets, one pass, partial aggregation)."""
    c = events.select("user_id", F.to_date("timestamp").alias("day"),
                      F.date_format("timestamp", "yyyy-MM").alias("month"),
                      _tool().alias("tool"), model().alias("model"), cost().alias("cost"))
    keys = ["user_id", "day", "month", "tool", "model"]
    sets = [[F.col(k)] for k in keys] + [[]]
    return c.groupingSets(sets, *keys).agg(
        F.sum("cost").cast("decimal(38,8)").alias("total_cost"), F.count("*").alias("n_events"),
        F.grouping_id().cast("bigint").alias("grouping_level"))


def sessions(events: DataFrame, gap_minutes: int = S.SESSION_GAP_MINUTES) -> DataFrame:
    """MET-7: gap sessions per user with start, end (last event),
    interactions, tools used, safety blocks, escalations and cost.

    Two levels, so a very active user is not one task: events are cut into
    (user, hour) buckets, each bucket into pieces at gaps and every piece is
    aggregated; the pieces of a user (their number is bounded by the hours
    covered, not by the events) are then chained into sessions.  Events
    without a time form one piece of their own per user, with a null start."""
    gap = F.expr(f"INTERVAL {int(gap_minutes)} MINUTES")
    e = events.select("user_id", "timestamp", "event_type", _tool().alias("tool"),
                      cost().alias("cost"), F.date_trunc("hour", "timestamp").alias("_hour"))
    w = Window.partitionBy("user_id", "_hour").orderBy("timestamp")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = F.coalesce(F.col("timestamp") > F.lag("timestamp").over(w) + gap,
                        F.row_number().over(w) == 1)
    pieces = e.withColumn("_new", starts.cast("int")) \
        .withColumn("_piece", F.sum("_new").over(upto)) \
        .groupBy("user_id", "_hour", "_piece").agg(
            F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"),
            F.count("*").alias("interactions"),
            F.array_sort(F.collect_set(F.when(F.col("tool") != "none", F.col("tool"))))
            .alias("tools"),
            F.count_if(F.col("event_type") == "safety_block").alias("safety_blocks"),
            F.count_if(F.col("event_type") == "escalation_created").alias("escalations"),
            F.sum("cost").alias("cost"))
    w = Window.partitionBy("user_id").orderBy("start_time")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chained = pieces.withColumn("_new", F.coalesce(
        F.col("start_time") > F.lag("end_time").over(w) + gap, F.lit(True)).cast("int")) \
        .withColumn("_session", F.sum("_new").over(upto))
    # the distinct tool lists of a session are subsets of the fixed tool names
    s = chained.groupBy("user_id", "_session").agg(
        F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"),
        F.sum("interactions").alias("interactions"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("tools")))), ",")
        .alias("tools_used"),
        F.sum("safety_blocks").alias("safety_blocks"), F.sum("escalations").alias("escalations"),
        F.sum("cost").cast("decimal(38,8)").alias("total_cost"))
    return s.select(F.concat(F.col("user_id"), F.lit("-"),
                             F.date_format("start_time", "yyyyMMddHHmmss")).alias("session_id"),
                    "user_id", "start_time", "end_time", "interactions", "tools_used",
                    "safety_blocks", "escalations", "total_cost")


def daily_report(events: DataFrame, tickets: DataFrame, top_n: int = 3) -> DataFrame:
    """MET-8: one long table (day, section, item, value): total requests, top
    users, top tools, safety blocks by category, compliance violations by
    rule, escalations by reason.

    One pass over the events: each event is expanded into the (section,
    item) pairs it counts for, and one aggregation (partial before the
    shuffle) counts them all; the top-n cut runs on the small aggregate."""
    e = F.col("event_type")
    pairs = F.array(
        F.struct(F.lit("total_requests").alias("section"), F.lit("all").alias("item")),
        F.struct(F.lit("top_users").alias("section"), F.col("user_id").alias("item")),
        F.when(e.isin(*TOOL_EVENTS), F.struct(F.lit("top_tools").alias("section"),
                                              _tool().alias("item"))),
        F.when(e == "safety_block", F.struct(F.lit("blocks_by_category").alias("section"),
                                             F.col("risk_category").alias("item"))),
        F.when(e == "compliance_violation", F.struct(
            F.lit("violations_by_rule").alias("section"), F.col("violated_rule").alias("item"))))
    ev = events.select(F.to_date("timestamp").alias("day"), F.explode(pairs).alias("p")) \
        .filter(F.col("p").isNotNull()).select("day", "p.section", "p.item")
    tk = tickets.select(F.to_date("created_at").alias("day"),
                        F.lit("escalations_by_reason").alias("section"),
                        F.col("agent_reasoning").alias("item"))
    g = ev.unionByName(tk).groupBy("day", "section", "item").agg(F.count("*").alias("value"))
    w = Window.partitionBy("day", "section").orderBy(F.col("value").desc(), F.col("item"))
    ranked = g.withColumn("_r", F.when(F.col("section").isin("top_users", "top_tools"),
                                       F.row_number().over(w)))
    return ranked.filter(F.col("_r").isNull() | (F.col("_r") <= top_n)).drop("_r")


def system_health(events: DataFrame, tickets: DataFrame, as_of,
                  window_minutes: int = 60) -> DataFrame:
    """MET-9: error rate, average latency, safety blocks, request count over
    the last window before ``as_of``, pending queue size, and a colour (red:
    error rate over 10 %; yellow: over 5 % or block rate over 20 %)."""
    now = ts_ntz(as_of)
    lo = now - F.expr(f"INTERVAL {window_minutes} MINUTES")
    last = events.filter((F.col("timestamp") >= lo) & (F.col("timestamp") < now))
    ok = F.coalesce(F.col("success"), F.lit(True))
    m = last.agg(F.count("*").alias("requests"), F.count_if(~ok).alias("errors"),
                 F.count_if(F.col("event_type") == "safety_block").alias("safety_blocks"),
                 F.round(F.avg(F.col("latency_ms").cast("double")), 4).alias("avg_latency_ms"))
    queue = tickets.filter((F.col("status") == "pending") & (F.col("created_at") < now)) \
        .agg(F.count("*")).scalar()
    j = m.withColumn("queue_size", queue)
    err = F.round(F.try_divide(F.col("errors"), F.col("requests")), 6)
    blk = F.round(F.try_divide(F.col("safety_blocks"), F.col("requests")), 6)
    return j.select("requests", "errors", err.alias("error_rate"), "avg_latency_ms",
                    "safety_blocks", "queue_size",
                    F.when(err > 0.10, "red").when((err > 0.05) | (blk > 0.20), "yellow")
                    .otherwise("green").alias("health"))


def latency_trace_rollup(events: DataFrame, gap_minutes: int = S.SESSION_GAP_MINUTES) -> DataFrame:
    """MET-10: per request trace (a user's gap session), total latency and
    each step's and child step's share of it."""
    s = sessionize(events.select("event_id", "user_id", "timestamp", "action", "event_type",
                                 "latency_ms"), gap_minutes)
    g = s.groupBy("user_id", "session_start", stage().alias("step"),
                  F.coalesce("action", F.lit("unknown")).alias("child_step")) \
        .agg(F.sum("latency_ms").cast("decimal(38,2)").alias("child_ms"))
    w_req = Window.partitionBy("user_id", "session_start")
    w_step = Window.partitionBy("user_id", "session_start", "step")
    return g.select(
        F.concat(F.col("user_id"), F.lit("-"), F.date_format("session_start", "yyyyMMddHHmmss"))
        .alias("request_id"), "step", "child_step", "child_ms",
        F.sum("child_ms").over(w_step).alias("step_ms"),
        F.sum("child_ms").over(w_req).alias("total_ms")) \
        .withColumn("step_share", F.round(F.try_divide(F.col("step_ms").cast("double"),
                                                        F.col("total_ms").cast("double")), 6)) \
        .withColumn("child_share", F.round(F.try_divide(F.col("child_ms").cast("double"),
                                                         F.col("total_ms").cast("double")), 6))


def weekly_trends(events: DataFrame) -> DataFrame:
    """WIN-3: events per week and type, with the change on the week before."""
    g = events.groupBy(F.date_trunc("week", "timestamp").cast("timestamp_ntz").alias("week"), "event_type") \
        .agg(F.count("*").alias("n"))
    w = Window.partitionBy("event_type").orderBy("week")
    prev = F.lag("n").over(w)
    return g.withColumn("prev_n", prev).withColumn("change", F.col("n") - F.col("prev_n")) \
        .withColumn("change_pct", F.round(F.try_divide((F.col("n") - F.col("prev_n")) * 100.0,
                                                        F.col("prev_n")), 4))


def weekly_costs(events: DataFrame) -> DataFrame:
    """WIN-3, cost analysis of the weekly report: cost, events, cost per event
    and share of the week's cost for every tool, every model and in total, with
    the change on the week before.

    Each event counts for three items in one aggregation (partial before the
    shuffle); the windows run over one row per week and item.  A week in which an
    item has no event has no row, and ``prev_cost`` is that of the item's last
    week with one."""
    item = F.array(F.struct(F.lit("total").alias("section"), F.lit("all").alias("item")),
                   F.struct(F.lit("tool").alias("section"), _tool().alias("item")),
                   F.struct(F.lit("model").alias("section"), model().alias("item")))
    g = events.select(F.date_trunc("week", "timestamp").cast("timestamp_ntz").alias("week"),
                      F.explode(item).alias("i"), cost().alias("cost")) \
        .groupBy("week", "i.section", "i.item").agg(
            F.sum("cost").cast("decimal(38,8)").alias("cost"), F.count("*").alias("n_events"))
    c = F.col("cost").cast("double")
    w_item = Window.partitionBy("section", "item").orderBy("week")
    w_week = Window.partitionBy("week", "section")
    g = g.withColumn("prev_cost", F.lag("cost").over(w_item)) \
        .withColumn("_week_cost", F.sum("cost").over(w_week).cast("double"))
    prev = F.col("prev_cost").cast("double")
    return g.select(
        "week", "section", "item", "cost", "n_events",
        F.round(c / F.col("n_events"), 8).alias("cost_per_event"),
        F.round(F.try_divide(c, F.col("_week_cost")), 6).alias("share"),
        "prev_cost", F.round(F.try_divide((c - prev) * 100, prev), 4).alias("change_pct"))


def daily_cost(events: DataFrame) -> DataFrame:
    return events.groupBy(F.to_date("timestamp").alias("day")).agg(F.sum(cost()).cast("decimal(38,8)").alias("cost"))


def cost_spike_days(events: DataFrame, factor: float = 2.0) -> DataFrame:
    """WIN-4: days whose cost is more than ``factor`` times the average of the
    earlier days.  The window runs over one row per day (a small frame)."""
    d = daily_cost(events)
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    avg_before = F.avg(F.col("cost").cast("double")).over(w)
    return d.withColumn("avg_before", F.round(avg_before, 8)) \
        .withColumn("spike", F.col("cost").cast("double") > F.lit(factor) * F.col("avg_before"))


def volume_anomalies(events: DataFrame, days: int = 7, k: float = 3.0) -> DataFrame:
    """WIN-5: daily counts per type outside mean +/- k standard deviations of
    the previous ``days`` days (our rule)."""
    g = events.groupBy(F.to_date("timestamp").alias("day"), "event_type") \
        .agg(F.count("*").alias("n"))
    w = Window.partitionBy("event_type").orderBy("day").rowsBetween(-days, -1)
    mean, sd = F.avg("n").over(w), F.stddev_samp("n").over(w)
    return g.withColumn("mean_prev", F.round(mean, 6)).withColumn("sd_prev", F.round(sd, 6)) \
        .withColumn("anomaly", F.coalesce(
            (F.col("n") > F.col("mean_prev") + k * F.col("sd_prev"))
            | (F.col("n") < F.col("mean_prev") - k * F.col("sd_prev")), F.lit(False)))
