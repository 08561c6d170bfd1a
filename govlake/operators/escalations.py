"""Escalation tickets: creation, resolution, listing, statistics (ESC-1..6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.text import normalise_role, truncate
from ..plans import dimensions as D

TICKET_COLUMNS = ["id", "user_id", "input_text", "agent_reasoning", "confidence",
                  "created_at", "status", "resolved_at", "resolved_by", "resolution",
                  "metadata"]


def ticket_id_of(*cols: str):
    """Repeatable ticket id from a natural key (the reference draws a UUID)."""
    h = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in cols]), 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                       F.substring(h, 17, 4), F.substring(h, 21, 12))


def _ticket(df: DataFrame, id_col, user, text, reasoning, confidence, created, metadata=None):
    return df.select(
        id_col.alias("id"), user.alias("user_id"), text.alias("input_text"),
        reasoning.alias("agent_reasoning"), confidence.cast("double").alias("confidence"),
        created.alias("created_at"), F.lit("pending").alias("status"),
        F.lit(None).cast("timestamp_ntz").alias("resolved_at"),
        F.lit(None).cast("string").alias("resolved_by"),
        F.lit(None).cast("string").alias("resolution"),
        (metadata if metadata is not None else F.lit(None).cast("string")).alias("metadata"))


def tickets_from_decisions(decisions: DataFrame, text_col: str = "input_text") -> DataFrame:
    """ESC-1: requests whose decision is ``escalate`` become pending tickets
    with confidence 0.0 and the decision's reasoning."""
    e = decisions.filter(F.col("action") == "escalate")
    return _ticket(e, ticket_id_of("request_id"), F.col("user_id"), F.col(text_col),
                   F.col("reasoning"), F.lit(0.0), F.col("requested_at"))


def fraud_tickets(reports: DataFrame) -> DataFrame:
    """ESC-2: fraud reports (event_id, user_id, account_id, description,
    timestamp) become tickets with confidence 1.0 and JSON metadata."""
    desc = F.coalesce(F.col("description"), F.lit(""))
    return _ticket(
        reports, ticket_id_of("event_id"), F.col("user_id"),
        F.concat(F.lit("Fraud report for account "), F.col("account_id"), F.lit(": "), desc),
        F.lit("Fraud report - requires immediate human review"), F.lit(1.0),
        F.col("timestamp"),
        F.to_json(F.struct(F.col("account_id"), F.lit("fraud_report").alias("type"))))


def resolve_tickets(tickets: DataFrame, resolutions: DataFrame, roles: DataFrame):
    """ESC-3: apply a batch of resolutions.

    ``resolutions``: resolution_id, caller_id, ticket_id, note, resolved_at.
    Callers without resolve_escalations are denied.  Among allowed attempts
    the latest per ticket wins (an already resolved ticket is overwritten, as
    in the reference).  Returns (tickets after, attempts with outcome)."""
    spark = resolutions.sparkSession
    held = D.role_permission(spark).filter(F.col("permission") == "resolve_escalations") \
        .select(F.col("role").alias("caller_role"), F.lit(True).alias("_may"))
    r = resolutions.join(roles.select(F.col("user_id").alias("caller_id"), "role"),
                         "caller_id", "left") \
        .withColumn("caller_role", normalise_role("role")).drop("role") \
        .join(held, "caller_role", "left")
    known = tickets.select(F.col("id").alias("ticket_id"), F.lit(True).alias("_known"))
    r = r.join(known, "ticket_id", "left")
    outcome = (F.when(F.col("_may").isNull(), "denied")
               .when(F.col("_known").isNull(), "unknown_ticket").otherwise("resolved"))
    attempts = r.withColumn("outcome", outcome).drop("_may", "_known")
    ok = attempts.filter(F.col("outcome") == "resolved")
    # the latest attempt per ticket: an aggregation (partial before the
    # shuffle), so a ticket with very many attempts is not sorted in one task
    last = ok.groupBy("ticket_id").agg(F.max_by(
        F.struct("resolved_at", "caller_id", "note"),
        F.struct("resolved_at", "resolution_id")).alias("_l")).select(
        F.col("ticket_id").alias("id"), F.col("_l.resolved_at").alias("_at"),
        F.col("_l.caller_id").alias("_by"),
        truncate(F.col("_l.note"), S.TRUNCATE["resolution_note"]).alias("_note"))
    t = tickets.join(last, "id", "left")
    hit = F.col("_at").isNotNull()
    after = t.select(
        *[F.when(hit, F.lit("resolved")).otherwise(F.col("status")).alias("status") if c == "status"
          else F.when(hit, F.col("_at")).otherwise(F.col("resolved_at")).alias(c) if c == "resolved_at"
          else F.when(hit, F.col("_by")).otherwise(F.col("resolved_by")).alias(c) if c == "resolved_by"
          else F.when(hit, F.col("_note")).otherwise(F.col("resolution")).alias(c) if c == "resolution"
          else F.col(c) for c in tickets.columns])
    return after, attempts


def resolve_denials(attempts: DataFrame) -> DataFrame:
    """ESC-4: denied attempts become safety_block audit events."""
    d = attempts.filter(F.col("outcome") == "denied")
    return d.select(
        F.col("resolved_at").alias("timestamp"), F.lit("safety_block").alias("event_type"),
        F.col("caller_id").alias("user_id"), F.lit("resolve_ticket_unauthorized").alias("action"),
        F.lit(False).alias("success"), "ticket_id", F.col("caller_role").alias("role"))


def queue_stats(visible: DataFrame, callers: DataFrame | None = None) -> DataFrame:
    """ESC-5: per caller: total, pending, resolved and average confidence of
    the tickets the caller may see.  With ``callers`` (caller_id), callers
    who see no ticket get zeros and an average of 0.0, as the reference."""
    s = visible.groupBy("caller_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "pending").alias("pending"),
        F.count_if(F.col("status") == "resolved").alias("resolved"),
        F.avg(F.col("confidence").cast("double")).alias("_avg"))
    if callers is not None:
        s = callers.select("caller_id").distinct().join(s, "caller_id", "left")
    return s.select("caller_id", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
                                   for c in ("total", "pending", "resolved")],
                    F.round(F.coalesce(F.col("_avg"), F.lit(0.0)), 6).alias("avg_confidence"))


def queue_stats_all(tickets: DataFrame, roles: DataFrame) -> DataFrame:
    """ESC-5 for every user at once: privileged users see the whole queue, so
    they share one global aggregate; a plain user gets the aggregate of their
    own tickets.  No ticket is copied per caller; users without tickets get
    zeros and an average of 0.0."""
    stats = [F.count("*").alias("total"), F.count_if(F.col("status") == "pending").alias("pending"),
             F.count_if(F.col("status") == "resolved").alias("resolved"),
             F.avg(F.col("confidence").cast("double")).alias("avg")]
    own = tickets.groupBy("user_id").agg(*stats).select("user_id", F.struct(
        "total", "pending", "resolved", "avg").alias("_own"))
    whole = tickets.agg(*stats).select(F.struct("total", "pending", "resolved", "avg")).scalar()
    u = roles.select("user_id", normalise_role("role").alias("_role")).join(own, "user_id", "left") \
        .withColumn("_s", F.when(F.col("_role") == "user", F.col("_own")).otherwise(whole))
    return u.select(F.col("user_id").alias("caller_id"),
                    *[F.coalesce(F.col(f"_s.{c}"), F.lit(0)).cast("bigint").alias(c)
                      for c in ("total", "pending", "resolved")],
                    F.round(F.coalesce(F.col("_s.avg"), F.lit(0.0)), 6).alias("avg_confidence"))


def ticket_list(visible: DataFrame) -> DataFrame:
    """ESC-6: tickets (as ``access.visible_tickets`` gives them) numbered newest
    first in every caller's list; reasoning cut at 200 with "..."; resolver and
    note for resolved tickets, else confidence.

    A ticket stands in at most two lists: its owner's (``caller_id``) and the
    one of all tickets, which every privileged caller reads (``caller_id``
    null).  The second holds every ticket, so the numbering is a distributed
    ranking (range partitions plus offsets), not a window over one list."""
    from ..functions.ranking import range_row_numbers
    lists = F.when(F.col("own_caller").isNull(), F.array(F.lit(None).cast("string"))) \
        .otherwise(F.array(F.lit(None).cast("string"), F.col("own_caller")))
    visible = visible.withColumn("caller_id", F.explode(lists))
    visible = range_row_numbers(visible, ["caller_id"],
                                [F.col("created_at").desc(), F.col("id").desc()], "_n")
    reason = F.col("agent_reasoning")
    resolved = F.col("status") == "resolved"
    has_note = "resolution" in visible.columns
    note = F.col("resolution") if has_note else F.lit(None).cast("string")
    return visible.select(
        "caller_id", F.col("_n").alias("n"), "id", "user_id",
        F.date_format("created_at", "yyyy-MM-dd HH:mm").alias("created"),
        F.upper("status").alias("status_label"), "input_text",
        F.when(F.char_length(reason) > 200, F.concat(F.left(reason, F.lit(200)), F.lit("...")))
         .otherwise(reason).alias("reasoning"),
        F.when(resolved, F.col("resolved_by")).alias("resolved_by"),
        F.when(resolved, note).alias("resolution_note"),
        F.when(~resolved, F.col("confidence")).alias("confidence"))
