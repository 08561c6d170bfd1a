"""Decisions on analysed requests (DEC-1 .. DEC-5).

The reference asks a hosted model to choose among overlapping bands.  Here
the bands are tested in one fixed order, written once as a CASE:
(1) no analysis or an analysis error -> escalate; (2) COMP-001 -> rewrite;
(3) staff/admin/system with banking intent -> approve; (4) a safety rule
whose action is reject, or safety < 0.3 -> reject; (5) confidence < 0.7 ->
escalate; (6) both scores >= 0.8 -> approve; (7) banking intent and both
scores >= 0.6 -> rewrite; (8) otherwise escalate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.text import mask_card_numbers

REJECT_RULES = [r[0] for r in S.RULES if r[1] == "safety" and r[4] == "reject"]
PRIVILEGED = ["staff", "admin", "system"]


def decision_matrix(analysis: DataFrame) -> DataFrame:
    """DEC-2: action and reasoning for every analysis.

    ``analysis``: request_id, role, safety_score, compliance_score,
    confidence, violated_rules (array), risk_factors (array), banking_intent."""
    s, c, conf = (F.col("safety_score").cast("double"), F.col("compliance_score").cast("double"),
                  F.col("confidence").cast("double"))
    rules = F.coalesce(F.col("violated_rules"), F.array().cast("array<string>"))
    risks = F.coalesce(F.col("risk_factors"), F.array().cast("array<string>"))
    intent = F.coalesce(F.col("banking_intent"), F.lit(False))
    missing = s.isNull() | c.isNull() | conf.isNull() | F.array_contains(risks, "analysis_error")
    reject_rule = F.arrays_overlap(rules, F.array(*[F.lit(r) for r in REJECT_RULES]))
    branch = (F.when(missing, 1)
              .when(F.array_contains(rules, "COMP-001"), 2)
              .when(F.col("role").isin(*PRIVILEGED) & intent, 3)
              .when(reject_rule | (s < S.REJECT_SAFETY_BELOW), 4)
              .when(conf < S.CONFIDENCE_MIN, 5)
              .when((s >= S.APPROVE_MIN) & (c >= S.APPROVE_MIN), 6)
              .when(intent & (s >= S.REWRITE_MIN) & (c >= S.REWRITE_MIN), 7)
              .otherwise(8))
    action = F.element_at(F.array(*[F.lit(a) for a in [
        "escalate", "rewrite", "approve", "reject", "escalate", "approve", "rewrite",
        "escalate"]]), branch)
    reasoning = F.element_at(F.array(*[F.lit(t) for t in [
        "Analysis missing or failed; escalating for human review.",
        "COMP-001: ask for the last 4 digits only.",
        "Privileged role with a legitimate banking request.",
        "Clear violation or very low safety score.",
        "Low confidence; escalating for human review.",
        "Safety and compliance scores are high with no blocking violation.",
        "Valid banking intent with phrasing concerns; rewriting.",
        "Ambiguous request or moderate safety concern."]]), branch)
    return analysis.withColumn("decision_rule", branch.cast("bigint")) \
        .withColumn("action", action).withColumn("reasoning", reasoning)


def safety_gate(layer1: DataFrame) -> DataFrame:
    """DEC-1: a failed layer-1 check stops the request; others continue."""
    return layer1.withColumn("gate", F.when(F.col("passed"), "continue").otherwise("blocked"))


def decision_counts(decisions: DataFrame) -> DataFrame:
    """DEC-3: requests per action and role, with per-action, per-role and
    grand totals (cube)."""
    return decisions.cube("role", "action").agg(
        F.count("*").alias("n"), F.grouping_id().cast("bigint").alias("grouping_level"))


def rule_rewrite(texts: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """DEC-4: texts that touch COMP-001 are rewritten to ask for the last
    four digits only; digit runs in them are masked."""
    from .rules import rule_hit
    hit = texts.filter(rule_hit(F.lower(F.col(text_col)), "COMP-001"))
    return hit.select(*keys, F.concat(
        F.lit("Please show only the last 4 digits. "),
        mask_card_numbers(text_col)).alias("rewritten_text"))


def escalate_low_confidence(analysis: DataFrame) -> DataFrame:
    """DEC-5: for each configured policy, requests whose confidence is below
    its threshold (a literal list of four, exploded per row, no join)."""
    th = F.array(*[F.struct(F.lit(n).alias("industry"), F.lit(v).alias("threshold"))
                   for n, v in S.INDUSTRY_CONFIDENCE])
    return analysis.select("*", F.explode(th).alias("_t")) \
        .filter(F.col("confidence").cast("double") < F.col("_t.threshold")) \
        .select(*analysis.columns, "_t.industry", "_t.threshold")


def request_screening(requests: DataFrame, keys: list[str], text_col: str, roles: DataFrame,
                      lexicon: DataFrame) -> DataFrame:
    """The whole screening of requests: layer 1 (SAF-2), gate (DEC-1), layer 2
    (SAF-7) and decision (DEC-2), one row per request.

    ``requests``: the keys, user_id and the text; a user without a role is a
    plain user.  A request that layer 1 stops has no layer-2 scores, decision
    rule 0 and action ``blocked``.  Columns: keys, user_id, role, hits, gate,
    the scores, violated_rules, risk_factors, banking_intent, decision_rule,
    action, reasoning."""
    from ..functions.joins import join_null_safe
    from ..functions.text import normalise_role
    from .rules import banking_intent, layer2_analysis
    from .textsafety import layer1_scores
    gate = safety_gate(layer1_scores(requests, keys, text_col, lexicon)) \
        .select(*keys, "hits", "gate", F.col("message").alias("_message"))
    # layer 2 reads the text of open requests only
    gated = join_null_safe(requests.select(*keys, "user_id", F.col(text_col).alias("_text")), gate, keys) \
        .withColumn("banking_intent", banking_intent(F.col("_text"))) \
        .withColumn("_open_text", F.when(F.col("gate") == "continue", F.col("_text")))
    two = layer2_analysis(gated, [*keys, "user_id", "hits", "gate", "_message", "banking_intent"], "_open_text") \
        .drop("analysis")
    who = roles.select("user_id", normalise_role("role").alias("role"))
    both = two.join(who, "user_id", "left") \
        .withColumn("role", F.coalesce("role", F.lit("user")))
    d = decision_matrix(both)
    open_ = F.col("gate") == "continue"
    return d.select(
        *keys, "user_id", "role", "hits", "gate",
        *[F.when(open_, F.col(c)).alias(c) for c in ("safety_score", "compliance_score", "confidence",
                                                     "violated_rules", "risk_factors")],
        "banking_intent",
        F.when(open_, F.col("decision_rule")).otherwise(F.lit(0)).cast("bigint").alias("decision_rule"),
        F.when(open_, F.col("action")).otherwise("blocked").alias("action"),
        F.when(open_, F.col("reasoning")).otherwise(F.col("_message")).alias("reasoning"))
