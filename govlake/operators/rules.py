"""Rule matching and layer-2 analysis (SAF-6, SAF-7).

The rule patterns are fixed values, so each rule becomes a column expression
over the lower-case text: ``contains`` for literal phrases, ``rlike`` with a
literal pattern (compiled once per task) for real patterns.  All rules are
tested in one code-generated projection: no join against a rule table, no
shuffle.  COMP-004 compares amounts: the texts' dollar amounts are read as
numbers, whatever their grouping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S

_RULE = {r[0]: r for r in S.RULES}


def rule_regex(rule_id: str) -> str:
    return "(" + "|".join(S.RULE_PATTERNS[rule_id]) + ")"


_META = set("[](){}*+?.\\|^$")


def _is_literal(p: str) -> bool:
    return not any(ch in _META for ch in p)


def over_amounts(low: Column) -> Column:
    """The dollar amounts of the text above ``HIGH_VALUE_AMOUNT``, as written
    and in their order; doubles hold every length of number."""
    found = F.regexp_extract_all(low, F.lit(S.RULE_PATTERNS["COMP-004"][0]), F.lit(0))
    return F.filter(found, lambda m: F.regexp_replace(m, "[$ ,]", "").try_cast("double")
                    > S.HIGH_VALUE_AMOUNT)


def rule_evidence(low: Column, rule_id: str) -> Column:
    """The leftmost phrase that touches the rule, null if none does."""
    if rule_id == "COMP-004":
        return F.when(low.contains("$"), F.get(over_amounts(low), 0))
    return F.when(rule_hit(low, rule_id), F.regexp_extract(low, rule_regex(rule_id), 0))


def rule_hit(low: Column, rule_id: str) -> Column:
    """Does the lower-case text touch the rule?  Literal phrases are byte
    searches (``contains``); only real patterns run the regex engine.  Same
    answer as ``rlike`` of the rule's alternation."""
    if rule_id == "COMP-004":
        return low.contains("$") & (F.size(over_amounts(low)) > 0)
    tests = [low.contains(p) if _is_literal(p) else low.rlike(p)
             for p in S.RULE_PATTERNS[rule_id]]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


RULE_IDS = list(S.RULE_PATTERNS)


def rule_flags(texts: DataFrame, text_col: str) -> DataFrame:
    """Adds ``_h<i>`` (does the text touch rule i) and ``_e<i>`` (its
    evidence: the leftmost match of the rule's alternation, only on a hit).

    ``lower(text)`` is computed once per row by common subexpression
    elimination.  The amounts of COMP-004 are read once, in a projection before
    the flags: an amount found is both the hit and its evidence."""
    low = F.lower(F.col(text_col))
    texts_cols = texts.columns
    read = texts.select("*", rule_evidence(low, "COMP-004").alias("_amount"))
    cols = []
    for i, rid in enumerate(RULE_IDS):
        if rid == "COMP-004":
            cols += [F.col("_amount").isNotNull().alias(f"_h{i}"), F.col("_amount").alias(f"_e{i}")]
        else:
            cols += [rule_hit(low, rid).alias(f"_h{i}"), rule_evidence(low, rid).alias(f"_e{i}")]
    return read.select(*texts_cols, *cols)


def rule_matches(texts: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """SAF-6: one row per (text, rule) the text touches, with the evidence
    phrase (the leftmost match)."""
    f = rule_flags(texts.select(*keys, text_col), text_col)
    items = []
    for i, rid in enumerate(RULE_IDS):
        _, _, category, severity, action, _, _ = _RULE[rid]
        items.append(F.when(F.col(f"_h{i}"), F.struct(
            F.lit(rid).alias("rule_id"), F.lit(category).alias("category"),
            F.lit(severity).alias("severity"), F.lit(action).alias("action"),
            F.col(f"_e{i}").alias("evidence"))))
    return f.select(*keys, F.explode(F.array(*items)).alias("m")) \
        .filter(F.col("m").isNotNull()) \
        .select(*keys, "m.rule_id", "m.category", "m.severity", "m.action", "m.evidence")


def _csv(pairs: list[tuple[str, str]]) -> Column:
    """Comma list of the labels whose flag is set, in the given order."""
    return F.concat_ws(",", *[F.when(F.col(flag), F.lit(label)) for flag, label in pairs])


def _as_array(c: Column) -> Column:
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, ","))


def layer2_analysis(texts: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """SAF-7: per text, safety and compliance score = 1 minus the severity
    weight of the worst matched rule of that kind (critical 1.0, high 0.7,
    medium 0.4), confidence (0.9 with no match, 0.8 with one rule, 0.6 with
    more), sorted violated rules and risk factors, and a one-line analysis."""
    f = rule_flags(texts.select(*keys, text_col), text_col)

    def worst(kind: str) -> Column:
        ws = [F.when(F.col(f"_h{i}"), F.lit(S.SEVERITY_WEIGHT[_RULE[rid][3]]))
              for i, rid in enumerate(RULE_IDS) if _RULE[rid][1] == kind]
        return F.round(1 - F.coalesce(F.greatest(*ws, F.lit(None).cast("double")),
                                      F.lit(0.0)), 2)

    by_id = sorted((f"_h{i}", rid) for i, rid in enumerate(RULE_IDS))
    by_id = sorted(by_id, key=lambda x: x[1])
    by_cat = sorted(((f"_h{i}", _RULE[rid][2]) for i, rid in enumerate(RULE_IDS)),
                    key=lambda x: x[1])
    n = sum(F.col(f"_h{i}").cast("int") for i in range(len(RULE_IDS)))
    rules_csv = _csv(by_id)
    return f.select(
        *keys, worst("safety").alias("safety_score"), worst("compliance").alias("compliance_score"),
        F.when(n == 0, 0.9).when(n == 1, 0.8).otherwise(0.6).alias("confidence"),
        _as_array(rules_csv).alias("violated_rules"), _as_array(_csv(by_cat)).alias("risk_factors"),
        F.when(n == 0, F.lit("No rule matched"))
         .otherwise(F.concat(F.lit("Matched: "), F.regexp_replace(rules_csv, ",", ", ")))
        .alias("analysis"))


# Words of a banking request (ours): any of them shows a banking intent.
BANKING_WORDS = ["account", "balance", "transaction", "transfer", "payment"]


def banking_intent(text: Column) -> Column:
    low = F.lower(text)
    out = F.lit(False)
    for w in BANKING_WORDS:
        out = out | low.contains(w)
    return F.coalesce(out, F.lit(False))
