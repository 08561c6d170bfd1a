"""Property tests: the decision matrix equals a plain statement of its band
order on generated analyses (one Spark job for all examples)."""

from hypothesis import given, settings
from hypothesis import strategies as st

from govlake.operators import decisions

RULES = ["SAFETY-001", "SAFETY-002", "SAFETY-003", "SAFETY-004", "SAFETY-005", "COMP-001",
         "COMP-004", "COMP-005"]
score = st.one_of(st.none(), st.sampled_from([0.0, 0.1, 0.29, 0.3, 0.5, 0.59, 0.6, 0.69, 0.7,
                                              0.79, 0.8, 0.95, 1.0]))
analysis = st.tuples(st.sampled_from(["user", "staff", "admin", "system"]), score, score, score,
                     st.lists(st.sampled_from(RULES), max_size=3, unique=True),
                     st.booleans(), st.booleans())


def expected(role, s, c, conf, rules, intent, error):
    if s is None or c is None or conf is None or error:
        return "escalate"
    if "COMP-001" in rules:
        return "rewrite"
    if role in ("staff", "admin", "system") and intent:
        return "approve"
    if any(r in rules for r in ("SAFETY-001", "SAFETY-002", "SAFETY-003", "SAFETY-004")) or s < 0.3:
        return "reject"
    if conf < 0.7:
        return "escalate"
    if s >= 0.8 and c >= 0.8:
        return "approve"
    if intent and s >= 0.6 and c >= 0.6:
        return "rewrite"
    return "escalate"


@settings(max_examples=5, deadline=None)
@given(st.lists(analysis, min_size=30, max_size=60))
def test_decision_matrix_band_order(spark, rows):
    data = [(i, role, s, c, conf, rules, ["analysis_error"] if err else [], intent)
            for i, (role, s, c, conf, rules, intent, err) in enumerate(rows)]
    df = spark.createDataFrame(data, "request_id int, role string, safety_score double, "
                                     "compliance_score double, confidence double, "
                                     "violated_rules array<string>, risk_factors array<string>, "
                                     "banking_intent boolean")
    got = {r.request_id: r.action for r in decisions.decision_matrix(df).collect()}
    for i, (role, s, c, conf, rules, intent, err) in enumerate(rows):
        assert got[i] == expected(role, s, c, conf, rules, intent, err), rows[i]
