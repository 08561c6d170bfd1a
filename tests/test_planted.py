"""Checks that can fail: planted faults are found, and new reports against
plain Python."""

import datetime as dt
import random
from collections import Counter

import pytest

import __spark_entry__ as E
from govlake.operators import alerts, iam, metrics, rules, tables
from paths import SF_SMALL

T0 = dt.datetime(2024, 1, 1, 12)


def test_every_role_sees_its_tools(spark):
    calls = spark.createDataFrame([(1, "u", "view_audit"), (2, "x", "account_balance"), (3, "s", "account_balance")],
                                  "call_id long, user_id string, tool string")
    roles = spark.createDataFrame([("u", "user"), ("s", "staff"), ("v", "USER")], "user_id string, role string")
    got = {r.role: r for r in iam.tool_counts_by_role(calls, roles).collect()}
    assert {k: r.tools_visible for k, r in got.items()} == {"user": 11, "staff": 13, "admin": 13, "system": 13}
    u = got["user"]
    assert (u.users, u.calls, u.entitled_calls, u.denied_calls, u.tools_called) == (2, 2, 1, 1, 2)
    assert (got["admin"].users, got["admin"].calls) == (0, 0)


def test_weekly_costs(spark):
    rows = [(T0, "safety_layer2_analysis", "tool_call", 1000), (T0 + dt.timedelta(days=1), "safety_layer1_check", "x", 5),
            (T0 + dt.timedelta(days=7), "safety_layer2_analysis", "tool_call", 3000), (T0, "login", "x", None)]
    ev = spark.createDataFrame(rows, "timestamp timestamp_ntz, action string, event_type string, tokens int")
    got = {(r.week.day, r.section, r.item): r for r in metrics.weekly_costs(ev).collect()}
    first, second = got[1, "total", "all"], got[8, "total", "all"]
    assert (float(first.cost), first.n_events, first.prev_cost, first.change_pct) == (0.0021, 3, None, None)
    assert float(second.cost) == 0.006 and second.change_pct == round(100 * (0.006 - 0.0021) / 0.0021, 4)
    assert got[1, "model", "llm"].share == round(0.002 / 0.0021, 6) and got[1, "model", "none"].share == 0
    assert (8, "model", "none") not in got
    assert metrics.weekly_costs(ev.limit(0)).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_bulk_append_against_plain_python(spark, seed):
    rnd = random.Random(seed)
    keys = [None, *(f"k{i}" for i in range(40))]
    batch = [(rnd.choice(keys), rnd.choice(["p1", "p2", "p9", None]), rnd.choice([None, 1, 2]), rnd.choice("ab"))
             for _ in range(150)] + [("k3", "p1", 1, "a")] * 30
    old = {f"k{i}" for i in range(0, 40, 4)}

    def order(row):
        # nulls first, then the value, as Spark orders a struct
        return tuple((v is not None, 0 if v is None else v) for v in (row[2], row[0], row[1], row[3]))
    want, seen = Counter(), set()
    for row in sorted(batch, key=order):
        k, parent = row[:2]
        if k is None:
            status = "null_key"
        elif k in old:
            status = "duplicate_key"
        elif k in seen:
            status = "duplicate_in_batch"
        else:
            status = "accepted" if parent in ("p1", "p2") else "missing_parent"
        seen.add(k)
        want[(*row, status)] += 1
    df = spark.createDataFrame(batch, "id string, parent string, v int, note string")
    existing = spark.createDataFrame([(k,) for k in old] * 2, "id string")
    parents = spark.createDataFrame([("p1",), ("p2",), ("p2",)], "p string")
    got = tables.bulk_append(existing, df, "id", ["v"], [("parent", parents, "p")])
    assert Counter(tuple(r) for r in got.collect()) == want
    assert tables.bulk_append(existing, df.limit(0), "id", ["v"], [("parent", parents, "p")]).collect() == []


def test_backlog_by_day_is_the_largest_of_its_hours(spark):
    rnd = random.Random(3)
    rows = [(T0 + dt.timedelta(minutes=rnd.randrange(5000)), None) for _ in range(60)]
    rows = [(a, a + dt.timedelta(minutes=rnd.randrange(3000)) if rnd.random() < 0.7 else None) for a, _ in rows]
    t = spark.createDataFrame(rows, "created_at timestamp_ntz, resolved_at timestamp_ntz")
    by_day = {r.window_start.date(): r.max_pending for r in alerts.backlog(t, "day").collect()}
    hours = {}
    for r in alerts.backlog(t, "hour").collect():
        hours.setdefault(r.window_start.date(), []).append(r.max_pending)
    assert by_day == {d: max(v) for d, v in hours.items()}


def test_amounts_are_hit_and_evidence(spark):
    t = spark.createDataFrame([(1, "pay $5 or $12,000.50 then $99999"), (2, "pay $10,000"), (3, None), (4, "")],
                              "id long, text string")
    got = [(r.id, r.rule_id, r.evidence) for r in rules.rule_matches(t, ["id"], "text").collect()
           if r.rule_id == "COMP-004"]
    assert len(got) == 1 and got[0][0] == 1 and "12,000.50" in got[0][2]


def test_planted_faults_are_found(spark):
    q = E.queries()
    status = Counter(r.status for r in q["transfer_leg_faults"](spark, SF_SMALL).collect())
    assert {"ok", "missing_leg", "duplicate_leg", "unbalanced"} == set(status)
    assert q["brute_force_retries"](spark, SF_SMALL).count() > 0
    assert q["exfiltration_p90"](spark, SF_SMALL).count() > 1
    assert q["unlogged_access_gaps"](spark, SF_SMALL).filter("success").count() > 0


def test_verbose_shows_transfer_fields(spark):
    rows = E.queries()["audit_verbose"](spark, SF_SMALL).filter("transaction_id is not null").collect()
    assert rows and all(r.amount is not None and r.from_account and r.to_account and r.summary for r in rows)
    assert any(r.summary.endswith("...") for r in rows)
