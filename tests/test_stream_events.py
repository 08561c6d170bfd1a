"""Streams over several micro-batches, the transfer fold by day summaries, the
log by day, sketches: against plain Python on small tables."""

import datetime as dt
import glob
import os
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from govlake.operators import ledger, metrics, tables
from govlake.plans.queries import REGISTRY
from govlake.sources import audit_log
from govlake.sources.sinks import write_audit
from govlake.streaming import alert_events, late, sessions, streams
from paths import SF_SMALL

T0 = dt.datetime(2024, 3, 1, 8)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def audit(spark, rows):
    """Audit events from (event_id, user_id, minutes, event_type, action, success)."""
    return spark.createDataFrame(
        [(i, u, None if m is None else at(m), e, a, ok) for i, u, m, e, a, ok in rows],
        "event_id bigint, user_id string, timestamp timestamp_ntz, event_type string, action string, success boolean")


def drive(spark, path, parts, make, **options):
    for part in parts:
        write_audit(audit(spark, part), path + "/log", fmt="json")
        streams.run_available_now(make(streams.follow(spark, path + "/log")), path + "/out", path + "/ck",
                                  state_store=streams.ROCKSDB, **options)
    return spark.read.parquet(path + "/out")


def test_late_rows_by_the_querys_own_watermark(spark, tmp_path):
    path = str(tmp_path)
    parts = [[(1, "a", 0, "x", "x", True), (2, "a", 60, "x", "x", True)],
             [(3, "a", 50, "x", "x", True), (4, "a", 51, "x", "x", True), (5, "a", None, "x", "x", True)],
             [(6, "a", 50, "x", "x", True), (7, "a", 200, "x", "x", True)],
             [(8, "a", 190, "x", "x", True), (9, "a", 191, "x", "x", True)]]
    marks = []
    for part in parts:
        write_audit(audit(spark, part), path + "/log", fmt="json")
        ev = streams.follow(spark, path + "/log").select(
            "event_time", F.try_variant_get("details", "$.event_id", "bigint").alias("event_id"))
        q = late.follow_late(ev, path + "/out", path + "/ck")
        marks += [p["eventTime"].get("watermark") for p in q.recentProgress if p["numInputRows"]]
    # at or before the watermark is late
    assert {r.event_id for r in late.late_rows(spark, path + "/out").collect()} == {3, 6, 8}
    assert {r.event_id for r in late.late_rows(spark, path + "/out", late=False).collect()} == {1, 2, 4, 5, 7, 9}
    ledger_rows = sorted(late.late_ledger(spark, path + "/out").collect())
    assert [(r.n_rows, r.n_late) for r in ledger_rows] == [(2, 0), (3, 1), (2, 1), (2, 1)]
    # and the watermark is the one Spark reports for the query
    own = [None if m is None or m.startswith("1970") else dt.datetime.fromisoformat(m.rstrip("Z")[:19]) for m in marks]
    assert own == [r.watermark for r in ledger_rows]


def test_replayed_batch_splits_alike(spark, tmp_path):
    path = str(tmp_path)
    batch = audit(spark, [(1, "a", 5, "x", "x", True), (2, "a", 100, "x", "x", True)]) \
        .withColumn("event_time", F.col("timestamp").cast("timestamp"))
    later = audit(spark, [(3, "a", 50, "x", "x", True)]).withColumn("event_time", F.col("timestamp").cast("timestamp"))
    split = late.split_late(path)
    split(batch, 0)
    for _ in range(2):
        split(later, 1)
    assert [r.event_id for r in late.late_rows(spark, path).collect()] == [3]
    assert [(r.n_rows, r.n_late) for r in sorted(late.late_ledger(spark, path).collect())] == [(2, 0), (1, 1)]


def test_sessions_open_merge_and_close(spark, tmp_path):
    parts = [[(1, "a", 0, "x", "x", True), (2, "a", 30, "safety_block", "x", True), (3, "b", 5, "x", "x", True),
              (4, None, 5, "x", "x", True), (10, "a", 115, "x", "x", True)],
             # an event inside the watermark joins two open sessions of a
             [(5, "a", 88, "x", "x", True), (11, "a", 118, "x", "x", True), (6, "b", 110, "x", "x", True)]]
    # the watermark is held back so that nothing closes early
    changes = drive(spark, str(tmp_path), parts, lambda ev: sessions.session_changes(ev, 60, "3 hours"))
    got = {(r.user_id, r.start_time, r.end_time, r.interactions, r.safety_blocks, r.state)
           for r in sessions.current_sessions(changes).collect()}
    assert got == {("a", at(0), at(118), 5, 1, "active"), ("b", at(5), at(5), 1, 0, "active"),
                   ("b", at(110), at(110), 1, 0, "active")}
    assert {r.state for r in changes.collect()} == {"active", "merged"}


def test_sessions_equal_gaps_over_restarts(spark, tmp_path):
    rng = random.Random(4)
    rows = sorted((rng.randint(0, 3000), f"u{rng.randint(0, 5)}") for _ in range(200))
    rows = [(n, u, m, "safety_block" if n % 7 == 0 else "x", "x", True) for n, (m, u) in enumerate(rows)]
    changes = drive(spark, str(tmp_path), [rows[:70], rows[70:150], rows[150:]], sessions.session_changes)
    got = sorted((r.user_id, r.start_time, r.end_time, r.interactions, r.safety_blocks, r.state)
                 for r in sessions.current_sessions(changes).collect())
    want = []
    for user in sorted({r[1] for r in rows}):
        open_ = None
        for _, u, m, e, _, _ in rows:
            if u != user:
                continue
            if open_ is None or m - open_[1] > 60:
                open_ = [m, m, 0, 0]
                want.append((user, open_))
            open_[1], open_[2], open_[3] = m, open_[2] + 1, open_[3] + (e == "safety_block")
    mark = max(r[2] for r in rows) - 10
    assert got == sorted((u, at(s), at(e), n, b, "closed" if e + 60 <= mark else "active") for u, (s, e, n, b) in want)


def test_session_state_is_kept_by_bucket(spark, tmp_path):
    """However many users and sessions, the state is at most a row per bucket and what closes leaves it."""
    users = [f"u{n}" for n in range(3 * 40)]
    # two sessions of each user closed by the last part, one open after it
    parts = [[(n, u, m, "x", "x", True) for n, u in enumerate(users) for m in (0, 100)],
             [(n, u, 500, "safety_block", "x", True) for n, u in enumerate(users)]]
    buckets, sessions.USER_BUCKETS = sessions.USER_BUCKETS, 4
    try:
        changes = drive(spark, str(tmp_path), parts, sessions.session_changes)
    finally:
        sessions.USER_BUCKETS = buckets
    got = sorted((r.user_id, r.start_time, r.end_time, r.interactions, r.safety_blocks, r.state)
                 for r in sessions.current_sessions(changes).collect())
    assert got == sorted((u, at(m), at(m), 1, int(m == 500), "active" if m == 500 else "closed")
                         for u in users for m in (0, 100, 500))
    state = spark.read.format("statestore").option("stateVarName", "sessions").load(str(tmp_path / "ck"))
    rows = [r.value for r in state.select("value").collect()]
    assert 0 < len(rows) <= 4
    assert sorted(u for r in rows for u in r.users) == sorted(users)


def test_alert_is_raised_once_and_cleared_once(spark, tmp_path):
    quiet = [(n, "u", 5 * n, "x", "x", True) for n in range(60)]
    burst = [(100 + n, "u", 120 + n, "auth_failure", "login", False) for n in range(12)]
    rows = sorted(quiet + burst, key=lambda r: r[2])
    parts = [[r for r in rows if r[2] < 100], [r for r in rows if 100 <= r[2] < 126], [r for r in rows if r[2] >= 126]]
    got = sorted((r.rule, r.window_end, r.event, r.level)
                 for r in drive(spark, str(tmp_path), parts, alert_events.alert_edges).collect())
    # the burst is in twelve overlapping windows and more; each level is told once
    assert [(g[0], g[2], g[3]) for g in got] == [("error_rate", "raised", "critical"), ("error_rate", "cleared", "ok")]
    assert got[0][1] <= at(130) and got[1][1] == at(195)


# ---- transfers -----------------------------------------------------------------

def test_transfer_stream_keeps_requests_without_a_time(spark, tmp_path):
    for name in ("customer", "orders", "lineitem"):
        df = spark.read.parquet(f"{SF_SMALL}/{name}.parquet")
        if name == "lineitem":
            df = df.withColumn("l_shipdate", F.when(F.col("l_orderkey") % 9 > 0, F.col("l_shipdate")))
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    cols = ["l_orderkey", "l_linenumber", "from_account_id", "to_account_id", "amount", "status", "src_balance_after",
            "dst_balance_after"]
    got = REGISTRY["stream_transfers"](spark, str(tmp_path)).select(*cols).collect()
    batch = REGISTRY["transfer_apply"](spark, str(tmp_path)).filter(F.col("status").isin("accepted", "insufficient_funds"))
    assert batch.filter("requested_at is null").count() > 0
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch.select(*cols).collect()))


def test_transfer_state_is_kept_by_bucket(spark, tmp_path):
    """Two restarts against a plain fold; the state is at most a row per bucket."""
    rng, path = random.Random(3), str(tmp_path)
    owners = [f"o{n}" for n in range(60)]
    opening = {(o, f"{o}-{n}"): Decimal(rng.choice(["0", "50.00", "900.10", "-3"])) for o in owners for n in range(3)}
    accounts = spark.createDataFrame([(a, o, b) for (o, a), b in opening.items()],
                                     "account_id string, user_id string, balance decimal(18,2)")
    rows = []
    for n in range(600):
        o = rng.choice(owners)
        source, target = rng.sample(range(3), 2)
        rows.append((n, 1, T0 + dt.timedelta(minutes=n // 5), o, f"{o}-{source}", f"{o}-{target}",
                     Decimal(rng.randint(1, 40000)) / 100))
    schema = ("l_orderkey bigint, l_linenumber int, requested_at timestamp_ntz, requester_id string, "
              "from_account_id string, to_account_id string, amount decimal(18,2)")
    buckets, streams.OWNER_BUCKETS = streams.OWNER_BUCKETS, 4
    try:
        for part in (rows[:300], rows[300:]):
            mixed = rng.sample(part, len(part))
            spark.createDataFrame(mixed, schema).write.mode("append").parquet(path + "/requests")
            stream = spark.readStream.schema(schema).parquet(path + "/requests")
            streams.run_available_now(streams.transfers(stream, accounts), path + "/out", path + "/ck",
                                      state_store=streams.ROCKSDB)
    finally:
        streams.OWNER_BUCKETS = buckets
    held, want = dict(opening), []
    for order, line, _, o, source, target, amount in rows:
        ok = held[o, source] >= amount
        if ok:
            held[o, source] -= amount
            held[o, target] += amount
        want.append((order, line, o, source, target, amount, "accepted" if ok else "insufficient_funds",
                     held[o, source], held[o, target]))
    assert sorted(map(tuple, spark.read.parquet(path + "/out").collect())) == want
    got = {(r.user_id, r.account_id): r.balance for r in streams.balances_in_state(spark, path + "/ck").collect()}
    assert got == held
    state = spark.read.format("statestore").option("stateVarName", "balances").load(path + "/ck")
    assert 0 < state.count() <= 4


REQUESTS = ("l_orderkey bigint, l_linenumber int, requested_at timestamp_ntz, requester_id string, "
            "from_account_id string, to_account_id string, amount decimal(18,2), src_balance decimal(18,2), "
            "dst_balance decimal(18,2), outcome string")


@pytest.mark.parametrize("busy", [0, 150, 10**6])
def test_transfers_by_day_equal_the_plain_fold(spark, busy):
    rng = random.Random(8)
    opening = {f"{o}-{n}": Decimal(rng.choice(["0", "50.00", "900.10", "-3"])) for o in "abcd" for n in range(3)}
    opening |= {f"rich-{n}": Decimal("1000000") for n in range(3)}
    rows = []
    for n in range(600):
        owner = "rich" if n % 3 == 0 else rng.choice("abcd")
        src, dst = rng.sample([a for a in opening if a.startswith(f"{owner}-")], 2)
        day = None if rng.random() < 0.02 else at(1440 * rng.randint(0, 20))
        row = (rng.randint(0, 50), 1, day, owner, src, dst, Decimal(rng.randint(1, 30000)) / 100,
               opening[src], opening[dst], rng.choice(["ok", "ok", "insufficient_funds", "access_denied_source"]))
        rows += [row] * rng.choice([1, 1, 1, 3])
    pre = spark.createDataFrame(rows, REQUESTS)
    got = [tuple(r) for r in ledger.transfer_apply(pre, busy_requests=busy).collect()]
    balance, want = dict(opening), []

    def order(r):
        return (r[2] is not None, r[2] or T0, r[0], r[1], r[4], r[5], r[6])

    for r in sorted(rows, key=order):
        if r[9] not in ("ok", "insufficient_funds"):
            want.append((*r[:2], r[2], r[3], r[4], r[5], r[6], r[9], None, None))
            continue
        done = balance[r[4]] >= r[6]
        if done:
            balance[r[4]], balance[r[5]] = balance[r[4]] - r[6], balance[r[5]] + r[6]
        want.append((*r[:7], "accepted" if done else "insufficient_funds", balance[r[4]], balance[r[5]]))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_solvent_owner_needs_no_fold(spark):
    day = F.lit("2024-01-01").cast("date") + (F.col("id") % 50).cast("int")
    live = spark.range(3000).select(
        F.lit("rich").alias("requester_id"), day.alias("_day"), F.lit("rich-0").alias("from_account_id"),
        F.lit("rich-1").alias("to_account_id"), F.lit(100).cast("bigint").alias("amount_cents"),
        F.lit(10**9).cast("bigint").alias("src_cents"), F.lit(0).cast("bigint").alias("dst_cents"))
    pieces = ledger._owner_pieces(live)
    assert pieces.filter(F.col("start") < F.col("out")).count() == 0
    assert pieces.count() == 100            # one row per account and day, whatever the requests


# ---- tickets -------------------------------------------------------------------

TICKET_EVENTS = ("kind string, id string, user_id string, input_text string, agent_reasoning string, confidence double, "
                 "created_at timestamp_ntz, event_time_ntz timestamp_ntz, actor string, seq bigint")


def ticket_batch(spark, creates=(), resolves=()):
    rows = [("create", i, "u", "t", "r", 0.5, at(m), at(m), None, None) for i, m in creates]
    rows += [("resolve", i, None, None, None, None, None, at(m), who, n) for n, (i, m, who) in enumerate(resolves)]
    return spark.createDataFrame(rows, TICKET_EVENTS)


def test_ticket_batch_opens_only_its_days(spark, tmp_path):
    path = str(tmp_path / "tickets")
    merge = streams.merge_ticket_batch(path)
    merge(ticket_batch(spark, [("t1", 0), ("t2", 1440)], [("t9", 5000, "early")]), 0)
    assert [r.id for r in streams.waiting_resolutions(spark, path).collect()] == ["t9"]
    # the first day cannot be read any more; a batch for other days does not notice
    for name in glob.glob(f"{path}/created_day=2024-03-01/*.parquet"):
        with open(name, "wb") as f:
            f.write(b"broken")
    merge(ticket_batch(spark, [("t9", 2880)], [("t2", 3000, "admin"), ("t2", 2000, "other")]), 1)
    merge(ticket_batch(spark, [("t9", 2880)], [("t2", 3000, "admin")]), 1)        # replayed
    schema = "id string, status string, resolved_at timestamp_ntz, resolved_by string, created_day date"
    rows = spark.read.schema(schema).parquet(path).filter(F.col("created_day") > "2024-03-01").collect()
    assert sorted((r.id, r.status, r.resolved_at, r.resolved_by) for r in rows) == [
        ("t2", "resolved", at(3000), "admin"), ("t9", "resolved", at(5000), "early")]
    assert streams.waiting_resolutions(spark, path).count() == 0
    assert glob.glob(f"{path}_staging/*") == []


# ---- log, sketches, tiers --------------------------------------------------------

def test_one_day_of_a_log_prunes_folders(spark, tmp_path):
    path = str(tmp_path)
    write_audit(audit(spark, [(n, "u", 700 * n, "x", "x", True) for n in range(8)]), path)
    assert audit_log.log_days(spark, path) == ["2024-03-01", "2024-03-02", "2024-03-03", "2024-03-04"]
    newest = audit_log.read_audit_day(spark, path)
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and "= 2024-03-04" in plan
    assert newest.count() == 2
    assert audit_log.read_audit_day(spark, path, "2024-03-02").count() == 2
    assert audit_log.read_audit_day(spark, path, "2020-01-01").count() == 0
    assert audit_log.read_audit_day(spark, path + "/none").count() == 0


def test_dropped_lines_are_counted_and_kept(spark, tmp_path):
    log, out = tmp_path / "log", str(tmp_path / "out")
    log.mkdir()
    (log / "log.jsonl").write_text('{"event_type": "a", "success": 0}\n\n  \n{"broken\n[1]\n3\n{"event_type": "b"}\n')
    audit_log.ingest_log(spark, str(log), out)
    assert sorted((r.event_type, r.success) for r in audit_log.ingested_events(spark, out).collect()) == [
        ("a", False), ("b", True)]
    assert audit_log.ingest_counts(spark, out).first().asDict() == {
        "n_lines": 7, "n_kept": 2, "n_blank": 2, "n_not_json": 1, "n_not_object": 2}
    assert sorted(r.dropped_line for r in audit_log.dropped_lines(spark, out).collect()) == [
        "", "  ", "3", "[1]", '{"broken']


@pytest.mark.parametrize("n", [1, 50, 40000])
def test_merged_sketches_keep_their_bound(spark, n, tmp_path):
    ev = spark.range(n).select(
        (F.lit(T0) + F.make_dt_interval((F.col("id") % 40).cast("int"))).cast("timestamp_ntz").alias("timestamp"),
        F.lit("x").alias("event_type"), F.lit("safety_layer1_check").alias("action"),
        F.pow(F.rand(3), F.lit(4)).alias("latency_ms"))
    ev.write.parquet(str(tmp_path / "events"))
    ev = spark.read.parquet(str(tmp_path / "events"))
    merged = metrics.merged_percentiles(metrics.latency_sketches(ev))
    checked = metrics.sketch_rank_errors(merged, ev).collect()
    assert checked and all(r.p50_within and r.p95_within and r.p99_within and r.n_events == r.n_sketch for r in checked)


def test_day_written_again_leaves_its_former_tier(spark, tmp_path):
    path = str(tmp_path)
    rows = audit(spark, [(1, "u", 0, "x", "x", True)])
    tables.write_tiers(rows, "timestamp", T0 + dt.timedelta(days=1), path)
    assert os.listdir(f"{path}/tier=hot") == ["event_date=2024-03-01"]
    tables.write_tiers(rows, "timestamp", T0 + dt.timedelta(days=20), path)
    assert [(r.tier, r.event_id) for r in spark.read.parquet(path).collect()] == [("warm", 1)]


def test_move_stopped_half_way_goes_on(spark, tmp_path):
    path = str(tmp_path)
    rows = audit(spark, [(n, "u", 1440 * n, "x", "x", True) for n in range(40)])
    tables.write_tiers(rows, "timestamp", T0 + dt.timedelta(days=2), path)
    later = T0 + dt.timedelta(days=45)
    todo = tables.pending_moves(spark, path, later)
    assert {m[1:] for m in todo} == {("hot", "warm"), ("hot", "cold")}
    # a mover that died after five days
    for day, name, tier in todo[:5]:
        os.makedirs(f"{path}/tier={tier}", exist_ok=True)
        os.rename(f"{path}/tier={name}/event_date={day}", f"{path}/tier={tier}/event_date={day}")
    assert tables.pending_moves(spark, path, later) == todo[5:]
    assert tables.move_tiers(spark, path, later) == todo[5:]
    assert tables.pending_moves(spark, path, later) == [] == tables.move_tiers(spark, path, later)
    got = {r.event_id: r.tier for r in spark.read.parquet(path).collect()}
    assert len(got) == 40 and got == {n: "hot" if n >= 39 else "warm" if n >= 16 else "cold" for n in range(40)}


def test_a_day_in_two_tiers_is_never_deleted(spark, tmp_path):
    path = str(tmp_path)
    rows = audit(spark, [(1, "u", 0, "x", "x", True)])
    tables.write_tiers(rows, "timestamp", T0 + dt.timedelta(days=1), path)
    os.makedirs(f"{path}/tier=warm/event_date=2024-03-01")
    with pytest.raises(OSError, match="write it again"):
        tables.move_tiers(spark, path, T0 + dt.timedelta(days=20))
    assert os.listdir(f"{path}/tier=hot") == ["event_date=2024-03-01"]
    tables.write_tiers(rows, "timestamp", T0 + dt.timedelta(days=20), path)
    assert [(r.tier, r.event_id) for r in spark.read.parquet(path).collect()] == [("warm", 1)]
