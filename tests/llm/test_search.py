"""Exact searches (R-tree, Voronoi join) and conversation repair against brute force."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpus_helpers import SF
from govlake.llm import conversations, hard_negatives, voronoi
from govlake.llm.integer_vectors import products
from govlake.llm.queries import REGISTRY

VECTORS = "vec_id bigint, embedding array<double>, label int, node string, cell string, score string, part int"


def whole(v):
    if v is None or any(x is None or not np.isfinite(x) for x in v):
        return None
    return [int(np.floor(256 * x)) for x in v]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def order(score, i):
    return -score, i is None, i


def frame(spark, rows):
    return spark.createDataFrame([(*r, "n", "c", "s", 3) for r in rows], VECTORS)


def awkward(rng, n=160, dim=6):
    rows = [(i, rng.normal(size=dim).tolist(), int(rng.integers(0, 4))) for i in range(n)]
    base = rows[0][1]
    rows += [(200 + i, base, 1) for i in range(40)]                     # a group of copies with ids of their own
    rows += [(0, base, rows[0][2])] * 8 + [(50, rows[50][1], 2)]        # repeated rows, one id on two labels
    rows += [(500, None, 1), (501, [None] + base[1:], 1), (502, [float("nan")] * dim, 1),
             (503, [float("inf")] * dim, 1), (550, [], 2), (600, [0.0] * dim, 2), (None, base, 1),
             (650, base[:3], 3), (700, base, None), (750, [200.5] * dim, 0)]
    return rows


def brute_top(rows, every, k):
    use = [(i, q) for i, v, _ in rows if (q := whole(v)) is not None]
    out = []
    for n, (i, q) in enumerate(use):
        if i is not None and i % every == 0:
            found = sorted(((dot(q, w), j) for m, (j, w) in enumerate(use) if m != n), key=lambda f: order(*f))[:k]
            out += [(i, r, j, s) for r, (s, j) in enumerate(found, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [16, 8192])
def test_top_k_equals_brute_force(spark, monkeypatch, size):
    for name in ("GROUP", "SLICE", "CELL"):
        monkeypatch.setattr(voronoi, name, size if name != "CELL" else 12)
    rows = awkward(np.random.default_rng(4))
    got = voronoi.top_k(frame(spark, rows), F.col("vec_id") % 10 == 0, 5).collect()
    assert sorted(map(tuple, got), key=str) == brute_top(rows, 10, 5)


def test_top_k_sends_only_what_is_needed(spark, monkeypatch):
    # far clusters: a group's rings exclude the rows of the others
    rng = np.random.default_rng(5)
    monkeypatch.setattr(voronoi, "GROUP", 16)
    monkeypatch.setattr(voronoi, "CELL", 32)
    centres = 4 * np.eye(8)
    rows = [(i, (centres[i % 8] + 0.05 * rng.normal(size=8)).tolist(), 0) for i in range(800)]
    sent = []
    solve = voronoi._solve
    monkeypatch.setattr(voronoi, "_solve", lambda q, d, k: sent.append(d.count()) or solve(q, d, k))
    got = voronoi.top_k(frame(spark, rows), F.col("vec_id") % 10 == 0, 3).collect()
    assert sorted(map(tuple, got), key=str) == brute_top(rows, 10, 3)
    assert sent[0] < 800 * 5 / 2


def test_top_k_small_tables(spark):
    empty = frame(spark, [])
    assert voronoi.top_k(empty, F.col("vec_id") % 10 == 0).collect() == []
    assert voronoi.top_k(frame(spark, [(10, None, 1)]), F.col("vec_id") % 10 == 0).collect() == []
    one = frame(spark, [(10, [1.0], 1), (3, [0.5, 2.0], 1)])
    assert [tuple(r) for r in voronoi.top_k(one, F.col("vec_id") % 10 == 0).collect()] == [(10, 1, 3, 256 * 128)]


def test_large_products_are_exact():
    a = np.array([[2.0 ** 40, 3.0], [1.0, 1.0]])
    assert products(a, a).tolist() == [[(1 << 63) - 1, 2 ** 40 + 3], [2 ** 40 + 3, 2]]
    b = np.array([[2.0 ** 30 + 1, 1.0]])
    assert products(b, b).tolist() == [[(2 ** 30 + 1) ** 2 + 1]]


def brute_negatives(rows, every, k=5):
    use = []
    for i, v, label in rows:
        q = whole(v)
        if q is not None and label is not None:
            use.append((i, q, (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    out = []
    for n, (i, q, label) in enumerate(use):
        if i is None or i % every:
            continue
        scored = [(dot(q, w), j, lab) for m, (j, w, lab) in enumerate(use) if m != n]
        for ps, p, _ in sorted((s for s in scored if s[2] == label), key=lambda f: order(*f[:2]))[:k]:
            kept = sorted((s for s in scored if s[2] != label and 80 * ps <= 100 * s[0] <= 100 * ps),
                          key=lambda f: order(*f[:2]))[:k]
            out += [(i, p, r, j, ps, s) for r, (s, j, _) in enumerate(kept, 1)]
    return sorted(out, key=str)


def mined(df, every):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % every == 0, label=label)
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("part,leaf,group", [(24, 4, 5), (8192, 128, 4096)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, part, leaf, group):
    for name, value in (("PART", part), ("LEAF", leaf), ("GROUP", group), ("ROOTS", 4)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = awkward(np.random.default_rng(6))
    assert mined(frame(spark, rows), 10) == brute_negatives(rows, 10)


def test_hard_negatives_small_tables(spark):
    assert mined(frame(spark, []), 10) == []
    assert mined(frame(spark, [(10, [1.0], 1), (11, [1.0], None)]), 10) == []
    rows = [(10, [1.0], 1), (20, [1.0], 1), (1, [0.9], 2), (2, [-1.0], 2)]
    assert mined(frame(spark, rows), 10) == brute_negatives(rows, 10) != []


def test_boxes_are_pruned():
    rng = np.random.default_rng(7)
    x = np.floor(256 * rng.normal(size=(12800, 3)) * [9, 3, 3])
    tree = hard_negatives._Tree(x)
    least, most = hard_negatives._interval(x[:1], tree.low, tree.high)
    true = products(x[:1], x)[0]
    for box, rows in enumerate(tree.inside[:tree.leaves]):
        assert least[0][box] <= true[rows].min() and true[rows].max() <= most[0][box]
    best, seen = hard_negatives._Best(-np.inf, np.inf, -np.inf, 5), []
    add = best.add
    best.add = lambda s, rows, w: seen.append(rows) or add(s, rows, w)
    hard_negatives._search(tree, x[0], least[0], most[0], np.ones(len(x), dtype=int), [best])
    assert sorted(s for s, _, _ in best.heap) == sorted(np.sort(true)[-5:].tolist())
    assert len(seen) < tree.leaves / 2


# ---- conversations ---------------------------------------------------------

def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        held = out.setdefault(conv, [])
        c, t, role, text = (" " if v is None else v for v in (conv, turn, role, text))
        kind = zlib.crc32(f"{c}:{t}".encode()) % 20
        if kind == 1:
            text = ""
        elif kind == 2:
            text = "".join(ch for ch in text if ch not in ".!?")
        elif kind == 4:
            role = "user"
        held += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0], x[1].encode(), x[2].encode())) for c, r in out.items()}


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        fault = ("blank" if not body else "duplicate" if (role, text) in seen
                 else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
        out.append(fault)
    return out


def fits(roles):
    s = "".join(r[:1] or "-" for r in roles)
    s = s[1:] if s[:1] == "s" else s
    return not roles or bool(s) and s == "ua" * (len(s) // 2)


def every_edit(rows, faults, inserts=2):
    """(cost, audit, repaired rows) of all edits with at most so many inserts in a row."""
    gaps = [g for n in range(inserts + 1) for g in itertools.product(("user", "assistant"), repeat=n)]

    def walk(i):
        for gap in gaps:
            head = [("I", 2, (r, "")) for r in gap]
            if i == len(rows):
                yield head
                continue
            _, role, text = rows[i]
            choices = [[("D", 3, None)]]
            if faults[i] not in ("blank", "duplicate"):
                extra = int(faults[i] == "truncated")
                choices += [[("K", extra, (role, text))]]
                choices += [[("R", 2 + extra, (r, text))] for r in ("user", "assistant")]
            for choice in choices:
                for rest in walk(i + 1):
                    yield head + choice + rest

    for edits in walk(0):
        left = [e[2] for e in edits if e[2] is not None]
        if fits([r for r, _ in left]):
            yield sum(e[1] for e in edits), "".join(e[0] for e in edits), left


def plain_best(rows, faults):
    """The same by whole strings: all states, no shared prefixes."""
    best = {"": (0, "", ())}

    def grow(held):
        for _ in range(2):
            for s, (c, a, t) in list(held.items()):
                role = "assistant" if s == "u" else "user"
                new = (c + 2, a + "I", t + ((role, ""),))
                if role[0] not in held or new < held[role[0]]:
                    held[role[0]] = new

    grow(best)
    for (_, role, text), fault in zip(rows, faults):
        new = {}
        for s, (c, a, t) in best.items():
            moves = [(s, c + 3, a + "D", t)]
            if fault not in ("blank", "duplicate"):
                c += fault == "truncated"
                if role and (s + role[0] in ("su", "ua", "au") or s == "" and role[0] in "su"):
                    moves.append((role[0], c, a + "K", t + ((role, text),)))
                put = "assistant" if s == "u" else "user"
                moves.append((put[0], c + 2, a + "R", t + ((put, text),)))
            for s2, *value in moves:
                if s2 not in new or tuple(value) < new[s2]:
                    new[s2] = tuple(value)
        best = new
        grow(best)
    return min(best[s] for s in ("", "a") if s in best)


def expected(rows):
    out = {}
    for conv, turns in damaged(rows).items():
        faults = faults_of(turns)
        cost, audit, left = plain_best(turns, faults) if turns else (0, "", ())
        known = [t for t, _, _ in turns if t is not None]
        initials = [r[:1] for _, r, _ in turns]
        out[conv] = (max(known) - min(known) + 1 - len(set(known)) if known else 0,
                     *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest())
    return out


def repaired(spark, rows):
    df = spark.createDataFrame([(*r, "x", 5, False) for r in rows],
                               "conv_id bigint, turn bigint, role string, text string, said string, copies int, whole boolean")
    out = conversations.repair(conversations.damage(df), df.select(F.col("conv_id").alias("conv")))
    return {r.conv: tuple(r)[1:] for r in out.collect()}


def chat(rng, conv, n):
    roles = ["system", "user", "assistant", "tool", "unknown", "", None]
    texts = ["Yes.", "No", "why?", " ", "", "Same!", None, "é ü.", "a\x0b"]
    return [(conv, rng.choice([t, t, t + 3, None]), rng.choice(roles[:3] * 4 + roles), rng.choice(texts * 2 + [f"t{t}."]))
            for t in range(n)]


def test_plain_best_is_the_best_of_all_edits():
    rng = random.Random(2)
    for n in range(40):
        rows = chat(rng, n, rng.randint(0, 4))
        turns = damaged(rows).get(n, [])[:3]
        faults = faults_of(turns)
        cost, audit, left = min(every_edit(turns, faults))
        assert plain_best(turns, faults)[:2] == (cost, audit)
        assert list(plain_best(turns, faults)[2]) == left


def test_repair_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [r for n in range(150) for r in chat(rng, n if n else None, rng.randint(1, 9))]
    rows += [(1000, None, "user", "Hi."), (1000, None, "assistant", "Yes."), (1001, 5, None, None)]
    rows += [(1002, t, "user", "Again.") for t in (1, 1, 1, 2, 9)]
    assert repaired(spark, rows) == expected(rows)


def test_long_conversations_are_chained(spark, monkeypatch):
    # segments of a few rows, ranges that cut conversations, one with most of all rows
    monkeypatch.setattr(conversations, "SEGMENT_ROWS", 5)
    monkeypatch.setattr(conversations, "SEGMENT_CHARS", 200)
    rng = random.Random(5)
    rows = [r for n in range(30) for r in chat(rng, n, rng.randint(1, 12))] + chat(rng, 77, 400)
    rows += [(78, t, "user" if t % 2 == 0 else "assistant", "x" * 300 + ".") for t in range(20)]
    assert repaired(spark, rows) == expected(rows)


def test_repair_empty(spark):
    assert repaired(spark, []) == {}


def test_audits_compare_like_strings():
    rng = random.Random(9)
    audits = conversations.Audits()
    nodes = {0: ""}
    for _ in range(400):
        parent = rng.choice(list(nodes))
        char = rng.choice("DIKR")
        nodes[audits.append(parent, char)] = nodes[parent] + char
    for _ in range(4000):
        a, b = rng.choice(list(nodes)), rng.choice(list(nodes))
        assert audits.less(a, b) == (nodes[a] < nodes[b])
    assert all(audits.text(n) == t for n, t in nodes.items())


def test_collisions_are_verified(monkeypatch):
    monkeypatch.setattr(conversations, "_MOD", 3)        # nearly all hashes are equal
    test_audits_compare_like_strings()


def test_registered_queries_run(spark):
    assert REGISTRY["op11_conversation_repair"](spark, SF).columns == [
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert dict(REGISTRY["op13_top_k"](spark, SF).dtypes) == {
        "query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
