"""The schedule of the mixture in independent ranges, and awkward rows."""

from __future__ import annotations

import random
from collections import Counter
from fractions import Fraction

import pytest

from govlake.llm import mixing


@pytest.mark.parametrize("slots", [1, 3, 8, 64])
def test_ranges_keep_every_block_in_its_window(slots):
    rnd = random.Random(slots)
    for case in range(150):
        blocks = {f"s{i}": rnd.randint(1, 60) for i in range(rnd.randint(1, 9))}
        weights = {s: rnd.choice([n ** 0.5, 1.0, 1e-2, 7.3, 100.0]) for s, n in blocks.items()}
        if case % 7 == 0 and len(weights) > 2:
            weights.pop("s0")
        got = list(mixing.schedule(blocks, weights, slots))
        assert Counter(got) == blocks
        for p in mixing.phases(blocks, weights):
            total, done = sum(p.shares.values()), dict.fromkeys(p.shares, 0)
            for t in range(p.length + (p.last is not None)):
                s = got[p.start + t]
                done[s] += 1
                w = Fraction(p.shares[s], total)
                assert (done[s] - 1) // w <= t < -(-done[s] // w)
                assert all(abs(done[x] - Fraction(p.shares[x] * (t + 1), total)) < 1 for x in done)


def test_cuts_agree_with_the_slots_before_them():
    blocks = {f"s{i}": 4000 + 911 * i for i in range(7)}
    weights = {s: n ** 0.5 for s, n in blocks.items()}
    phase = next(mixing.phases(blocks, weights))
    n, size = mixing.cuts(phase, 500)
    assert n > 20
    done = Counter()
    for k in range(n):
        assert mixing.placed(phase.shares, k * size) == {s: done[s] for s in blocks}
        done.update(mixing.range_slots(phase, k, 500))


def test_mixture_by_many_tasks_is_the_schedule(spark):
    df = spark.range(30_000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'a', concat('b', id % 5)) AS source")
    sizes = Counter(r.source for r in df.collect())
    blocks = {f"s:{s}": -(-n // 2) for s, n in sizes.items()}
    want = list(mixing.schedule(blocks, {s: sizes[s[2:]] ** 0.5 for s in blocks}, 200))
    got = {r.slot: f"s:{r.source}" for r in mixing.mix_sources(df, block_docs=2, slots=200).collect()}
    assert [got[t] for t in range(len(want))] == want and len(got) == len(want)


def test_equal_ids_keep_their_places_and_no_name_clashes(spark):
    rows = [(i % 40, "x" if i % 3 else None, f"text {i}", i, i, i, {"k": i}) for i in range(400)]
    schema = "doc_id bigint, source string, text string, bucket int, h int, row int, chunk map<string,int>"
    df = spark.createDataFrame(rows, schema)
    first = {(r.text, r.bucket, r.h, r.row, r.chunk["k"], r.position) for r in mixing.mix_sources(df).collect()}
    other = spark.createDataFrame(rows[::-1], schema).repartition(5)
    again = {(r.text, r.bucket, r.h, r.row, r.chunk["k"], r.position) for r in mixing.mix_sources(other).collect()}
    assert first == again and len(first) == 400 and len({x[-1] for x in first}) == 400
    assert mixing.mix_sources(df).columns == [*df.columns, "block", "slot", "position"]


def test_null_ids_and_a_table_of_ids_alone(spark):
    df = spark.createDataFrame([(None, None), (None, "a"), (1, "a")], "doc_id bigint, source string")
    assert sorted(r.position for r in mixing.mix_sources(df, block_docs=1).collect()) == [0, 1, 2]
