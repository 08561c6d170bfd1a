"""Embeddings, mixing, components, the pipeline and the rules they keep."""

import pathlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpus_helpers import SF
from govlake.llm import embeddings, graph, mixing
from govlake.llm.queries import ORACLE_SQL, REGISTRY


def brute_links(rows, threshold=0.9):
    ok = [(i, np.array(v, dtype=float)) for i, v in rows
          if i is not None and v and None not in v and np.isfinite(np.array(v, dtype=float)).all() and any(v)]
    links = {i: set() for i, _ in rows}
    for n, (i, x) in enumerate(ok):
        for j, y in ok[n + 1:]:
            if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links[i].add(j)
                links[j].add(i)
    comp = {}
    for i in sorted(k for k in links if k is not None):
        if i in comp:
            continue
        todo = [i]
        while todo:
            k = todo.pop()
            if k not in comp:
                comp[k] = i
                todo += links[k]
    return {i: (len(links[i]), comp[i]) for i in comp}


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(150)]
    base = rng.normal(size=16)
    rows += [(1000 + i, (base + 0.05 * rng.normal(size=16)).tolist()) for i in range(80)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] * 16), (2004, [1.0] + [None] * 15),
             (2005, [float("inf")] + [1.0] * 15), (2006, (base * 7).tolist()), (2007, (base * 1e-100).tolist())]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<double>, component string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect()}
    assert got == brute_links(rows)


def test_embeddings_empty_and_null_ids(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert embeddings.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    df = spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0]), (None, None)], schema)
    got = sorted((str(r.vec_id), r.n_links, r.kept) for r in embeddings.near_duplicates(df).collect())
    assert got == [("1", 0, True), ("None", 0, True), ("None", 0, True)]


def test_large_component_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rng = np.random.default_rng(8)
    base = rng.normal(size=8)
    rows = [(i, (base + 0.02 * rng.normal(size=8)).tolist()) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect()}
    assert got == brute_links(rows)


def test_embeddings_find_pairs_in_a_large_table(spark):
    # far more vectors than a run: pairs at the threshold must meet in some pass
    from govlake.llm.embeddings import passes_for
    assert passes_for(20600, 0.9) > 10
    rng = np.random.default_rng(12)
    x = rng.normal(size=(20000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    side = rng.normal(size=(600, 64))
    side -= (side * x[:600]).sum(1)[:, None] * x[:600]
    side /= np.linalg.norm(side, axis=1)[:, None]
    near = 0.901 * x[:600] + np.sqrt(1 - 0.901 ** 2) * side
    rows = list(enumerate(np.concatenate([x, near]).tolist()))
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(8)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()}
    want = {i: (0, i, True) for i in range(20600)}
    want |= {i: (1, i, True) for i in range(600)} | {20000 + i: (1, i, False) for i in range(600)}
    assert sum(got[i] != want[i] for i in want) == 0


def test_copies_hide_no_link(spark, monkeypatch):
    # one id on two vectors, copies of a vector on one id and on many
    rng = np.random.default_rng(13)
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    base = rng.normal(size=8)
    rows = [(i, base.tolist()) for i in range(200)] + [(300 + i, (base + 0.1 * rng.normal(size=8)).tolist())
                                                       for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect()}
    assert got == brute_links(rows)
    a, b = [1.0, 0.0], [0.0, 1.0]
    df = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b), (4, [1.0, 1.0]), (4, [1.0, 1.0])],
                               "vec_id bigint, embedding array<double>")
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()}
    assert got == {(1, 1, 1, True), (2, 2, 1, False), (3, 1, 1, False), (4, 2, 4, True)}


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, size=(220, 2))]
    edges += [(400 + i, 401 + i) for i in range(40)] + [(7, 7), (None, 3)]       # a long path
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert {r.id: r.component for r in graph.components(df).collect()} == {x: find(x) for x in parent}
    assert graph.components(df.filter("false")).collect() == []


def test_pfair_deviation_is_under_one_block():
    for shares in ({"a": 7, "b": 2, "c": 1}, {"a": 333, "b": 333, "c": 334}, {"a": 1}, {"a": 1, "b": 999}):
        slots = mixing.pfair_period(shares)
        period = sum(shares.values())
        assert sorted(x for v in slots.values() for x in v) == list(range(period))
        for s, k in shares.items():
            at = set(slots[s])
            done = 0
            for t in range(period):
                done += t in at
                assert abs(done - (t + 1) * k / period) < 1


def test_mixing_holds_unrounded_weights():
    # a skewed source, sources under 1/1000 and more than 1000 sources, over many slots
    from fractions import Fraction
    third = {f"s{i:02d}": 1_000_000 // 30 for i in range(20)} | {"s00": 333_333}
    tiny = {f"t{i:04d}": 3 + i % 5 for i in range(1200)} | {"big": 90_000}
    for blocks, weights in ((third, {s: (16 * n) ** 0.5 for s, n in third.items()}),
                            (tiny, {s: float(n) for s, n in tiny.items()}),
                            ({"a": 100, "b": 60_000}, {"a": 1e-3, "b": 1.0})):
        total, done, worst = sum(map(Fraction, weights.values())), dict.fromkeys(blocks, 0), 0
        share = {s: float(Fraction(w) / total) for s, w in weights.items()}
        for t, s in zip(range(1, 40_001), mixing.schedule(blocks, weights)):
            done[s] += 1
            if t % 97 == 0 or t < 50:
                worst = max(worst, *(abs(done[x] - t * share[x]) for x in blocks))
            if done[s] == blocks[s]:
                break
        assert worst < 1 and t > 10_000
    every = Counter(mixing.schedule(tiny, {s: float(n) for s, n in tiny.items() if n != 4}))
    assert every == tiny


def test_mixing_without_a_broadcast_and_with_small_chunks(spark, monkeypatch):
    df = spark.range(4000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'a', 'b') AS source")
    want = sorted(map(tuple, mixing.mix_sources(df, block_docs=2).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_NUMBERS", 0)
    monkeypatch.setattr(mixing, "CHUNK", 7)
    got = sorted(map(tuple, mixing.mix_sources(df, block_docs=2).collect()))
    assert got == want and sorted({r[3] for r in got}) == list(range(len({r[3] for r in got})))


def test_mixing_keeps_every_row_and_its_shares(spark):
    rows = [(i, "a" if i % 3 else "b") for i in range(3000)] + [(5000 + i, None) for i in range(100)]
    rows += [(6000 + i, "zero") for i in range(40)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, source string, position int")
    out = mixing.mix_sources(df, weights={"a": 3.0, "b": 1.0, None: 1.0}, block_docs=10).collect()
    assert Counter((r.doc_id, r.source) for r in out) == Counter(rows)
    slots = {}
    for r in out:
        assert slots.setdefault(r.slot, (r.source, r.block)) == (r.source, r.block)
    assert sorted(slots) == list(range(len(slots)))
    end = min(max(t for t, (s, _) in slots.items() if s == x) for x in ("a", "b", None))
    for x, w in (("a", .6), ("b", .2), (None, .2)):
        done = 0
        for t in range(end):
            done += slots[t][0] == x
            assert abs(done - (t + 1) * w) < 1
    assert min(t for t, (s, _) in slots.items() if s == "zero") > max(t for t, (s, _) in slots.items() if s != "zero")
    assert len({r.position for r in out}) == len(out)
    assert mixing.mix_sources(df.filter("false")).collect() == []


def test_mixing_query_order_is_a_whole_schedule(spark):
    out = REGISTRY["op10_mixing"](spark, SF).collect()
    by = defaultdict(set)
    for r in out:
        by[r.slot].add((r.source, r.block))
    assert len(out) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert sorted(by) == list(range(len(by))) and all(len(v) == 1 for v in by.values())


@pytest.mark.parametrize("key", sorted(ORACLE_SQL))
def test_oracle(spark, key):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    rel = con.sql(ORACLE_SQL[key])
    df = REGISTRY[key](spark, SF)
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    want = Counter(tuple(dict(zip(rel.columns, r))[n] for n in names) for r in rel.fetchall())
    assert Counter(tuple(r[n] for n in names) for r in df.collect()) == want


def test_pipeline_stages(spark):
    import corpus_pipeline as P
    from govlake.llm import decontam, neardup, toxicity
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    columns = docs.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    frames = [docs]
    for _, stage in P.STAGES:
        frames.append(stage(spark, frames[-1], SF).cache())
    ids = [sorted(r.doc_id for r in f.select("doc_id").collect()) for f in frames]
    assert all(f.columns == columns for f in frames[:-1])
    scored = toxicity.score_toxicity(docs, toxicity.train(docs, labels)).collect()
    assert ids[1] == sorted(r.doc_id for r in scored if r.toxicity < 0.3)
    assert ids[2] == ids[1]
    kept = neardup.near_duplicates(frames[2]).filter("kept").collect()
    assert ids[3] == sorted(r.doc_id for r in kept)
    bad = {r.doc_id for r in decontam.contamination(frames[3], spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert ids[4] == [i for i in ids[3] if i not in bad] == ids[5]
    assert all(r.n_chars == len(r.text) for r in frames[4].collect())
    run = sorted((r.doc_id, r.text, r.position) for r in P.run(spark, SF).collect())
    assert run == sorted((r.doc_id, r.text, r.position) for r in frames[5].collect())


def test_native_operator_has_no_python(spark):
    plan = REGISTRY["op7_line_dedup"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_rules_of_the_subpackage():
    root = pathlib.Path(__file__).resolve().parents[2]
    text = {p: p.read_text() for p in (root / "govlake").rglob("*.py")}
    for p, t in text.items():
        if "llm" in p.parts:
            assert not re.search(r"localCheckpoint|crossJoin|toPandas\(|\.rdd\b|tempfile", t), p
        else:
            assert "llm" not in re.sub(r"[\"'].*?[\"']", "", t), p


# ---- columns that clash, ids that repeat -----------------------------------------

def test_pipeline_stages_on_awkward_tables(spark, tmp_path):
    import corpus_pipeline
    schema = ("doc_id bigint, text string, lang string, source string, n_chars bigint, toxicity string, n_lines string, "
              "kept_text string, _id string, row string, slot string")
    extra = ("t", "l", "k", "i", "r", "s")
    line = "a line that is long enough to be counted as one key"
    rows = [(n, f"{line}\nown words of document number {n} and more", "en", "a", 5, *extra) for n in range(8)]
    rows += [(1, rows[1][1], "en", "a", 5, *extra), (None, "text without an id", "en", None, 5, *extra),
             (20, None, "en", "a", None, *extra), (21, "", "en", "b", 0, *extra)]
    for name, table in (("rows", rows), ("empty", [])):
        base = f"{tmp_path}/{name}"
        spark.createDataFrame([(0, 0), (1, 0), (20, None)], "doc_id bigint, toxic int").write.parquet(f"{base}/labels.parquet")
        spark.createDataFrame([(1, "nothing of this stands anywhere in the table at all")],
                              "item_id bigint, text string").write.parquet(f"{base}/benchmark.parquet")
        docs = spark.createDataFrame(table, schema)
        for stage, step in corpus_pipeline.STAGES[:-1]:
            out = step(spark, docs, base)
            out.write.parquet(f"{base}/{stage}")
            docs = spark.read.parquet(f"{base}/{stage}")
            assert docs.dtypes == [tuple(c.split()) for c in schema.split(", ")], stage
            assert {tuple(r[5:]) for r in docs.collect()} <= {extra}
        mixed = corpus_pipeline.STAGES[-1][1](spark, docs, base)
        assert mixed.count() == docs.count()
        assert name == "rows" or docs.count() == 0
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/rows/line_dedup").collect()}
    assert texts[7].startswith(line) and not texts[3].startswith(line)
    assert texts[20] is None and texts[None] == "text without an id"
