"""Embedding near-dedup by sorted projection passes.

Identical unit vectors are one node with a weight, so copies take no place.
Each pass draws random hyperplanes, concatenates the sign bits of a node's
vector into a key and orders all nodes by it.  The order is cut into runs of
RUN nodes; a run is compared with itself and with the first WINDOW nodes of the
next one, so any two nodes at most WINDOW places apart are compared.  Keys are
sorted without vectors; a run gets them in single precision, pairs too near the
threshold for that are checked again in double precision.  A run sends on one
link per node to the smallest node it is joined with there, never all pairs.
The links of all passes are joined into components.

Two vectors at an angle of a share the first b bits of a key with probability
(1 - a / pi)^b, and nodes that share log2(n / WINDOW) bits are about WINDOW
places apart.  ``passes_for`` derives from that how many passes leave a pair
exactly at the threshold apart with probability MISS at most.  They run in
rounds of half as many; rounds go on until one of them joins nothing that was
apart, so crowded directions get more passes than the estimate.

The link counts of a component are completed exactly, block against block
(``_complete``); only per-vector counts leave a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govlake.functions.ranking import range_row_numbers
from govlake.llm.graph import components
from govlake.session import drop_scratch, materialize

#: Chance at which a pair exactly at the threshold may meet in no pass.
MISS = 1e-4
#: Sign bits of a key.
BITS = 62
#: Nodes of a run of the order, and of the next run that it is compared with.
RUN, WINDOW = 1024, 256
#: Vectors of a block of a component.
BLOCK = 4096
#: Rows of one matrix product inside a block.
SLAB = 512


def _unit(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, unit vectors in double precision) of usable vectors;
    vectors of another length than the batch's most common one are kept apart
    by padding with zeros."""
    lists = column.to_pylist()
    width = max((len(v) for v in lists if v is not None), default=0)
    x = np.zeros((len(lists), width))
    ok = np.zeros(len(lists), dtype=bool)
    for i, v in enumerate(lists):
        if v and None not in v:
            x[i, :len(v)] = v
            ok[i] = True
    with np.errstate(all="ignore"):
        ok &= np.isfinite(x).all(1)
        x[~ok] = 0
        scale = np.abs(x).max(1, initial=0)
        ok &= scale > 0
        x = x[ok] / scale[ok][:, None]
        return np.flatnonzero(ok), x / np.linalg.norm(x, axis=1)[:, None]


def unit_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec): usable vectors as little-endian doubles of length 1."""
    src = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).filter("id is not null")
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = _unit(b.column("v"))
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array(rows)), pa.array([r.astype("<f8").tobytes() for r in x], pa.binary())],
                names=["id", "vec"])

    return src.mapInArrow(run, f"id {kind}, vec binary")


def passes_for(n: int, threshold: float, miss: float = MISS) -> int:
    """The passes after which two of ``n`` nodes at the threshold have met in a
    window but for a chance of ``miss``."""
    agree = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    meet = agree ** max(0.0, math.log2(max(n, 1) / WINDOW))
    return 1 if meet >= 1 else math.ceil(math.log(miss) / math.log1p(-meet))


def _keys(nodes: DataFrame, first: int, passes: int) -> DataFrame:
    """(pass, key, v): the signs of BITS random projections."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("vec").to_pylist())
            for p in range(first, first + passes):
                # row by row from a fixed seed: a plane's value does not depend on the width
                planes = np.random.default_rng(1000 + p).standard_normal((x.shape[1], BITS))
                key = ((x @ planes > 0) << np.arange(BITS - 1, -1, -1, dtype=np.int64)).sum(1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), p, dtype=np.int32)), pa.array(key.astype(np.int64)), b.column("v")],
                    names=["pass", "key", "v"])

    return nodes.select("v", "vec").mapInArrow(run, "pass int, key bigint, v binary")


def _matrix(vecs: pd.Series | list[bytes]) -> np.ndarray:
    width = max(len(v) for v in vecs) // 8
    x = np.zeros((len(vecs), width))
    for i, v in enumerate(vecs):
        x[i, :len(v) // 8] = np.frombuffer(v, "<f8")
    return x


def _dealt(rows: DataFrame, group: list[str]) -> DataFrame:
    """``rows`` (with v) once for each pair of blocks of their group that they
    take part in: adds ``block``, ``lo`` and ``hi``, the pair's blocks."""
    large = (rows.groupBy(*group).agg(F.count("*").alias("_n")).filter(F.col("_n") > BLOCK)
             .withColumn("_blocks", F.ceil(F.col("_n") / BLOCK).cast("int")).drop("_n"))
    large = materialize(large, "large")         # one row per BLOCK rows at most, of a known size from here
    placed = (rows.join(large, group, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
              .withColumn("block", F.pmod(F.xxhash64("v"), F.col("_blocks")).cast("int")))
    # block i meets every block j: the row goes to (i, j) or (j, i), the smaller first
    met = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return (met.withColumns({"lo": F.least("block", "_other"), "hi": F.greatest("block", "_other")})
            .drop("_blocks", "_other"))


def _joined(x: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """The smallest row each row is joined with through links between rows of
    ``left`` and rows of ``right``."""
    label = np.arange(len(x))
    for s in range(0, len(left), SLAB):
        rows = left[s:s + SLAB]
        hits = x[rows] @ x[right].T >= threshold
        for i in np.flatnonzero(hits.any(1)):
            seen = label[np.append(right[hits[i]], rows[i])]
            low = seen.min()
            if (seen != low).any():
                label[np.isin(label, seen)] = low
    return label


def _single(nodes: DataFrame) -> DataFrame:
    """(v, near): the vectors in single precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = [np.frombuffer(x, "<f8").astype("<f4").tobytes() for x in b.column("vec").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("v"), pa.array(near, pa.binary())], names=["v", "near"])

    return nodes.select("v", "vec").mapInArrow(run, "v binary, near binary")


def _windows(keys: DataFrame, single: DataFrame, threshold: float) -> DataFrame:
    """(a, b, sure): inside each window of the order, each node with the
    smallest one it is joined with (sure), and the pairs that single precision
    cannot tell from the threshold."""
    ranked = range_row_numbers(keys, ["pass"], [F.col("key"), F.col("v")], out="rank")
    place = F.col("rank") - 1
    run_of = F.floor(place / RUN).cast("bigint")
    met = F.when((place % RUN < WINDOW) & (run_of > 0), F.array(run_of, run_of - 1)).otherwise(F.array(run_of))
    rows = ranked.select("v", "pass", run_of.alias("own"), F.explode(met).alias("run")).join(single, "v")

    def compare(t: pa.Table) -> pa.Table:
        t = t.sort_by("v")
        vecs = t["near"].to_pylist()
        width = max(map(len, vecs)) // 4
        x = np.zeros((len(vecs), width), dtype=np.float32)
        for i, v in enumerate(vecs):
            x[i, :len(v) // 4] = np.frombuffer(v, "<f4")
        margin = 1e-7 * (8 + width)
        left = np.flatnonzero(t["own"].to_numpy() == t["run"][0].as_py())
        right = np.arange(len(x))
        label, close = _joined(x, left, right, threshold + margin, threshold - margin)
        far = np.flatnonzero(label != right)
        a = np.concatenate([label[far], close[0]]).astype(np.int64)
        b = np.concatenate([far, close[1]]).astype(np.int64)
        sure = np.arange(len(a)) < len(far)
        return pa.table({"a": t["v"].take(pa.array(a)), "b": t["v"].take(pa.array(b)), "sure": pa.array(sure)})

    return rows.groupBy("pass", "run").applyInArrow(compare, "a binary, b binary, sure boolean").distinct()


def _joined(x: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float,
            doubt: float) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """The smallest row each row is joined with through links between rows of
    ``left`` and rows of ``right``; and the pairs between ``doubt`` and the
    threshold whose rows are not joined that way."""
    label = np.arange(len(x))
    doubtful: list[tuple[np.ndarray, np.ndarray]] = []
    for s in range(0, len(left), SLAB):
        rows = left[s:s + SLAB]
        score = x[rows] @ x[right].T
        hits = score >= threshold
        for i in np.flatnonzero(hits.sum(1) > 1):        # a row hits itself
            seen = label[np.append(right[hits[i]], rows[i])]
            low = seen.min()
            if (seen != low).any():
                label[np.isin(label, seen)] = low
        i, j = np.nonzero((score >= doubt) & ~hits)
        doubtful.append((rows[i], right[j]))
    a, b = (np.concatenate(p) if doubtful else np.zeros(0, dtype=np.int64) for p in zip(*doubtful))
    apart = (a != b) & (label[a] != label[b])
    return label, (a[apart], b[apart])


def _verified(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) at the threshold or above in double precision."""
    vec = nodes.select("v", "vec")
    both = (pairs.join(vec.select(F.col("v").alias("a"), F.col("vec").alias("va")), "a")
            .join(vec.select(F.col("v").alias("b"), F.col("vec").alias("vb")), "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [float(np.dot(*_matrix([x, y]))) >= threshold
                    for x, y in zip(b.column("va").to_pylist(), b.column("vb").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")],
                                             names=["a", "b"])

    return both.select("a", "b", "va", "vb").mapInArrow(run, "a binary, b binary")


def _links(nodes: DataFrame, n: int, threshold: float, miss: float, known: DataFrame) -> DataFrame:
    """(id, component) after rounds of passes, ``known`` links included."""
    single = materialize(_single(nodes), "single")
    size = -(-passes_for(n, threshold, miss) // 2)
    links, comp, first = materialize(known, "same-id"), None, 0
    while True:
        found = materialize(_windows(_keys(nodes, first, size), single, threshold), "windows")
        new = found.filter("sure").select("a", "b").union(_verified(found.filter("not sure"), nodes, threshold))
        if comp is not None:
            # only what joins two components is new
            at = [comp.select(F.col("id").alias(c), F.col("component").alias(f"c{c}")) for c in "ab"]
            new = (new.join(at[0], "a", "left").join(at[1], "b", "left")
                   .filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"))
        new = materialize(new, "links")
        drop_scratch(found)
        if comp is not None and new.isEmpty():
            return comp
        links = links.union(new)
        comp = materialize(components(links), "components")
        first += size


def _complete(nodes: DataFrame, comp: DataFrame, threshold: float) -> DataFrame:
    """(v, others): vectors of other nodes of its component each node links
    with, block against block.  A component of up to BLOCK nodes is one task's
    work; a larger one is dealt into blocks of about BLOCK, and each pair of
    blocks is a task of its own."""
    met = _dealt(comp.select(F.col("id").alias("v"), "component").join(nodes, "v"), ["component"])

    def count(g: pd.DataFrame) -> pd.DataFrame:
        lo, hi = g["lo"].iloc[0], g["hi"].iloc[0]
        x, block, weight = _matrix(g["vec"]), g["block"].to_numpy(), g["weight"].to_numpy()
        n = np.zeros(len(g), dtype=np.int64)
        left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        for s in range(0, len(left), SLAB):
            rows = left[s:s + SLAB]
            hit = x[rows] @ x[right].T >= threshold
            if lo == hi:
                hit[np.arange(len(rows)), np.arange(s, s + len(rows))] = False
            else:
                n[right] += weight[rows] @ hit
            n[rows] += hit @ weight[right]
        return pd.DataFrame({"v": g["v"], "others": n})

    return (met.groupBy("component", "lo", "hi").applyInPandas(count, "v binary, others bigint")
            .groupBy("v").agg(F.sum("others").alias("others")))


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding",
                    miss: float = MISS) -> DataFrame:
    """One row per row of ``vectors``: id column, n_links (other vectors it
    links with), component_id (smallest id reachable), kept (id is its
    component's smallest).

    Pairs link at a cosine of ``threshold`` or more in double precision; a pair
    at the threshold is overlooked with probability ``miss`` at most where keys
    spread evenly (and seldom elsewhere, see the rounds above), a closer one
    with less, unless others join its ends.  Vectors that are null, empty,
    zero or hold null or non-finite components link with nothing; a null id
    links with nothing (component null, kept).  Rows that share an id are one
    node, and copies among them count as links.  Shorter vectors count as
    padded with zeros.  No rows give no rows.
    """
    units = unit_vectors(vectors, id_col, vec_col).withColumn("v", F.unhex(F.md5("vec")))
    units = materialize(units, "units")
    nodes = materialize(units.groupBy("v").agg(F.any_value("vec").alias("vec"), F.count("*").alias("weight")), "nodes")
    same_id = units.groupBy("id").agg(F.min("v").alias("a"), F.max("v").alias("_max")).filter("a != _max")
    same_id = units.join(same_id, "id").select("a", F.col("v").alias("b"))
    comp = _links(nodes, nodes.count(), threshold, miss, same_id)
    counts = _complete(nodes, comp, threshold)
    of_node = (nodes.select("v", "weight").join(comp.withColumnRenamed("id", "v"), "v", "left").join(counts, "v", "left")
               .select("v", F.coalesce("component", "v").alias("component"),
                       (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")))
    placed = materialize(units.select("id", "v").join(of_node, "v"), "placed")
    low = placed.groupBy("component").agg(F.min("id").alias("component_id"))
    of_id = placed.groupBy("id", "component").agg(F.sum("n_links").alias("n_links")).join(low, "component")
    out = (vectors.select(F.col(id_col).alias("id")).join(of_id, "id", "left")
           .select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                   F.coalesce("component_id", "id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
