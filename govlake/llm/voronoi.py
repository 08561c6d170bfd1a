"""Exact top-k search by inner product: a Voronoi kNN join.

Inner products become distances: a row s gets one more coordinate that brings
it to the length of the longest row, a query gets a zero there, and the nearest
rows of a query are then those of the highest inner product.

1. A bounded sample of rows are the pivots; each row joins the cell of its
   nearest pivot.  A cell's summary is its size and its ``k + 1`` members
   nearest to the pivot.
2. A query's ``k``-th best score over the members in the summaries bounds its
   distance to its ``k``-th neighbour.  By the triangle inequality only a ring
   around each pivot can hold nearer rows, and none of a cell lies nearer than
   the plane between its pivot and the query's.
3. Queries are grouped by cell.  A group's ring around a pivot spans those of
   its queries; a row is sent to a group only if it lies in the group's ring.
4. Each (group of queries, slice of rows) is solved locally by exact products
   of integers; the best ``k`` of all slices are kept.

Cells with many queries or rows are dealt over several groups or slices, so
one task holds at most about GROUP queries and SLICE rows.  The driver sees
only the pivots, their summaries and counts by cell, at most PIVOTS of each.
Distances only exclude, with a margin for rounding; scores are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from govlake.llm.integer_vectors import by_id, cut, nodes_of, products, unpack
from govlake.session import materialize

#: Most pivots, and rows a pivot stands for where there are fewer.
PIVOTS, CELL = 512, 512
#: Queries and rows of one local search; a small table is cut into up to SLICES slices.
GROUP, SLICE, SLICES = 8192, 8192, 64
#: Queries of one matrix product.
SLAB = 256
#: Margin of every comparison of distances between vectors scaled to components of at most 1.
MARGIN = 1e-6


def bins(counts: dict[int, int], order: list[int], size: int) -> list[tuple[int, int, int]]:
    """(cell, first bin, bins): cells in ``order`` share a bin while they fit
    ``size``; a larger cell is dealt over several bins of its own."""
    out, at, used = [], 0, 0
    for cell in order:
        n = counts.get(cell, 0)
        if not n:
            continue
        if used and used + n > size:
            at, used = at + 1, 0
        share = -(-n // size)
        out.append((cell, at, share))
        at, used = (at + share, 0) if share > 1 else (at, used + n)
    return out


def chain(points: np.ndarray) -> list[int]:
    """All points, each followed by the nearest one not yet visited."""
    if not len(points):
        return []
    left, order = np.ones(len(points), dtype=bool), [0]
    left[0] = False
    while left.any():
        far = ((points - points[order[-1]]) ** 2).sum(1)
        far[~left] = np.inf
        order.append(int(far.argmin()))
        left[order[-1]] = False
    return order


class _Space:
    """Pivots in scaled coordinates; ``reach`` is the squared length of the longest row."""

    def __init__(self, packed: list[bytes], width: int, scale: float, reach: float):
        self.width, self.scale, self.reach = width, scale, reach
        self.pivots = unpack(pa.array(packed, pa.binary()), width) / scale
        self.lift = self._lift(self.pivots)

    def _lift(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.reach - (x * x).sum(1), 0))

    def rows(self, column: pa.Array) -> np.ndarray:
        """Distances of data rows to the pivots."""
        x = unpack(column, self.width) / self.scale
        near = x @ self.pivots.T + np.outer(self._lift(x), self.lift)
        return np.sqrt(np.maximum(2 * (self.reach - near), 0))

    def queries(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Squared lengths of queries and their distances to the pivots."""
        x = unpack(column, self.width) / self.scale
        size = (x * x).sum(1)
        return size, np.sqrt(np.maximum(size[:, None] + self.reach - 2 * (x @ self.pivots.T), 0))

    def between(self) -> np.ndarray:
        """Distances between pivots."""
        near = self.pivots @ self.pivots.T + np.outer(self.lift, self.lift)
        return np.sqrt(np.maximum(2 * (self.reach - near), 0))


def _sizes(nodes: DataFrame) -> tuple[int, int, float, float]:
    """(rows, width, largest component, squared length of the longest row in scaled components)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = unpack(b.column("vec"))
            if not x.size:
                yield pa.RecordBatch.from_pydict({"n": [len(x)], "width": [0], "top": [0.0], "size": [0.0]})
                continue
            top = float(np.abs(x).max()) or 1.0
            size = float(((x / top) ** 2).sum(1).max())
            yield pa.RecordBatch.from_pydict({"n": [len(x)], "width": [x.shape[1]], "top": [top], "size": [size]})

    parts = nodes.select("vec").mapInArrow(run, "n bigint, width bigint, top double, size double")
    n, width, top = parts.agg(F.sum("n"), F.max("width"), F.max("top")).first()
    if not n:
        return 0, 0, 1.0, 0.0
    top = top or 1.0
    reach = parts.agg(F.max(F.col("size") * F.pow(F.col("top") / F.lit(top), F.lit(2.0)))).first()[0]
    return n, width, top, reach


def _placed(nodes: DataFrame, space: _Space) -> DataFrame:
    """``nodes`` with their cell and the distance to its pivot."""
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                far = space.rows(b.column("vec"))
                cell = far.argmin(1)
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(cell)), cell])],
                    names=[*b.schema.names, "cell", "dist"])

    return nodes.mapInArrow(run, f"{kind}, cell int, dist double")


def _bounded(queries: DataFrame, space: _Space, members: list, k: int) -> DataFrame:
    """``queries`` with their own cell and ``low``, a lower bound of their k-th
    best score (the least long where the summaries hold fewer than k rows)."""
    names, packed = [bytes(m["node"]) for m in members], [bytes(m["vec"]) for m in members]
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {n: i for i, n in enumerate(names)}
        known = unpack(pa.array(packed, pa.binary()))
        for b in batches:
            if not b.num_rows:
                continue
            cell = space.queries(b.column("vec"))[1].argmin(1)
            score = products(unpack(b.column("vec")), known)
            for i, node in enumerate(b.column("node").to_pylist()):
                if node in place:
                    score[i, place[node]] = np.iinfo(np.int64).min
            low = np.full(len(score), np.iinfo(np.int64).min)
            if score.shape[1] >= k:
                low = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(low)],
                                             names=[*b.schema.names, "cell", "low"])

    return queries.mapInArrow(run, f"{kind}, cell int, low bigint")


def _rings(queries: DataFrame, space: _Space) -> DataFrame:
    """(grp, cell, near, far): the ring around the cell's pivot that can hold
    rows a query of the group needs; no row where no query needs the cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart = space.between()
        for b in batches:
            if not b.num_rows:
                continue
            size, away = space.queries(b.column("vec"))
            low = b.column("low").to_numpy(zero_copy_only=False)
            least = np.where(low == np.iinfo(np.int64).min, -np.inf, low.astype(float) / space.scale ** 2)
            radius = np.sqrt(np.maximum(size + space.reach - 2 * least, 0)) * (1 + MARGIN) + MARGIN
            cell = b.column("cell").to_numpy()
            own = away[np.arange(len(cell)), cell]
            with np.errstate(all="ignore"):
                plane = (away ** 2 - own[:, None] ** 2) / (2 * apart[cell])
            needed = ~(plane > radius[:, None] + MARGIN)
            near = np.where(needed, away - radius[:, None], np.inf)
            far = np.where(needed, away + radius[:, None], -np.inf)
            group = b.column("grp").to_numpy()
            for g in np.unique(group):
                mine = group == g
                lo, hi = near[mine].min(0), far[mine].max(0)
                cells = np.flatnonzero(lo <= hi)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(cells), g, dtype=np.int32)), pa.array(cells.astype(np.int32)),
                     pa.array(lo[cells]), pa.array(hi[cells])], names=["grp", "cell", "near", "far"])

    rings = queries.select("vec", "cell", "low", "grp").mapInArrow(run, "grp int, cell int, near double, far double")
    return rings.groupBy("grp", "cell").agg(F.min("near").alias("near"), F.max("far").alias("far"))


def _solve(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(node, copies, query_id, id, weight, score): each query's first k rows of a slice."""
    kind = queries.schema["id"].dataType.simpleString()
    out = f"node binary, copies bigint, query_id {kind}, id {kind}, weight bigint, score bigint"

    def solve(q: pa.Table, d: pa.Table) -> pa.Table:
        empty = q.select(["node", "copies", "id"]).slice(0, 0)
        d = by_id(d)
        x, a = unpack(d["vec"]), unpack(q["vec"])
        names, copies = d["node"].to_pylist(), d["copies"].to_numpy()
        own = {n: i for i, n in enumerate(names)}
        low = q["low"].to_numpy()
        asked = q["node"].to_pylist()
        found = []
        for s in range(0, len(a), SLAB):
            if not len(x):
                break
            score = products(a[s:s + SLAB], x)
            which, row = np.nonzero(score >= low[s:s + SLAB, None])
            value = score[which, row]
            mine = np.array([own.get(n, -1) for n in asked[s:s + SLAB]])
            other = (mine[which] != row) | (copies[row] > 1)
            which, row, value = which[other], row[other], value[other]
            best = cut(which, value, row, k)
            weight = copies[row[best]] - (mine[which[best]] == row[best])
            found.append((which[best] + s, row[best], weight, value[best]))
        which, row, weight, value = ([np.concatenate(p) for p in zip(*found)] if found
                                     else [np.zeros(0, dtype=np.int64)] * 4)
        head = q.select(["node", "copies", "id"]).take(pa.array(which)) if len(which) else empty
        return pa.table({"node": head["node"], "copies": head["copies"], "query_id": head["id"],
                         "id": d["id"].take(pa.array(row, pa.int64())), "weight": pa.array(weight, pa.int64()),
                         "score": pa.array(value, pa.int64())})

    return queries.groupBy("grp", "slice").cogroup(rows.groupBy("grp", "slice")).applyInArrow(solve, out)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id",
          vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): for each row for which ``is_query`` holds,
    the ``k`` other rows (all, if fewer) of the highest integer inner product,
    ties to the smaller id; exact.

    Components become floor(256 * x).  Vectors that are null or hold null or
    non-finite components take no part, neither as query nor as row; an empty
    vector has product 0 with all.  Shorter vectors count as padded with zeros.
    Every repeated row is a row of its own: it is asked and found once per
    copy, and a query's copies are other rows to it.  A null id is found (last
    among ties) and asked only if ``is_query`` holds for it.  A score beyond a
    long counts as the nearest long.  Other columns play no part; no rows give
    no rows.
    """
    spark = vectors.sparkSession
    nodes = nodes_of(vectors, F.col(vec_col), id=F.col(id_col), asked=F.coalesce(is_query, F.lit(False)))
    nodes = materialize(nodes, "nodes")
    n, width, scale, reach = _sizes(nodes)
    wanted = max(1, min(PIVOTS, -(-n // CELL)))
    chosen = nodes.select("vec").orderBy(F.xxhash64("node"), "node").limit(wanted).collect()
    space = _Space([bytes(r["vec"]) for r in chosen], width, scale, reach)
    placed = materialize(_placed(nodes, space) if n else nodes.withColumns(
        {"cell": F.lit(0), "dist": F.lit(0.0)}), "cells")

    nearest = Window.partitionBy("cell").orderBy("dist", "node")
    members = (placed.withColumn("_rank", F.row_number().over(nearest)).filter(F.col("_rank") <= k + 1)
               .select("node", "vec").collect())
    asked = placed.filter("asked").select("id", "node", "vec", "copies")
    asked = materialize(_bounded(asked, space, members, k), "queries")
    order = chain(space.pivots)

    def dealt(frame: DataFrame, size: int, first: str) -> tuple[DataFrame, DataFrame]:
        """(a row's bin added, the bins of each cell): one row per pivot at most."""
        counts = {r["cell"]: r["count"] for r in frame.groupBy("cell").count().collect()}
        table = spark.createDataFrame(bins(counts, order, size), f"cell int, {first} int, _share int")
        share = F.pmod(F.xxhash64("node"), F.col("_share")).cast("int")
        return (frame.join(F.broadcast(table), "cell").withColumn(first, F.col(first) + share).drop("_share"), table)

    asked, _ = dealt(asked, GROUP, "grp")
    rows, slices = dealt(placed.drop("asked"), min(SLICE, max(SLICE // 8, n // SLICES)), "slice")
    rings = materialize(_rings(asked, space), "rings")
    pairs = (rings.join(F.broadcast(slices), "cell")
             .select("grp", F.explode(F.sequence(F.col("slice"), F.col("slice") + F.col("_share") - 1)).alias("slice"))
             .distinct())
    needed = rows.join(rings, "cell").filter((F.col("dist") >= F.col("near") - MARGIN)
                                             & (F.col("dist") <= F.col("far") + MARGIN))
    local = _solve(asked.join(pairs, "grp").select("grp", "slice", "id", "node", "vec", "copies", "low"),
                   needed.select("grp", "slice", "id", "node", "vec", "copies"), k)
    # a found row with copies stands in as many places, k at most
    each = local.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.least(F.col("weight"), F.lit(k)).cast("int"))))
    best = Window.partitionBy("node").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = each.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return (ranked.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
            .select("query_id", "rank", "id", "score"))
