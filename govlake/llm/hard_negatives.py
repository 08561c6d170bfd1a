"""Hard-negative mining over an STR-packed R-tree.

Rows are packed by sort-tile-recurse: the three components of largest variance
cut all rows into tiles of about PART rows at their quantiles (one grouped
aggregate a component), an oversized tile is dealt by hash.  A tile is a
subtree; inside a task its rows are packed into leaves of LEAF rows by the same
rule and the leaves, FAN at a time, into inner boxes up to the root.

An anchor's inner product with any vector of a minimum bounding box lies in the
sum of its per-coordinate intervals.  A search holds the boxes in a queue, best
upper bound first; a box is dropped if its interval misses every score window
the anchor still has or lies strictly below the window's k-th score so far.

Every anchor is searched first in its own subtree; the scores found there bound
the rest.  Groups of anchors then meet the roots in blocks, and the rows of a
subtree are sent to a group only if some anchor of it can gain there.  Two such
searches are run: for the positives (the anchor's label, any score), then for
the negatives (other labels, one window per positive).  Boxes only exclude,
with a margin for rounding; scores are exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from govlake.llm.integer_vectors import by_id, nodes_of, products, unpack
from govlake.session import materialize

#: Rows of a subtree, of a leaf; boxes of an inner box; anchors of a group.
PART, LEAF, FAN, GROUP = 8192, 128, 8, 4096
#: Components that cut all rows into tiles, and that order the rows inside one.
AXES = 3
#: Roots that meet a group of anchors in one task.
ROOTS = 4096
#: Relative margin of a box's bound.
MARGIN = 1e-9


# ---- packing ---------------------------------------------------------------

def _moments(nodes: DataFrame) -> list[int]:
    """The AXES components of largest variance; one partial sum per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = unpack(b.column("vec"))
            if x.size:
                yield pa.RecordBatch.from_pydict({"axis": np.arange(x.shape[1]), "n": np.full(x.shape[1], len(x)),
                                                  "s": x.sum(0), "ss": (x * x).sum(0)})

    sums = nodes.select("vec").mapInArrow(run, "axis bigint, n bigint, s double, ss double").groupBy("axis").agg(
        (F.sum("ss") / F.sum("n") - F.pow(F.sum("s") / F.sum("n"), F.lit(2))).alias("spread"))
    return [r["axis"] for r in sums.orderBy(F.desc_nulls_last("spread"), "axis").limit(AXES).collect()]


def _tiled(nodes: DataFrame, axes: list[int], total: int) -> DataFrame:
    """``nodes`` with ``tile`` and ``part``: tiles by the quantiles of one
    component inside the slabs of the one before."""
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema)

    def coordinates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = unpack(b.column("vec"), max(axes, default=0) + 1)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x[:, a]) for a in axes)],
                                             names=[*b.schema.names, *(f"c{i}" for i in range(len(axes)))])

    extra = "".join(f", c{i} double" for i in range(len(axes)))
    d = materialize(nodes.mapInArrow(coordinates, kind + extra), "axes").withColumn("tile", F.lit(0).cast("bigint"))
    slabs = max(1, round((total / PART) ** (1 / max(1, len(axes)))))
    while slabs ** max(1, len(axes)) * PART < total:
        slabs += 1
    if slabs > 1:
        cuts = [i / slabs for i in range(1, slabs)]
        for i in range(len(axes)):
            here = F.col(f"c{i}")
            at = d.groupBy("tile").agg(F.percentile_approx(here, cuts).alias("_cuts"))
            below = F.aggregate("_cuts", F.lit(0), lambda n, c: n + (c < here).cast("int"))
            d = (d.join(at, "tile").withColumn("tile", F.col("tile") * slabs + below).drop("_cuts"))
    d = d.drop(*(f"c{i}" for i in range(len(axes))))
    large = (d.groupBy("tile").agg(F.count("*").alias("_n")).filter(F.col("_n") > 2 * PART)
             .select("tile", F.ceil(F.col("_n") / PART).cast("int").alias("_share")))
    share = F.pmod(F.xxhash64("node"), F.coalesce("_share", F.lit(1))).cast("int")
    return (d.join(large, "tile", "left")
            .withColumn("part", F.concat_ws("-", F.col("tile").cast("string"), share.cast("string"))).drop("_share"))


class _Tree:
    """The packed R-tree of one subtree's rows."""

    def __init__(self, x: np.ndarray):
        self.x = x
        order = self._pack(np.arange(len(x)), np.argsort(-x.var(0), kind="stable")[:AXES])
        leaves = [order[i:i + LEAF] for i in range(0, len(order), LEAF)]
        lows, highs = [x[r].min(0) for r in leaves], [x[r].max(0) for r in leaves]
        self.inside: list = list(leaves)        # rows of a leaf, children of an inner box
        self.leaves = len(leaves)
        level = range(len(leaves))
        while len(level) > 1:
            start = len(self.inside)
            for i in range(0, len(level), FAN):
                kids = list(level[i:i + FAN])
                self.inside.append(kids)
                lows.append(np.min([lows[k] for k in kids], axis=0))
                highs.append(np.max([highs[k] for k in kids], axis=0))
            level = range(start, len(self.inside))
        self.low, self.high = np.array(lows), np.array(highs)

    def _pack(self, rows: np.ndarray, axes: np.ndarray) -> np.ndarray:
        if not len(axes) or len(rows) <= LEAF:
            return rows
        rows = rows[np.argsort(self.x[rows, axes[0]], kind="stable")]
        leaves = -(-len(rows) // LEAF)
        slabs = max(1, round(leaves ** (1 / len(axes))))
        width = -(-leaves // slabs) * LEAF
        return np.concatenate([self._pack(rows[i:i + width], axes[1:]) for i in range(0, len(rows), width)])


def _interval(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) product of each anchor with any vector of each box."""
    width = max(anchors.shape[1], low.shape[1])
    anchors, low, high = (np.pad(v, ((0, 0), (0, width - v.shape[1]))) for v in (anchors, low, high))
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    # a bound past the doubles excludes nothing
    with np.errstate(all="ignore"):
        margin = MARGIN * (1 + np.abs(anchors) @ np.maximum(np.abs(low), np.abs(high)).T)
        least, most = up @ low.T + down @ high.T - margin, up @ high.T + down @ low.T + margin
    return np.nan_to_num(least, nan=-np.inf), np.nan_to_num(most, nan=np.inf)


# ---- search ----------------------------------------------------------------

class _Best:
    """The first ``k`` (score, row) of one window, by score (high first), then row."""

    def __init__(self, lo: float, hi: float, floor: float, k: int):
        self.lo, self.hi, self.k = lo, hi, k
        self.floor = max(lo, floor)             # rows strictly below cannot be among the first k
        self.heap: list[tuple[int, int, int]] = []      # (score, -row, weight)
        self.held = 0

    def add(self, scores: np.ndarray, rows: np.ndarray, weights: np.ndarray) -> None:
        hit = np.flatnonzero((scores >= self.floor) & (scores <= self.hi) & (weights > 0))
        for i in hit:
            s, r, w = int(scores[i]), int(rows[i]), int(weights[i])
            if s < self.floor:
                continue
            heapq.heappush(self.heap, (s, -r, w))
            self.held += w
            while self.held - self.heap[0][2] >= self.k:
                self.held -= heapq.heappop(self.heap)[2]
            if self.held >= self.k:
                self.floor = max(self.floor, self.heap[0][0])


def _search(tree: _Tree, vec: np.ndarray, least: np.ndarray, most: np.ndarray, weights: np.ndarray,
            windows: list[_Best]) -> None:
    """Best-first through the boxes; ``weights`` (by row) is 0 for rows that are no candidate."""

    def wanted(box: int) -> bool:
        return any(most[box] >= w.floor and least[box] <= w.hi for w in windows)

    queue = [(-most[-1], len(tree.inside) - 1)]
    while queue:
        _, box = heapq.heappop(queue)
        if not wanted(box):
            continue
        if box < tree.leaves:
            rows = tree.inside[box]
            score = products(vec[None], tree.x[rows])[0]
            for w in windows:
                w.add(score, rows, weights[rows])
        else:
            for kid in tree.inside[box]:
                if wanted(kid):
                    heapq.heappush(queue, (-most[kid], kid))


def _searched(anchors: pa.Table, rows: pa.Table, same: bool, k: int) -> pa.Table:
    """(node, window, id, weight, score) of each anchor's first ``k`` rows per window."""
    rows = by_id(rows)
    found: list[tuple] = []
    if len(rows) and len(anchors):
        x, a = unpack(rows["vec"]), unpack(anchors["vec"])
        width = max(x.shape[1], a.shape[1], 1)
        x, a = (np.pad(v, ((0, 0), (0, width - v.shape[1]))) for v in (x, a))
        tree = _Tree(x)
        least, most = _interval(a, tree.low, tree.high)
        label, copies = rows["label"].to_numpy(), rows["copies"].to_numpy()
        own = {n: i for i, n in enumerate(rows["node"].to_pylist())}
        nodes, labels = anchors["node"].to_pylist(), anchors["label"].to_numpy()
        for i, spans in enumerate(anchors["windows"].to_pylist()):
            weights = np.where((label == labels[i]) == same, copies, 0)
            if nodes[i] in own:
                weights[own[nodes[i]]] -= int(same)
            best = [_Best(*(s[n] if s[n] is not None else d for n, d in
                            (("lo", -np.inf), ("hi", np.inf), ("floor", -np.inf))), k) for s in spans]
            _search(tree, a[i], least[i], most[i], weights, best)
            found += [(i, s["name"], -r, w, score) for s, b in zip(spans, best) for score, r, w in b.heap]
    which, window, row, weight, score = zip(*found) if found else ((),) * 5
    return pa.table({"node": anchors["node"].take(pa.array(which, pa.int64())), "window": pa.array(window, pa.int64()),
                     "id": rows["id"].take(pa.array(row, pa.int64())),
                     "weight": pa.array(weight, pa.int64()), "score": pa.array(score, pa.int64())})


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each (node, window), copies counted one by one, with ``rank``."""
    each = found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.least("weight", F.lit(k)).cast("int"))))
    best = Window.partitionBy("node", "window").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return each.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).drop("_copy", "weight")


def _nearest(rows: DataFrame, roots: DataFrame, anchors: DataFrame, runs: int, same: bool, k: int) -> DataFrame:
    """The first ``k`` rows of every window of ``anchors`` (node, label, vec,
    part, run, grp, windows: name, lo, hi, floor), searched in the whole tree;
    ``run`` is below ``runs``, a group lies in one run."""
    kind = rows.schema["id"].dataType.simpleString()
    out = f"node binary, window bigint, id {kind}, weight bigint, score bigint"

    def home(a: pa.Table, r: pa.Table) -> pa.Table:
        return _searched(a, r, same, k)

    opened = anchors
    first = materialize(opened.groupBy("part").cogroup(rows.groupBy("part")).applyInArrow(home, out), "home")
    # the k-th score at home is the floor everywhere else
    floors = (_first(first, k).filter(F.col("rank") == k).groupBy("node")
              .agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("_kth")))
    raised = F.transform("windows", lambda w: w.withField("floor", F.element_at("_kth", w["name"])))
    opened = materialize(opened.join(floors, "node", "left").withColumn("windows", F.when(
        F.col("_kth").isNull(), F.col("windows")).otherwise(raised)).drop("_kth"), "anchors")

    def reach(key: tuple, a: pa.Table, r: pa.Table) -> pa.Table:
        if not len(a) or not len(r):
            return pa.table({"grp": pa.array([], pa.string()), "part": pa.array([], pa.string())})
        boxes = (unpack(r["low"]), unpack(r["high"]))
        least, most = _interval(unpack(a["vec"]), *boxes)
        floor, top = np.full(len(a), np.inf), np.full(len(a), -np.inf)
        for i, spans in enumerate(a["windows"].to_pylist()):
            for s in spans:
                bounds = [v for v in (s["lo"], s["floor"]) if v is not None]
                floor[i] = min(floor[i], max(bounds, default=-np.inf))
                top[i] = max(top[i], np.inf if s["hi"] is None else s["hi"])
        home = np.array(a["part"].to_pylist())[:, None] == np.array(r["part"].to_pylist())[None]
        gain = ((most >= floor[:, None]) & (least <= top[:, None]) & ~home).any(0)
        part = r["part"].take(pa.array(np.flatnonzero(gain)))
        return pa.table({"grp": pa.array([key[0].as_py()] * len(part), pa.string()), "part": part})

    # the stated anchors, in groups, against all boxes, in blocks
    n_blocks = max(1, -(-roots.count() // ROOTS))
    blocks = (roots.withColumn("block", F.pmod(F.xxhash64("part"), F.lit(n_blocks)).cast("int"))
              .withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
              .join(opened.select("run", "grp").distinct(), "run").select("grp", "block", "part", "low", "high"))
    blocks = blocks.toDF(*blocks.columns)       # attributes of its own beside ``opened``
    met = opened.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    pairs = materialize(met.groupBy("grp", "block").cogroup(blocks.groupBy("grp", "block"))
                        .applyInArrow(reach, "grp string, part string"), "pairs")

    def away(key: tuple, a: pa.Table, r: pa.Table) -> pa.Table:
        if len(a):
            a = a.filter(pa.array([p != key[1].as_py() for p in a["home"].to_pylist()]))
        return _searched(a, r, same, k)

    left = opened.withColumnRenamed("part", "home").join(pairs, "grp")
    sent = rows.join(pairs, "part")
    sent = sent.toDF(*sent.columns)
    rest = left.groupBy("grp", "part").cogroup(sent.groupBy("grp", "part")).applyInArrow(away, out)
    return _first(first.union(rest), k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, k_pos: int = 5, k_neg: int = 5,
                   percent: tuple[int, int] = (80, 100), id_col: str = "vec_id", vec_col: str = "embedding",
                   label: Column | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score): for each anchor row and each of its ``k_pos`` best other
    rows of its label, the first ``k_neg`` rows of other labels whose score is
    between the two ``percent`` of the positive's; exact.

    A score is the inner product of floor(256 * x).  High scores come first,
    ties by the smaller id.  Rows with a null ``label`` (default: column
    ``label``) or vector, or with null or non-finite components take no part.
    Every repeated row is a row of its own, found once per copy; a null id is
    found (last among ties) and an anchor only if ``is_anchor`` holds.  An
    empty vector has score 0; shorter vectors count as padded with zeros; a
    score beyond a long counts as the nearest long.  A positive of negative
    score has no negatives.  Other columns play no part; no rows, no anchors or
    no other label give no rows.
    """
    label = F.col("label") if label is None else label
    nodes = nodes_of(vectors.filter(label.isNotNull()), F.col(vec_col), id=F.col(id_col), label=label.cast("bigint"),
                     anchor=F.coalesce(is_anchor, F.lit(False)))
    nodes = materialize(nodes, "nodes")
    rows = materialize(_tiled(nodes, _moments(nodes), nodes.count()), "tiles")

    def root(r: pa.Table) -> pa.Table:
        x = unpack(r["vec"])
        box = [b"\x08" + v.astype("<f8").tobytes() for v in (x.min(0), x.max(0))]
        return pa.table({"part": r["part"].slice(0, 1), "low": pa.array(box[:1], pa.binary()),
                         "high": pa.array(box[1:], pa.binary())})

    roots = materialize(rows.select("part", "vec").groupBy("part")
                        .applyInArrow(root, "part string, low binary, high binary"), "roots")
    search = rows.select("id", "label", "node", "vec", "copies", "part")
    anchors = rows.filter("anchor").select("node", "label", "vec", "part", "tile")
    # neighbouring tiles share a group; a crowded run of tiles is dealt by hash
    n_anchors, n_tiles = anchors.agg(F.count("*"), F.max("tile")).first()
    runs = max(1, -(-n_anchors // GROUP))
    anchors = anchors.withColumn("run", F.floor(F.col("tile") * runs / F.lit((n_tiles or 0) + 1)).cast("int"))
    crowd = (anchors.groupBy("run").agg(F.count("*").alias("_n"))
             .select("run", F.ceil(F.col("_n") / GROUP).cast("int").alias("_share")))
    share = F.pmod(F.xxhash64("node"), F.col("_share")).cast("string")
    anchors = materialize(anchors.join(crowd, "run").withColumn(
        "grp", F.concat_ws("-", F.col("run").cast("string"), share)).drop("_share", "tile"), "anchors")

    null = F.lit(None).cast("bigint")

    def window(name: Column, lo: Column, hi: Column) -> Column:
        return F.struct(name.cast("bigint").alias("name"), lo.cast("bigint").alias("lo"),
                        hi.cast("bigint").alias("hi"), null.alias("floor"))

    whole = anchors.withColumn("windows", F.array(window(F.lit(0), null, null)))
    positives = materialize(_nearest(search, roots, whole, runs, True, k_pos), "positives")
    # one window per distinct score of a positive (k_pos at most); exact in decimals
    score = F.col("score").cast("decimal(20,0)")
    lo = F.ceil(score * percent[0] / 100)
    hi = F.floor(score * percent[1] / 100)
    spans = (positives.select("node", "score").distinct().filter(lo <= hi)
             .groupBy("node").agg(F.collect_list(window(F.col("score"), lo, hi)).alias("windows")))
    negatives = _nearest(search, roots, anchors.join(spans, "node"), runs, False, k_neg)
    names = rows.filter("anchor").select("node", F.col("id").alias("anchor_id"), "copies")
    pairs = positives.select("node", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = (pairs.join(negatives.select("node", F.col("window").alias("positive_score"), "rank",
                                       F.col("id").alias("negative_id"), F.col("score").alias("negative_score")),
                      ["node", "positive_score"]).join(names, "node")
           .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))))
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
