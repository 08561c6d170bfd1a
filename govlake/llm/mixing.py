"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are cut into blocks.  Block j of a source of share w
is released at floor((j - 1) / w) and due at ceil(j / w), in slots of one
block; earliest deadline first places one block in each slot, so at every slot
a source is less than one block away from its share.  When a source has no
block left, the rest share its weight and a new phase begins; no document is
dropped or repeated.

Shares are the exact rationals of the given weights, so the guarantee holds at
every slot of a phase however long it is and however small a weight.

No task walks the whole schedule.  The phases follow from one number per source,
and a phase is cut every RANGE slots (or as many as its smallest share needs for
one block).  What each source has placed by a cut T is
arithmetic: floor(w T) blocks, and one more for as many sources as are missing
to T.  Which sources get that block is settled by two rules at once: the blocks
of the range before must fit between their releases and the cut, those of the
range after between the cut and their deadlines (``placed``).  So the ranges are
independent, and each is scheduled by a Spark task of its own.  Documents look
their slot up by (source, chunk).  A document's number inside its source comes
from (source, hash bucket) groups and a small table of bucket offsets, so a
source that holds a third of all rows is many groups.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from math import lcm
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

BLOCK_DOCS = 16
BUCKETS = 1024
#: Slots that one task schedules at a time, more only where a share is below 1 / RANGE.
RANGE = 65_536
#: Blocks of a source in one row of the schedule.
CHUNK = 1024
#: The schedule is broadcast up to this many slots (8 MB), joined otherwise.
BROADCAST_NUMBERS = 1_000_000


def placed(shares: dict[str, int], t: int) -> dict[str, int]:
    """Blocks of each source placed in the first ``t`` slots of a phase.

    A source has floor(w t) or one more.  With its parts f = w t - floor(w t), a
    choice of the one mores leaves a schedule on both sides of the cut possible
    if any number of the earliest released blocks, and of the earliest due ones,
    holds at least the whole part of the sum of their f.  Walking the blocks by
    release and taking the earliest due one each time the sum of f passes a whole
    number keeps the first rule, and among the choices that do takes as many early
    due blocks as possible; the fluid schedule shows that one keeps the second."""
    total = sum(shares.values())
    done = {s: w * t // total for s, w in shares.items()}
    begun = [(done[s] * total // w, s, w * t % total) for s, w in shares.items() if w * t % total]
    due: list[tuple[int, str]] = []
    parts, taken = 0, 0
    for _, s, part in sorted(begun):
        heapq.heappush(due, (-(-(done[s] + 1) * total // shares[s]), s))
        parts += part
        if parts // total > taken:
            taken += 1
            done[heapq.heappop(due)[1]] += 1
    return done


def pfair(shares: dict[str, int], start: int, end: int) -> Iterator[str]:
    """The source of each slot of ``start`` to ``end`` of a phase: earliest
    deadline first among the released blocks, with shares of ``shares[s] /
    sum(shares)`` exactly.  Every block of the range is placed inside it."""
    total = sum(shares.values())
    first, last = placed(shares, start), placed(shares, end)
    release = [(max(start, first[s] * total // shares[s]), s, first[s] + 1) for s in shares if first[s] < last[s]]
    heapq.heapify(release)
    ready: list[tuple[int, str, int]] = []
    for t in range(start, end):
        while release and release[0][0] <= t:
            _, s, j = heapq.heappop(release)
            heapq.heappush(ready, (min(end, -(-j * total // shares[s])), s, j))
        _, s, j = heapq.heappop(ready)
        yield s
        if j < last[s]:
            heapq.heappush(release, (max(start, j * total // shares[s]), s, j + 1))


def pfair_period(shares: dict[str, int]) -> dict[str, list[int]]:
    """The slots of each source in the first sum(shares) slots."""
    slots: dict[str, list[int]] = {s: [] for s in shares}
    for t, s in enumerate(pfair(shares, 0, sum(shares.values()))):
        slots[s].append(t)
    return slots


def exact_shares(weights: dict[str, float]) -> dict[str, int]:
    """Integers in exactly the proportion of the weights."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    unit = lcm(*(x.denominator for x in exact.values()))
    return {s: int(x * unit) for s, x in exact.items()}


class Phase(NamedTuple):
    """``length`` slots from ``start`` on by ``shares``; with ``last`` one more
    slot that holds the last block of that source.  ``before``: blocks that lie
    in earlier phases."""

    start: int
    length: int
    shares: dict[str, int]
    last: str | None
    before: dict[str, int]


def phases(blocks: dict[str, int], weights: dict[str, float]) -> Iterator[Phase]:
    """The phases until every block of every source is placed, at most one per
    source.  Sources without a positive weight come last, with equal shares.

    A phase runs to the last whole slot by which no source is owed more blocks
    than it has.  The source that runs out first then has no block left, or one,
    which is due in the next slot and ends the phase there."""
    left = {s: n for s, n in blocks.items() if n > 0}
    shares = exact_shares({s: weights[s] for s in left if weights.get(s, 0.0) > 0})
    start = 0
    while left:
        active = {s: shares[s] for s in left if s in shares} or dict.fromkeys(left, 1)
        total = sum(active.values())
        ends = {s: left[s] * total // w for s, w in active.items()}
        length = min(ends.values())
        done = placed(active, length)
        # both rules of the cut leave at most one block that is due in the next slot
        last = next((s for s in active if ends[s] == length and done[s] < left[s]), None)
        if last is not None:
            done[last] += 1
        yield Phase(start, length, active, last, {s: blocks[s] - left[s] for s in active})
        start += length + (last is not None)
        left = {s: n - done.get(s, 0) for s, n in left.items() if n > done.get(s, 0)}


def cuts(phase: Phase, slots: int = RANGE) -> tuple[int, int]:
    """(number of ranges, slots of a range) of a phase.  Between two cuts every
    source has a block due, so none is counted as placed at one cut and not yet
    at the next; the last range takes the rest."""
    size = max(slots, -(-sum(phase.shares.values()) // min(phase.shares.values())))
    return max(1, phase.length // size), size


def range_slots(phase: Phase, k: int, slots: int = RANGE) -> Iterator[str]:
    """The source of each slot of the phase's range ``k``."""
    n, size = cuts(phase, slots)
    end = (k + 1) * size if k + 1 < n else phase.length
    yield from pfair(phase.shares, k * size, end)
    if phase.last is not None and end == phase.length:
        yield phase.last


def schedule(blocks: dict[str, int], weights: dict[str, float], slots: int = RANGE) -> Iterator[str]:
    """The source of each slot until every block of every source is placed."""
    for phase in phases(blocks, weights):
        for k in range(cuts(phase, slots)[0]):
            yield from range_slots(phase, k, slots)


def _slots(docs: DataFrame, blocks: dict[str, int], weights: dict[str, float], slots: int) -> DataFrame:
    """(source, chunk, at): the slots of each CHUNK blocks of a source.  A task
    gets numbers of ranges, finds their phases from the blocks and weights, and
    schedules them; the parts of a chunk that lies in several ranges are put
    together after (at most CHUNK slots)."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(s: str) -> pa.RecordBatch:
            found = at.pop(s)
            j = done[s] - len(found)                        # number of the first block
            return pa.RecordBatch.from_arrays(
                [pa.array([s]), pa.array([j // CHUNK], pa.int64()), pa.array([j], pa.int64()),
                 pa.array([found], pa.list_(pa.int64()))], names=["source", "chunk", "first", "slots"])

        plan, phase, base, n, size = phases(blocks, weights), None, 0, 0, 0
        for i in (i for b in batches for i in b.column(0).to_pylist()):
            while i >= base + n:
                base, phase = base + n, next(plan)
                n, size = cuts(phase, slots)
            begin = (i - base) * size
            done = {s: phase.before[s] + k for s, k in placed(phase.shares, begin).items()}
            at: dict[str, list[int]] = {}
            for t, s in enumerate(range_slots(phase, i - base, slots), phase.start + begin):
                at.setdefault(s, []).append(t)
                done[s] += 1
                if done[s] % CHUNK == 0:
                    yield row(s)
            for s in list(at):
                yield row(s)

    total = sum(cuts(p, slots)[0] for p in phases(blocks, weights))
    tasks = max(1, min(total, 4 * spark.sparkContext.defaultParallelism))
    parts = spark.range(0, total, 1, tasks).mapInArrow(
        run, "source string, chunk bigint, first bigint, slots array<bigint>")
    return parts.groupBy("source", "chunk").agg(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("first", "slots"))), lambda p: p["slots"])).alias("at"))


def _ordered(field: StructField) -> Column:
    """The column, or its JSON text where its type has no order."""
    c = F.col(f"rec.`{field.name}`")
    name = field.dataType.simpleString()
    return F.to_json(F.struct(c)) if "map<" in name or "variant" in name else c


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, exponent: float = 0.5,
                id_col: str = "doc_id", source_col: str = "source", block_docs: int = BLOCK_DOCS,
                buckets: int = BUCKETS, slots: int = RANGE) -> DataFrame:
    """All rows and columns of ``docs`` plus ``block`` (number inside its
    source), ``slot`` and ``position`` (slot * block_docs + place in the
    block), all long; columns of these names are replaced, no other name can
    clash.  Reading by ``position`` gives the mixture.

    ``weights`` are the target weights by source; without them a source's weight
    is its row count to the power ``exponent``.  One number per source is kept
    on the driver, and a task derives the phases from them in steps of the number
    of sources squared: sources are the components of a mixture, thousands at
    most, not hosts.  Sources without a weight come last.  A null source is a source of
    its own; rows are dealt by the hash of their id, then by id, then by all their columns,
    so equal ids keep their places when a task is run again; no rows give no rows.
    """
    data = [f for f in docs.schema.fields if f.name.lower() not in ("block", "slot", "position")]
    d = docs.select(F.struct(*(F.col(f"`{f.name}`") for f in data)).alias("rec"))
    name = F.coalesce(F.concat(F.lit("s:"), F.col(f"rec.`{source_col}`").cast("string")), F.lit("null"))
    d = d.withColumns({"source": name, "h": F.xxhash64(f"rec.`{id_col}`")}) \
         .withColumn("bucket", F.pmod("h", F.lit(buckets)))
    counts = d.groupBy("source", "bucket").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    # one row per source: the mixture's own list of components
    sizes = {r["source"]: r["n"] for r in d.groupBy("source").agg(F.count("*").alias("n")).collect()}
    if weights is None:
        shares = {s: n ** exponent for s, n in sizes.items()}
    else:
        shares = {"null" if s is None else f"s:{s}": w for s, w in weights.items()}
    blocks = {s: -(-n // block_docs) for s, n in sizes.items()}
    table = _slots(docs, blocks, shares, slots)
    if sum(blocks.values()) <= BROADCAST_NUMBERS:
        table = F.broadcast(table)
    in_bucket = Window.partitionBy("source", "bucket").orderBy(
        "h", F.col(f"rec.`{id_col}`"), *(_ordered(f) for f in data if f.name not in (id_col, source_col)))
    d = (d.withColumn("row", F.row_number().over(in_bucket) - 1)
         .join(offsets, ["source", "bucket"])
         .withColumn("row", F.col("row") + F.col("before"))
         .withColumn("block", F.floor(F.col("row") / block_docs).cast("bigint"))
         .withColumn("chunk", F.floor(F.col("block") / CHUNK).cast("bigint")).join(table, ["source", "chunk"])
         .withColumn("slot", F.get("at", (F.col("block") % CHUNK).cast("int"))))
    return d.select(*(F.col(f"rec.`{f.name}`").alias(f.name) for f in data), "block", "slot",
                    (F.col("slot") * block_docs + F.col("row") % block_docs).alias("position"))
