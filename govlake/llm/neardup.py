"""MinHash near-duplicates with sequential Bayesian verification.

1. Every document gets 128 min-hashes of its word shingles.  Documents with
   the same word sequence are one class, stood for by the smallest id.
2. 32 bands of 4 min-hashes give buckets.  A bucket's members are compared
   with its smallest member.  Members of buckets that are then still in several
   components are compared across components by an exact prefix filter
   (``_crossing``), so no pairs of a whole bucket are formed.
3. A pair's signatures are compared batch by batch.  After each batch the
   posterior of its similarity (uniform prior, so a Beta distribution) tells
   the chance that it reaches the threshold; below MISS the pair is dropped.
4. Surviving pairs are decided on their full shingle sets.
5. Links are joined into components.

At similarity 0.8 a pair shares no band with probability (1 - 0.8^4)^32, 5e-8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from govlake.llm.graph import components
from govlake.llm.textkit import U64, chunks, distinct_pairs, mix64, seeds, shingles, words
from govlake.session import materialize

BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
BATCH = 16
#: Chance at which a pair above the threshold may be dropped at one batch.
MISS = 1e-7
#: Bits of the parity sketch.
SKETCH = 512
_SKETCH_COLUMNS = [f"parity{j}" for j in range(SKETCH // 64)]


def signatures(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, cls (hash of the word sequence, null without words) and
    sig (128 little-endian 32-bit min-hashes, null without words)."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor = seeds(HASHES, 97)
        for b in batches:
            for lo, hi, data, off in chunks(b.column("text")):
                w = words(data, off)
                doc, value = distinct_pairs(*shingles(w, k))
                n = np.bincount(doc, minlength=hi - lo)
                full = np.flatnonzero(n)
                at = np.concatenate([[0], np.cumsum(n)])[:-1][full]
                sig = np.empty((len(full), HASHES), dtype="<u4")
                for j in range(HASHES):
                    if len(full):
                        sig[:, j] = np.minimum.reduceat(value * factor[j], at) >> U64(32)
                raw = w.hash.astype("<u8").tobytes()
                cls: list[bytes | None] = [None] * (hi - lo)
                out: list[bytes | None] = [None] * (hi - lo)
                for row, i in enumerate(full):
                    cls[i] = hashlib.blake2b(raw[8 * w.first[i]:8 * w.first[i + 1]], digest_size=16).digest()
                    out[i] = sig[row].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").slice(lo, hi - lo), pa.array(n.astype(np.int64)),
                     pa.array(cls, pa.binary()), pa.array(out, pa.binary())],
                    names=["id", "n_shingles", "cls", "sig"])

    return src.mapInArrow(run, f"id {kind}, n_shingles bigint, cls binary, sig binary")


def _bands(reps: DataFrame) -> DataFrame:
    """(key, id): one row per band of each class representative."""
    kind = reps.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = seeds(ROWS, 131)
        for b in batches:
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), dtype="<u4")
            sig = sig.reshape(-1, BANDS, ROWS).astype(U64)
            key = (sig * weight).sum(2, dtype=U64) * U64(64) + np.arange(BANDS, dtype=U64)
            ids = pa.array(np.repeat(np.arange(len(sig)), BANDS))
            yield pa.RecordBatch.from_arrays(
                [pa.array(mix64(key.ravel()).view(np.int64)), b.column("id").take(ids)], names=["key", "id"])

    return reps.select("id", "sig").mapInArrow(run, f"key bigint, id {kind}")


def least_matches(threshold: float, miss: float = MISS) -> list[tuple[int, int]]:
    """(hashes compared, fewest matches that keep a pair) after each batch."""
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail, m = 0.0, 0
        while m <= n:                # P(similarity >= threshold | m of n match), Beta(1 + m, 1 + n - m)
            tail += comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def _surviving(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose signatures leave a similarity of ``threshold`` possible."""
    sig = reps.select("id", "sig")              # an id with several texts has several signatures
    both = (pairs.join(sig.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
            .join(sig.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").select("a", "b", "sa", "sb"))
    steps = least_matches(threshold)
    kind = reps.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), dtype="<u4").reshape(-1, HASHES)
                    for c in ("sa", "sb"))
            alive, matches, done = np.arange(len(x)), np.zeros(len(x), dtype=np.int64), 0
            for n, least in steps:
                matches = matches + (x[alive, done:n] == y[alive, done:n]).sum(1)
                keep = matches >= least
                alive, matches, done = alive[keep], matches[keep], n
            yield pa.RecordBatch.from_arrays([b.column(c).take(pa.array(alive)) for c in ("a", "b")],
                                             names=["a", "b"])

    return both.mapInArrow(run, f"a {kind}, b {kind}")


def _linked(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs whose full shingle sets reach the threshold."""
    kind = pairs.schema["a"].dataType.simpleString()
    both = (pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
            .join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(b.num_rows, dtype=bool)
            left, right = (chunks_of_sets(b.column(c), k) for c in ("ta", "tb"))
            for i, (x, y) in enumerate(zip(left, right)):
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = common > 0 and 100 * common >= percent * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(keep)) for c in ("a", "b")],
                                             names=["a", "b"])

    return both.mapInArrow(run, f"a {kind}, b {kind}")


def chunks_of_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The distinct shingles of each text in turn."""
    for lo, hi, data, off in chunks(column):
        doc, value = distinct_pairs(*shingles(words(data, off), k))
        at = np.searchsorted(doc, np.arange(hi - lo + 1))
        for i in range(hi - lo):
            yield value[at[i]:at[i + 1]]


def _sketches(texts: DataFrame, k: int) -> DataFrame:
    """id, text number and the parity of each hash bucket of its shingles, as 64-bit words."""
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            odd = np.zeros((b.num_rows, SKETCH), dtype=np.uint8)
            for i, x in enumerate(chunks_of_sets(b.column("text"), k)):
                odd[i] = np.bincount((x % U64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
            words_ = np.packbits(odd, axis=1).view("<i8")
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("t"),
                 *(pa.array(np.ascontiguousarray(words_[:, j])) for j in range(SKETCH // 64))],
                names=["id", "t", *_SKETCH_COLUMNS])

    return texts.select("id", "t", "text").mapInArrow(
        run, f"id {kind}, t bigint, " + ", ".join(f"{c} bigint" for c in _SKETCH_COLUMNS))


def _crossing(members: DataFrame, comp: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Candidate pairs (a, b) in different components, none missing, among the
    members of buckets that still hold several components.

    A pair at the threshold shares at least percent % of the larger set, so if
    each set's shingles are ordered from rare to frequent, the first
    size - ceil(percent % of size) + 1 of both hold a common one.  A pair meets
    there only if the threshold is within reach from its first common shingle:
    if that stands at places i and j, the sets have at most
    1 + min(size of a - i, size of b - j) in common.  Shingles of one component
    only come first, so copies edited too much have no place left to meet.  And
    the parities of the sets' hash buckets (SKETCH bits) differ in at most as
    many places as the sets do, which the threshold bounds.
    """
    placed = (members.join(comp, "id", "left").select("key", "id", F.coalesce("component", "id").alias("c")))
    several = (placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
               .filter("lo != hi").select("key"))
    open_ = placed.join(several, "key").select("id", "c").distinct()
    kind, comp_kind = (open_.schema[c].dataType.simpleString() for c in ("id", "c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, x in enumerate(chunks_of_sets(b.column("text"), k)):
                at = pa.array(np.full(len(x), i))
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").take(at), b.column("t").take(at), b.column("c").take(at), pa.array(x.view(np.int64)),
                     pa.array(np.full(len(x), len(x), dtype=np.int64))], names=["id", "t", "c", "shingle", "size"])

    sets = texts.join(open_, "id").select("id", "t", "c", "text").mapInArrow(
        run, f"id {kind}, t bigint, c {comp_kind}, shingle bigint, size bigint")
    sets = materialize(sets, "sets")
    spread = sets.groupBy("shingle").agg(F.count("*").alias("df"), F.min("c").alias("lo"), F.max("c").alias("hi"))
    # a shingle of one component only is as good as a shingle of one set
    spread = spread.withColumn("shared", (F.col("lo") != F.col("hi")).cast("int"))
    rare_first = Window.partitionBy("id", "t").orderBy("shared", "df", "shingle")
    head = (sets.join(spread, "shingle").withColumn("rank", F.row_number().over(rare_first))
            .filter(F.col("rank") <= F.col("size") - F.ceil(F.col("size") * percent / 100) + 1)
            .filter("shared = 1")
            .select("shingle", "id", "t", "c", "size", "rank"))
    head = materialize(head, "prefixes")
    named = head.select("id").distinct()
    head = head.join(_sketches(texts.join(named, "id", "left_semi"), k), ["id", "t"]).select(
        "shingle", "id", "c", "size", "rank", *_SKETCH_COLUMNS)
    x = head.toDF("shingle", "a", "ca", "sa", "ia", *(f"a_{c}" for c in _SKETCH_COLUMNS))
    y = head.toDF("shingle", "b", "cb", "sb", "ib", *(f"b_{c}" for c in _SKETCH_COLUMNS))
    apart = sum(F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in _SKETCH_COLUMNS)
    both = F.col("sa") + F.col("sb")
    most = 1 + F.least(F.expr("sa - ia"), F.expr("sb - ib"))
    reach = ((F.col("ca") < F.col("cb")) & (100 * most >= percent * (both - most))
             & (apart <= both - 2 * F.ceil(percent * both / (100 + percent))))
    return x.join(y, (x["shingle"] == y["shingle"]) & reach).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id column, n_shingles (size of the set of
    distinct k-word shingles), component_id (smallest id reachable by links,
    itself included), kept (id is its component's smallest).

    Words are split at white space with A-Z lower-cased; a text of fewer than
    k words is one shingle; a null or empty text has none and links with
    nothing.  Two texts link if 100 * intersection >= percent * union.  Rows
    that share an id are one node; a row of null id stays alone (component
    null, kept); no rows give no rows.
    """
    sigs = materialize(signatures(docs, k, id_col, text_col), "signatures")
    classes = sigs.filter("cls is not null and id is not null").groupBy("cls").agg(F.min("id").alias("rep"))
    classes = materialize(classes, "classes")
    reps = sigs.join(classes.select(F.col("rep").alias("id"), "cls"), ["id", "cls"]).dropDuplicates(["id", "cls"])
    reps = materialize(reps.select("id", "sig"), "reps")
    # an id with texts of several classes joins them
    several = (sigs.filter("cls is not null and id is not null").groupBy("id")
               .agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).filter("lo != hi").select("id"))
    of_id = sigs.join(several, "id").join(classes, "cls").select("id", "rep").distinct()
    low = of_id.groupBy("id").agg(F.min("rep").alias("a"))
    same_id = materialize(of_id.join(low, "id").select("a", F.col("rep").alias("b")), "same-id")
    buckets = _bands(reps)
    shared = buckets.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("low")).filter("n > 1")
    buckets = materialize(buckets.join(shared.select("key", "low"), "key"), "buckets")
    pairs = buckets.filter("id != low").select(F.col("low").alias("a"), F.col("id").alias("b")).distinct()
    members = buckets.select("key", "id")
    named = members.select("id").distinct()
    texts = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
             .join(named, "id", "left_semi").withColumn("t", F.xxhash64("text")).dropDuplicates(["id", "t"]))
    texts = materialize(texts, "texts")
    close = materialize(_surviving(pairs, reps, percent / 100), "pairs")
    links = materialize(_linked(close, texts, k, percent).union(same_id), "linked")
    comp = materialize(components(links), "components")
    cross = _surviving(_crossing(members, comp, texts, k, percent), reps, percent / 100)
    more = materialize(_linked(cross, texts, k, percent), "crossing")
    if not more.isEmpty():
        comp = materialize(components(links.union(more)), "components")
    of_class = (classes.join(comp.select(F.col("id").alias("rep"), "component"), "rep", "left")
                .select("cls", F.coalesce("component", "rep").alias("component")))
    out = sigs.select("id", "n_shingles", "cls").join(of_class, "cls", "left")
    out = out.select(F.col("id").alias(id_col), "n_shingles",
                     F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
