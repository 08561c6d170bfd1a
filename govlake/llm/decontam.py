"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over SPAN consecutive words that ignores some
positions, so a substituted word under an ignored position does not hide a
match.  Seeds of benchmark items and of documents are joined by hash; a hit
fixes the diagonal (document position minus item position), and the words
along the diagonal are compared, substitutions allowed.  No allowed
substitution of a passage escapes every seed: MASKS for passages of WINDOW
words, with SHORT_MASKS for items of SPAN words up to WINDOW, and for shorter
items the hash of the whole item, or with one word left out where the overlap
allows it.  Seeds of lengths the benchmark does not have are not made.

Document seeds are first tested against a bitmap of benchmark seeds of a
fixed 16 MB (whatever the size of the benchmark), so only seeds that may hit
are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govlake.llm.textkit import U64, chunks, mix64, seeds, words
from govlake.session import materialize

#: Positions read by each mask; every mask spans SPAN words.
MASKS = ((0, 1, 2, 3, 4, 5), (0, 1, 3, 4, 6, 7), (0, 2, 3, 5, 6, 7), (0, 1, 2, 5, 6, 7), (0, 1, 2, 3, 4, 6))
#: Further masks where the benchmark has items of SPAN words or more, but fewer than WINDOW.
SHORT_MASKS = ((0, 1, 3, 5, 6, 7), (1, 2, 3, 5, 6, 7), (0, 1, 2, 4, 5, 6), (0, 1, 3, 4, 5, 6), (0, 1, 4, 5, 6, 7))
SPAN = 8
#: Overlap: this many words on one diagonal (or the whole item, if shorter),
#: of which at least this share are equal.
WINDOW = 13
MIN_EQUAL = 0.8
BITMAP_BITS = 27


def masks_for(lengths: set[int]) -> list[tuple[int, int, tuple[int, ...]]]:
    """(number, span, positions read) of the masks that items of these word
    counts need; a count above WINDOW counts as WINDOW."""
    out = [(m, SPAN, mask) for m, mask in enumerate(MASKS)] if any(n >= SPAN for n in lengths) else []
    if any(SPAN <= n < WINDOW for n in lengths):
        out += [(len(MASKS) + m, SPAN, mask) for m, mask in enumerate(SHORT_MASKS)]
    for n in sorted(n for n in lengths if 0 < n < SPAN):
        whole = tuple(range(n))
        spare = n - 1 >= MIN_EQUAL * n           # one word may differ
        for j in range(n) if spare else [n]:
            out.append((SPAN * (n + 2) + j, n, tuple(i for i in whole if i != j)))
    return out


def _seeds(w, masks: list[tuple[int, int, tuple[int, ...]]], items: bool):
    """(document, position in the document, hash) of all seeds; of items, a
    mask of less than SPAN words is for whole items only."""
    weight = seeds(SPAN + SPAN * (SPAN + 2), 71)
    n, count = len(w.hash), np.diff(w.first)
    doc = w.doc
    place = np.arange(n) - np.repeat(w.first[:-1], count)
    out = [(doc[:0], place[:0], np.zeros(0, dtype=U64))]
    heads = {}
    for m, span, mask in masks:
        if span not in heads:
            fits = count[doc] == span if items and span < SPAN else count[doc] >= span
            heads[span] = np.flatnonzero(fits & (place <= count[doc] - span))
        head = heads[span]
        value = np.full(len(head), weight[SPAN + m], dtype=U64)
        for j in mask:
            value += w.hash[head + j] * weight[j]
        out.append((doc[head], place[head], mix64(value)))
    return [np.concatenate(x) for x in zip(*out)]


def _lengths(benchmark: DataFrame, item_text: str) -> set[int]:
    """The items' word counts, WINDOW for more: at most WINDOW + 1 numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _lo, _hi, data, off in chunks(b.column("text")):
                n = np.unique(np.minimum(np.diff(words(data, off).first), WINDOW))
                yield pa.RecordBatch.from_arrays([pa.array(n.astype(np.int64))], names=["n"])

    rows = benchmark.select(F.col(item_text).alias("text")).mapInArrow(run, "n bigint").distinct().collect()
    return {r["n"] for r in rows}


def _seed_rows(df: DataFrame, id_col: str, text_col: str, masks: list, bitmap=None) -> DataFrame:
    """(id, place, seed) rows; with a bitmap, of documents, only seeds whose bit is set."""
    src = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).filter("id is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if bitmap is None else bitmap.value
        for b in batches:
            ids = b.column("id").to_numpy(zero_copy_only=False)
            for lo, _hi, data, off in chunks(b.column("text")):
                doc, place, value = _seeds(words(data, off), masks, bits is None)
                if bits is not None:
                    at = value >> U64(64 - BITMAP_BITS)
                    hit = (bits[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8)) & 1 == 1
                    doc, place, value = doc[hit], place[hit], value[hit]
                if len(value):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[doc + lo]), pa.array(place.astype(np.int64)), pa.array(value.view(np.int64))],
                        names=["id", "place", "seed"])

    return src.mapInArrow(run, "id bigint, place bigint, seed bigint")


def _bitmap(seed_rows: DataFrame):
    """The benchmark's seeds as a bitmap of 2^BITMAP_BITS bits, combined in
    Spark; at most 2^BITMAP_BITS / 8 bytes reach the driver."""
    rows = (seed_rows.selectExpr(f"shiftrightunsigned(seed, {64 - BITMAP_BITS}) AS at")
            .selectExpr("shiftright(at, 6) AS w", "shiftleft(1L, CAST(at & 63 AS INT)) AS b")
            .groupBy("w").agg(F.bit_or("b").alias("b")).collect())
    bits = np.zeros(1 << (BITMAP_BITS - 6), dtype=np.int64)
    for r in rows:
        bits[r["w"]] = r["b"]
    return seed_rows.sparkSession.sparkContext.broadcast(bits.view(np.uint8))


def overlap(doc_words: np.ndarray, item_words: np.ndarray, shift: int) -> tuple[int, int] | None:
    """(words covered, words equal) of the longest stretch of the diagonal
    whose windows all qualify, or None."""
    lo, hi = max(0, -shift), min(len(item_words), len(doc_words) - shift)
    need = min(WINDOW, len(item_words))
    if hi - lo < need or need == 0:
        return None
    same = doc_words[lo + shift:hi + shift] == item_words[lo:hi]
    total = np.concatenate([[0], np.cumsum(same)])
    good = total[need:] - total[:-need] >= MIN_EQUAL * need
    if not good.any():
        return None
    covered = np.zeros(hi - lo, dtype=bool)
    for s in np.flatnonzero(good):
        covered[s:s + need] = True
    return int(covered.sum()), int((same & covered).sum())


def find_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_words, n_equal) for every document and benchmark
    item that share a substitution-tolerant overlap: on one diagonal, WINDOW
    consecutive words (the whole item if it is shorter) of which at least
    MIN_EQUAL are equal, with a seed hit inside.  Words are split at white
    space, A-Z lower-cased.  Of several diagonals the one covering most words
    counts.  Null or empty texts and rows of null id match nothing; rows of
    equal id count as one; empty tables give no rows.
    """
    masks = masks_for(_lengths(benchmark, item_text))
    item_seeds = _seed_rows(benchmark, item_col, item_text, masks).distinct()
    item_seeds = materialize(item_seeds, "seeds")
    bitmap = _bitmap(item_seeds)
    hits = _seed_rows(docs, id_col, text_col, masks, bitmap)
    found = (hits.join(item_seeds.select(F.col("id").alias("item"), F.col("place").alias("at"), "seed"), "seed")
             .select("id", "item", (F.col("place") - F.col("at")).alias("shift")).distinct())
    found = materialize(found, "diagonals")
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("_doc"))
    items = benchmark.select(F.col(item_col).cast("bigint").alias("item"), F.col(item_text).alias("_item"))
    per_doc = found.groupBy("id", "item").agg(F.collect_set("shift").alias("shifts"))
    pairs = per_doc.join(items, "item").join(texts, "id").select("id", "item", "shifts", "_item", "_doc")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, item, shifts, it, doc in zip(*(b.column(c).to_pylist() for c in
                                                  ("id", "item", "shifts", "_item", "_doc"))):
                for _lo, _hi, data, off in chunks(pa.array([doc, it], pa.large_string()), 1 << 62):
                    w = words(data, off)
                a, c = w.hash[:w.first[1]], w.hash[w.first[1]:]
                best = max((o for s in shifts if (o := overlap(a, c, s))), default=None)
                if best:
                    rows.append((i, item, *best))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)],
                                                 names=["doc_id", "item_id", "n_words", "n_equal"])

    out = pairs.mapInArrow(verify, "doc_id bigint, item_id bigint, n_words bigint, n_equal bigint")
    return out.groupBy("doc_id", "item_id").agg(F.max("n_words").alias("n_words"), F.max("n_equal").alias("n_equal"))


def contamination(docs: DataFrame, benchmark: DataFrame, **columns: str) -> DataFrame:
    """One row per contaminated document: doc_id, ``items`` (sorted item ids;
    at most the benchmark's), ``n_words`` (most words covered by one item)."""
    return (find_overlaps(docs, benchmark, **columns).groupBy("doc_id")
            .agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.max("n_words").alias("n_words")))
