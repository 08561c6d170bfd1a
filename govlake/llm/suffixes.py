"""Exact substring dedup by a distributed sparse suffix array.

A byte goes if a LENGTH-byte string that covers it also starts in a document of
a smaller id.  Sorting every suffix would move LENGTH bytes per byte of text, so
only anchored suffixes are sorted: the anchor of a LENGTH-byte window is the
position in it whose GRAM bytes come first in a fixed order (by hash, frequent
ones last; leftmost on ties).  Equal windows have their anchors at equal offsets, and one anchor serves about
20 windows that start next to each other.  An anchor's context, the bytes its
windows cover, holds all that must be compared.

1. Map: find anchors and their contexts.  Equal contexts of a chunk are one
   row, that of the smallest id; the others are covered by it already.
2. Contexts go to buckets by the hash of their GRAM bytes.  GRAM bytes that a
   scan of one document in SAMPLE finds to be frequent come last in the order:
   they are anchors only of windows that hold no rarer ones, and those, like a
   line that a third of all documents hold, are few distinct contexts.  So no
   bucket collects the many texts that merely share a frequent string.
3. Bucket: contexts are sorted to the right and to the left of the anchor by
   deep-shallow sorting: by machine words to a shallow depth (the vectorised
   form of multikey quicksort), then every group that is still equal goes
   through a blind trie, which gives its order and its common prefixes.  Two
   contexts share the window that starts o bytes before the anchor if they
   agree on o bytes to the left and LENGTH - o to the right, so for each o the
   ranges of the two sorted orders name the equal windows, and the smallest id
   of each is a minimum by group.
4. Covered ranges meet their documents' texts.

All comparisons are on the bytes themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govlake.llm.textkit import U64, chunks, mix64, seeds, pieces_of
from govlake.session import drop_scratch, materialize

LENGTH = 50
GRAM = 8
LEFT = LENGTH - GRAM              # most bytes of a context before its anchor
WIDTH = LEFT + LENGTH             # and most bytes in all
ROW = -(-WIDTH // 8) * 8          # stored width, whole machine words
SHALLOW = 16
CHUNK = 4 << 20
#: Bytes of text in a block, at most about (one longer document apart): what a task holds.
BLOCK_BYTES = 32 << 20
#: GRAM bytes are frequent from this share of all positions on, 1 / (SHARE *
#: shuffle partitions) but LEAST_SHARE at least, so there are at most
#: 1 / LEAST_SHARE of them.
SHARE = 400
LEAST_SHARE = 1e-6
SAMPLE = 64

_COLUMNS = np.arange(ROW, dtype=np.uint8)


def _gram_view(data: np.ndarray) -> np.ndarray:
    return np.ndarray((len(data) - GRAM + 1,), "<u8", np.ascontiguousarray(data), strides=(1,))


def _anchors(data: np.ndarray, off: np.ndarray, late: np.ndarray):
    """(anchor, first window, last window, document) of all runs of windows
    that share an anchor; windows never cross documents.  ``late`` is a table
    over the top bits of the hash: its marked ones come last in the order."""
    n = len(data) - LENGTH + 1
    none = np.zeros(0, dtype=np.int64)
    if n <= 0:
        return none, none, none, none
    low = mix64(_gram_view(data))
    last_ones = late[(low >> U64(64 - len(late).bit_length() + 1)).astype(np.int64)]
    low >>= U64(1)
    low &= U64(0x7FFFFFFF00000000)
    low |= np.arange(len(low), dtype=U64)
    low[last_ones] |= U64(1 << 63)
    width = 1
    while 2 * width <= LEFT + 1:                       # sliding minimum by doubling
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = LEFT + 1 - width
    if rest:
        low = np.minimum(low[:-rest], low[rest:])
    at = (low & U64(0xFFFFFFFF)).astype(np.int64)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))[:n]
    at[np.arange(n) + LENGTH > off[1:][doc]] = -1
    new = np.ones(n, dtype=bool)
    new[1:] = at[1:] != at[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], n) - 1
    real = at[first] >= 0
    first, last = first[real], last[real]
    return at[first], first, last, doc[first]


def _inside(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return (_COLUMNS >= lo.astype(np.uint8)[:, None]) & (_COLUMNS < hi.astype(np.uint8)[:, None])


def _contexts(data: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Context bytes, the anchor at column LEFT; zero outside [lo, hi)."""
    padded = np.concatenate([np.zeros(LEFT, np.uint8), data, np.zeros(ROW, np.uint8)])
    out = np.lib.stride_tricks.sliding_window_view(padded, ROW)[at]
    out *= _inside(lo, hi)
    return out


def _row_hash(rows: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    words = np.ascontiguousarray(rows).view("<u8")
    salt = seeds(words.shape[1] + 1, 53)
    out = (lo * 256 + hi).astype(U64) * salt[-1]
    for j in range(words.shape[1]):
        out = mix64(out + words[:, j]) * salt[j]
    return out


def _classes(rows: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first) grouping equal contexts: ``order`` brings equal rows
    together, ``first`` marks where a class begins in it."""
    order = np.argsort(_row_hash(rows, lo, hi), kind="stable")
    x, a, b = rows[order].view("<u8"), lo[order], hi[order]
    first = np.ones(len(order), dtype=bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (x[1:] != x[:-1]).any(1)
    return order, first


def _grams(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows[:, LEFT:LEFT + GRAM]).view("<u8").ravel()


def _pack(n: int, *columns: np.ndarray) -> bytes:
    return zstandard.compress(n.to_bytes(8, "little") + b"".join(np.ascontiguousarray(c).tobytes() for c in columns), 3)


def _planes(x: np.ndarray) -> np.ndarray:
    """The bytes of whole numbers, one plane after the other."""
    return np.ascontiguousarray(x.astype("<i8").view("u1").reshape(-1, 8).T)


def _whole(planes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<i8").ravel()


def _open(blob: bytes, *types: str) -> tuple[list[np.ndarray], bytes]:
    """The columns of a packed blob, and what follows them."""
    raw = zstandard.decompress(blob)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for t in types:
        out.append(np.frombuffer(raw, t, n, at))
        at += n * np.dtype(t).itemsize
    return out, raw[at:]


def _pack_contexts(ids, tags, pos, lo, hi, rows) -> bytes:
    """Ids as differences, and only the bytes inside [lo, hi)."""
    return _pack(len(ids), tags.astype("<u4"), lo.astype("u1"), hi.astype("u1"),
                 _planes(np.diff(ids, prepend=0)), _planes(pos), rows[_inside(lo, hi)])


def _open_contexts(blobs) -> list[np.ndarray]:
    parts: list[list[np.ndarray]] = [[] for _ in range(6)]
    for blob in blobs:
        (tags, lo, hi), raw = _open(blob, "<u4", "u1", "u1")
        raw, n = np.frombuffer(raw, np.uint8), len(tags)
        rows = np.zeros((n, ROW), dtype=np.uint8)
        rows[_inside(lo, hi)] = raw[16 * n:]
        for part, x in zip(parts, (np.cumsum(_whole(raw[:8 * n])), tags, _whole(raw[8 * n:16 * n]), lo, hi, rows)):
            part.append(x)
    return [np.concatenate(p) for p in parts]


def _open_ranges(blobs) -> list[np.ndarray]:
    """id, tag, start, end"""
    parts = [_open(blob, "<i8", "<u4", "<i8", "<i8")[0] for blob in blobs]
    return [np.concatenate(p) for p in zip(*parts)]


def _block_of(ids: np.ndarray, n_blocks: int) -> np.ndarray:
    return (mix64(ids.astype(U64)) % U64(n_blocks)).astype(np.int64)


def _ranges_by_block(ids, tags, start, end, n_blocks: int) -> list[tuple[int, bytes]]:
    block = _block_of(ids, n_blocks)
    order = np.argsort(block, kind="stable")
    cuts = np.searchsorted(block[order], np.arange(n_blocks + 1))
    out = []
    for b in np.flatnonzero(np.diff(cuts)):
        rows = order[cuts[b]:cuts[b + 1]]
        out.append((int(b), _pack(len(rows), ids[rows].astype("<i8"), tags[rows].astype("<u4"),
                                  start[rows].astype("<i8"), end[rows].astype("<i8"))))
    return out


def _late(docs: DataFrame, parts: int) -> np.ndarray:
    """Table of the frequent GRAM bytes, by the top bits of their hash, from
    one document in SAMPLE.  It only sets the order of anchors, which any
    choice leaves right; its size is bounded by LEAST_SHARE."""
    share = max(LEAST_SHARE, 1 / (SHARE * parts))
    sample = docs.filter(F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(SAMPLE)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _lo, _hi, data, _off in chunks(b.column("text"), CHUNK):
                if len(data) < GRAM:
                    continue
                gram, n = np.unique(_gram_view(data), return_counts=True)
                often = n >= max(2, share * len(data) / 2)          # at most 2 / share of them
                rows = [np.append(gram[often].view(np.int64), 0), np.append(n[often], 0),
                        np.append(np.zeros(often.sum(), dtype=np.int64), len(data))]
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in rows],
                                                 names=["gram", "n", "total"])

    counts = materialize(sample.select("text").mapInArrow(run, "gram bigint, n bigint, total bigint")
                         .groupBy("gram").agg(F.sum("n").alias("n"), F.sum("total").alias("total")), "grams")
    total = counts.agg(F.sum("total").alias("n")).first()["n"] or 0
    rows = counts.filter(F.col("n") >= max(16, total * share)).select("gram").collect()    # at most 1 / share
    drop_scratch(counts)
    size = min(26, max(16, (64 * len(rows)).bit_length()))
    late = np.zeros(1 << size, dtype=bool)
    grams = np.array([r["gram"] for r in rows], dtype=np.int64).view(U64)
    late[(mix64(grams) >> U64(64 - size)).astype(np.int64)] = True
    return late


def _map(docs: DataFrame, table, buckets: int, n_blocks: int) -> DataFrame:
    """(bucket, kind, block, data): packed contexts (kind 0), and ranges that a
    chunk's own documents cover already (kind 1)."""

    def chunk_rows(ids, tags, data, off):
        at, first, last, doc = _anchors(data, off, table.value)
        if not len(at):
            return
        lo, hi = first - at + LEFT, last + LENGTH - at + LEFT
        rows = _contexts(data, at, lo, hi)
        route = mix64(_grams(rows) * seeds(1, 61)[0])
        pos = at - off[:-1][doc]
        # equal contexts of this chunk: the smallest id stands for them
        order, new = _classes(rows, lo, hi)
        group = np.cumsum(new) - 1
        least = np.minimum.reduceat(ids[doc[order]], np.flatnonzero(new))[group]
        covered = order[ids[doc[order]] > least]
        if len(covered):
            start = pos[covered] + lo[covered] - LEFT
            for block, blob in _ranges_by_block(ids[doc[covered]], tags[doc[covered]], start,
                                                start + hi[covered] - lo[covered], n_blocks):
                yield block % buckets, 1, block, blob
        ship = np.sort(order[ids[doc[order]] == least])
        bucket = ((route[ship] >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        ship = ship[by]
        cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)):
            r = ship[cuts[b]:cuts[b + 1]]
            yield int(b), 0, -1, _pack_contexts(ids[doc[r]], tags[doc[r]], pos[r], lo[r], hi[r], rows[r])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("id").to_numpy(zero_copy_only=False)
            tags = b.column("tag").to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi, data, off in chunks(b.column("text"), CHUNK):
                out = list(chunk_rows(ids[lo:hi], tags[lo:hi], data, off))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int32()),
                         pa.array([r[2] for r in out], pa.int32()), pa.array([r[3] for r in out], pa.binary())],
                        names=["bucket", "kind", "block", "data"])

    return docs.select("id", "tag", "text").mapInArrow(run, "bucket int, kind int, block int, data binary")


def blind_trie(strings: list[bytes]) -> list[tuple[int, int]]:
    """(index, common prefix with the one before) of equal-length strings in
    sorted order.  The trie keeps only branching depths and characters: an
    insertion descends without comparing, then compares once with the leaf it
    reached."""
    width = len(strings[0])
    number = [int.from_bytes(s, "big") for s in strings]

    def common(i: int, j: int) -> int:
        return width - (((number[i] ^ number[j]).bit_length() + 7) >> 3)

    # a node is [depth, {character: child}], a leaf the list of its equal strings
    root: list = [0]
    leaf_root = True
    for i in range(1, len(strings)):
        s = strings[i]
        node, leaf = root, leaf_root
        while not leaf:
            kids = node[1]
            node = kids.get(s[node[0]]) or next(iter(kids.values()))
            leaf = not (len(node) == 2 and isinstance(node[1], dict))
        depth = common(node[0], i)
        if depth == width:
            node.append(i)
            continue
        old = strings[node[0]][depth]
        parent, node, leaf = None, root, leaf_root
        while not leaf and node[0] < depth:
            parent, node = node, node[1][s[node[0]]]
            leaf = not (len(node) == 2 and isinstance(node[1], dict))
        if not leaf and node[0] == depth:
            node[1][s[depth]] = [i]
            continue
        branch = [depth, {old: node, s[depth]: [i]}]
        if parent is None:
            root, leaf_root = branch, False
        else:
            parent[1][s[parent[0]]] = branch
    out: list[tuple[int, int]] = []
    stack: list[tuple[list, int, bool]] = [(root, 0, leaf_root)]
    while stack:
        node, shared, leaf = stack.pop()
        if leaf:
            for k, i in enumerate(node):
                out.append((i, shared if k == 0 else width))
            continue
        depth, kids = node
        for k, c in sorted(enumerate(sorted(kids)), reverse=True):
            child = kids[c]
            stack.append((child, shared if k == 0 else depth,
                          not (len(child) == 2 and isinstance(child[1], dict))))
    return out


def deep_shallow(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common prefix with the row before) of equal-length byte rows:
    machine words to depth SHALLOW, blind tries below."""
    n, width = rows.shape
    depth = min(SHALLOW, -(-width // 8) * 8)
    head = np.zeros((n, depth), dtype=np.uint8)
    head[:, :min(depth, width)] = rows[:, :depth]
    keys = head.view(">u8").astype(U64)
    order = np.lexsort(keys.T[::-1])
    rows = rows[order]
    lcp = np.zeros(n, dtype=np.int64)
    if n > 1:
        differ = rows[1:, :depth] != rows[:-1, :depth]
        some = differ.any(1)
        lcp[1:] = np.where(some, differ.argmax(1), min(depth, width))
    if width <= depth:
        return order, lcp
    begin = np.flatnonzero(lcp < depth)
    end = np.append(begin[1:], n)
    for a, b in zip(begin[end - begin > 1], end[end - begin > 1]):
        raw = rows[a:b, depth:].tobytes()
        w = width - depth
        got = blind_trie([raw[k * w:(k + 1) * w] for k in range(b - a)])
        lcp[a + 1:b] = [depth + c for _, c in got[1:]]
        order[a:b] = order[a:b][[i for i, _ in got]]
    return order, lcp


def shared_windows(ids: np.ndarray, lo: np.ndarray, hi: np.ndarray, rows: np.ndarray):
    """(first, last) column of the bytes of each context that windows shared
    with a smaller id cover; last = 0 where there is none."""
    n = len(ids)
    start, end = np.full(n, WIDTH), np.zeros(n, dtype=np.int64)
    right_order, right_lcp = deep_shallow(np.ascontiguousarray(rows[:, LEFT:WIDTH]))
    left_order, left_lcp = deep_shallow(np.ascontiguousarray(rows[:, :LEFT][:, ::-1]))
    right, left = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for o in range(LEFT + 1):                           # the window that starts o bytes before the anchor
        has = np.flatnonzero((LEFT - o >= lo) & (LEFT - o + LENGTH <= hi))
        if len(has) < 2:
            continue
        right[right_order] = np.cumsum(right_lcp < LENGTH - o)
        left[left_order] = np.cumsum(left_lcp < o) if o else 0
        key = right[has] * (n + 1) + left[has]
        by = np.argsort(key, kind="stable")
        key = key[by]
        new = np.ones(len(by), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        least = np.minimum.reduceat(ids[has[by]], np.flatnonzero(new))[np.cumsum(new) - 1]
        hit = has[by][ids[has[by]] > least]
        start[hit] = np.minimum(start[hit], LEFT - o)
        end[hit] = np.maximum(end[hit], LEFT - o + LENGTH)
    return start, end


def _covered(contexts: DataFrame, n_blocks: int) -> DataFrame:
    """(block, data): packed covered ranges of documents, by document block."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        own = g["kind"] == 1
        out = list(zip(g.loc[own, "block"].astype(int), g.loc[own, "data"]))
        blobs = list(g.loc[~own, "data"])
        if blobs:
            ids, tags, pos, lo, hi, rows = _open_contexts(blobs)
            lo, hi = lo.astype(np.int64), hi.astype(np.int64)
            # contexts whose GRAM bytes occur in one document only share nothing
            order = np.argsort(_grams(rows), kind="stable")
            gram = _grams(rows)[order]
            new = np.ones(len(order), dtype=bool)
            new[1:] = gram[1:] != gram[:-1]
            at, group = np.flatnonzero(new), np.cumsum(new) - 1
            several = np.minimum.reduceat(ids[order], at) != np.maximum.reduceat(ids[order], at)
            pick = order[several[group]]
            if len(pick):
                ids, tags, pos, lo, hi, rows = (x[pick] for x in (ids, tags, pos, lo, hi, rows))
                order, first = _classes(rows, lo, hi)
                klass = np.empty(len(order), dtype=np.int64)
                klass[order] = np.cumsum(first) - 1
                heads = np.flatnonzero(first)
                least = np.minimum.reduceat(ids[order], heads)
                head = order[heads]
                start, end = shared_windows(least, lo[head], hi[head], rows[head])
                start, end = start[klass], end[klass]
                later = ids > least[klass]               # an equal context of a smaller id covers all of it
                start, end = np.where(later, lo, start), np.where(later, hi, end)
                hit = np.flatnonzero(end > 0)
                out += _ranges_by_block(ids[hit], tags[hit], pos[hit] + start[hit] - LEFT,
                                        pos[hit] + end[hit] - LEFT, n_blocks)
        return pd.DataFrame(out, columns=["block", "data"])

    return contexts.groupBy("bucket").applyInPandas(run, "block int, data binary")


def _cut(text: bytes, start: np.ndarray, end: np.ndarray) -> tuple[bytes, int, int]:
    """(bytes kept, bytes removed, maximal removed runs)."""
    if not len(start):
        return text, 0, 0
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), dtype=bool)
    new[1:] = start[1:] > end[:-1]
    a = start[new]
    b = end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]
    kept, at = [], 0
    for x, y in zip(a.tolist(), b.tolist()):
        kept.append(text[at:x])
        at = y
    kept.append(text[at:])
    return b"".join(kept), int((b - a).sum()), len(a)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id column, n_bytes, n_removed, n_spans
    (maximal removed runs) and ``kept`` (the remaining bytes).

    Texts are UTF-8 bytes; a null text is empty.  Removed is every byte that a
    LENGTH-byte string covers which also starts in a document with a smaller
    id, judged on the input; strings never cross documents.  The id must be an
    integer; rows that share an id remove nothing from each other; a row whose
    id is null loses nothing and removes nothing; no rows give no rows.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_blocks = pieces_of(docs, text_col, 2 * parts, BLOCK_BYTES)
    buckets = 2 * n_blocks
    src = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    # rows that share an id are told apart by their text
    repeated = not src.filter("id is not null").groupBy("id").count().filter("count > 1").isEmpty()
    tag = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(1 << 32)) if repeated else F.lit(0).cast("bigint")
    src = src.withColumn("tag", tag)
    named = src.filter("id is not null")
    table = spark.sparkContext.broadcast(_late(named, parts))       # at most 64 MB, by LEAST_SHARE
    ranges = _covered(_map(named, table, buckets, n_blocks), n_blocks)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts by block, each block's of a chunk compressed together."""
        for b in batches:
            ids = b.column("id").fill_null(0).to_numpy(zero_copy_only=False)
            null = b.column("id").is_null().to_numpy(zero_copy_only=False)
            tags = b.column("tag").to_numpy(zero_copy_only=False)
            for lo, hi, data, off in chunks(b.column("text"), CHUNK):
                block = _block_of(ids[lo:hi], n_blocks)
                order = np.argsort(block, kind="stable")
                cuts = np.searchsorted(block[order], np.arange(n_blocks + 1))
                out = []
                for k in np.flatnonzero(np.diff(cuts)):
                    r = order[cuts[k]:cuts[k + 1]]
                    raw = b"".join(data[off[i]:off[i + 1]].tobytes() for i in r)
                    out.append((int(k), _pack(len(r), ids[lo + r].astype("<i8"), null[lo + r].astype("u1"),
                                              tags[lo + r].astype("<u4"), np.diff(off)[r].astype("<i8"),
                                              np.frombuffer(raw, np.uint8))))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()),
                                                      pa.array([x[1] for x in out], pa.binary())],
                                                     names=["block", "data"])

    dealt = src.mapInArrow(deal, "block int, data binary")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        ids = tags = start = end = np.zeros(0, dtype=np.int64)
        if len(right):
            ids, tags, start, end = _open_ranges(right["data"])
            order = np.lexsort((tags, ids))
            ids, tags, start, end = ids[order], tags[order], start[order], end[order]
        for blob in left["data"]:
            (own, null, own_tag, size), raw = _open(blob, "<i8", "u1", "<u4", "<i8")
            a, b = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
            at = np.concatenate([[0], np.cumsum(size)])
            for k in range(len(own)):
                lo, hi = (0, 0) if null[k] else (a[k], b[k])
                lo, hi = lo + np.searchsorted(tags[lo:hi], own_tag[k], "left"), \
                    lo + np.searchsorted(tags[lo:hi], own_tag[k], "right")
                kept, removed, spans = _cut(raw[at[k]:at[k + 1]], start[lo:hi], end[lo:hi])
                out.append((None if null[k] else int(own[k]), int(size[k]), removed, spans, kept))
        frame = pd.DataFrame(out, columns=["id", "n_bytes", "n_removed", "n_spans", "kept"])
        return frame.astype({"id": "Int64"})

    out = (dealt.groupBy("block").cogroup(ranges.groupBy("block"))
           .applyInPandas(run, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"))
    return out.withColumnRenamed("id", id_col)

