"""Vectorised words and shingles of Arrow text columns, used inside tasks.

Texts are handled as UTF-8 bytes in chunks of whole documents, so memory is
bounded by the chunk (or by one document that is longer than a chunk).  A
word's 64-bit hash is a polynomial over its lower-cased (A-Z) bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U64 = np.uint64
CHUNK_BYTES = 1 << 20

#: Space and 0x09-0x0D.
WHITE = np.zeros(256, dtype=bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
#: Every ASCII byte that is neither a letter nor a digit.
NON_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = np.asarray(x, dtype=U64).copy()
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def seeds(n: int, salt: int) -> np.ndarray:
    """``n`` fixed odd multipliers."""
    return mix64(np.arange(1, n + 1, dtype=U64) * U64(_BASE) + U64(salt)) | U64(1)


_BYTE = seeds(256, 11)
_powers: dict[str, np.ndarray] = {}


def _powers_of(name: str, base: int, n: int) -> np.ndarray:
    got = _powers.get(name)
    if got is None or len(got) < n:
        full = np.full(max(n, CHUNK_BYTES + 16), U64(base), dtype=U64)
        full[0] = 1
        got = np.cumprod(full, dtype=U64)
        if n <= 8 * CHUNK_BYTES:             # one very long text is not remembered
            _powers[name] = got
    return got[:n]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values (null: empty) and n + 1 offsets into them."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole documents."""
    data, off = text_buffers(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi, data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        lo = hi


@dataclass
class Words:
    hash: np.ndarray     # one 64-bit hash per word
    start: np.ndarray    # byte offsets inside the chunk
    end: np.ndarray
    first: np.ndarray    # n_docs + 1 offsets into the words
    sums: np.ndarray     # prefix sums of the polynomial

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def prefix_hash(self, n: int) -> np.ndarray:
        """Hash of each word's first ``n`` bytes (of the whole word if shorter)."""
        return _span_hash(self.sums, self.start, np.minimum(self.end, self.start + n))


def _span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    inverse = _powers_of("inverse", _INVERSE, len(sums) + 1)
    return mix64((sums[end] - sums[start]) * inverse[start])


def words(data: np.ndarray, off: np.ndarray, separators: np.ndarray = WHITE) -> Words:
    """Maximal runs of bytes that are no separators, inside each document."""
    n = len(data)
    inside = np.zeros(n + 1, dtype=bool)
    inside[:n] = ~separators[data]
    before = np.zeros(n + 1, dtype=bool)
    before[1:] = inside[:-1]
    before[off] = False                      # a document's first byte has nothing before it
    start = np.flatnonzero(inside & ~before)
    last = inside[:n] & ~np.append(inside[1:n], False) if n else np.zeros(0, dtype=bool)
    edges = off[1:-1]
    edges = edges[(edges > 0) & (edges <= n)]
    last[edges - 1] = inside[edges - 1]      # and its last byte nothing after it
    end = np.flatnonzero(last) + 1
    sums = np.zeros(n + 1, dtype=U64)
    np.cumsum(_BYTE[_LOWER[data]] * _powers_of("base", _BASE, n), out=sums[1:])
    first = np.searchsorted(start, off, "left")
    return Words(_span_hash(sums, start, end), start, end, first, sums)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every run of ``k`` words; a document of fewer words
    (but at least one) gives its whole sequence as one shingle."""
    weight = seeds(k + 1, 29)
    n, count = len(w.hash), np.diff(w.first)
    doc = w.doc
    if n >= k:
        head = np.flatnonzero(doc[:n - k + 1] == doc[k - 1:])
        value = np.zeros(len(head), dtype=U64)
        for j in range(k):
            value += w.hash[head + j] * weight[j]
    else:
        head, value = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U64)
    short = np.flatnonzero((count > 0) & (count < k))
    rest = count[short].astype(U64) * weight[k]
    for j in range(k - 1):
        has = count[short] > j
        rest[has] += w.hash[w.first[short[has]] + j] * weight[j]
    return np.concatenate([doc[head], short]), mix64(np.concatenate([value, rest]))


def distinct_pairs(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, value) pairs, sorted."""
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[new], value[new]


def pieces_of(docs: DataFrame, text_col: str, least: int, piece_bytes: int) -> int:
    """How many pieces of about ``piece_bytes`` the texts make, ``least`` at least."""
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(least, -(-total // piece_bytes))
