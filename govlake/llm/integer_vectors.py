"""Integer vectors for the exact searches: packing, products and cuts.

Each component x becomes floor(256 * x).  A vector is packed as one tag byte
and its components, as 16-bit integers where all fit and as doubles (which
hold any floor exactly) elsewhere.  Rows that agree in every column are one
node with a number of copies, so a large group of copies is one row from the
first shuffle on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256
_SHORT, _WIDE = b"\x02", b"\x08"
#: Doubles hold every integer below this.
_EXACT = 2.0 ** 53
_LONG = (1 << 63) - 1


def _packed(column: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """(row numbers, packed vectors) of the usable vectors of a batch."""
    rows, out = [], []
    for i, v in enumerate(column.to_pylist()):
        if v is None or None in v:
            continue
        with np.errstate(all="ignore"):
            x = np.floor(np.array(v, dtype=float) * SCALE)
        if not np.isfinite(x).all():
            continue
        short = not len(x) or np.abs(x).max() < 1 << 15
        rows.append(i)
        out.append(_SHORT + x.astype("<i2").tobytes() if short else _WIDE + x.astype("<f8").tobytes())
    return np.array(rows, dtype=np.int64), out


def nodes_of(vectors: DataFrame, vec: Column, **keys: Column) -> DataFrame:
    """One row per distinct (keys, packed vector) with ``node`` (a 128-bit name
    of the row), ``vec`` and ``copies``.  Vectors that are null, or hold null
    or non-finite components (also after the factor 256), take no part."""
    src = vectors.select(*(c.alias(n) for n, c in keys.items()), vec.alias("vec")).filter("vec is not null")
    names = list(keys)
    kinds = ", ".join(f"{n} {src.schema[n].dataType.simpleString()}" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, packed = _packed(b.column("vec"))
            yield pa.RecordBatch.from_arrays([*(b.column(n).take(pa.array(rows)) for n in names),
                                              pa.array(packed, pa.binary())], names=[*names, "vec"])

    same = src.mapInArrow(run, f"{kinds}, vec binary").groupBy(*names, "vec").agg(F.count("*").alias("copies"))
    named = F.concat(*(F.encode(F.concat(F.coalesce(F.col(n).cast("string"), F.lit("null")), F.lit("|")), "UTF-8")
                       for n in names), F.col("vec"))
    return same.withColumn("node", F.unhex(F.md5(named)))


def unpack(column: pa.Array | pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """The vectors as rows of doubles; shorter ones are padded with zeros."""
    vecs = column.to_pylist()
    if vecs and len(set(map(len, vecs))) == 1 and all(v[:1] == _SHORT for v in vecs):
        raw = np.frombuffer(b"".join(vecs), np.uint8).reshape(len(vecs), -1)[:, 1:]
        x = np.ascontiguousarray(raw).view("<i2").astype(float)
        return x if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))
    parts = [np.frombuffer(v, "<i2" if v[:1] == _SHORT else "<f8", offset=1) for v in vecs]
    x = np.zeros((len(parts), max([width, *map(len, parts)])))
    for i, p in enumerate(parts):
        x[i, :len(p)] = p
    return x


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``a`` with those of ``b`` as longs;
    one beyond a long counts as the nearest long."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    if np.abs(a).max() * np.abs(b).max() * width < _EXACT:
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(a) @ whole(b).T, -_LONG, _LONG).astype(np.int64)


def cut(query: np.ndarray, score: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's first ``k`` by score (high first), then row."""
    order = np.lexsort((row, -score, query))
    q = query[order]
    return order[np.arange(len(q)) - np.searchsorted(q, q, "left") < k]


def by_id(table: pa.Table) -> pa.Table:
    """The rows in ascending order of ``id``, nulls last: row numbers then break ties."""
    return table.take(pc.sort_indices(table, sort_keys=[("id", "ascending")], null_placement="at_end"))
