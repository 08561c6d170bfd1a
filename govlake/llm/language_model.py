"""Language-model scoring with a weighted backoff automaton.

The model is a smoothed bigram model over lower-cased words and an end token:

  p(w | v) = g(v) * c(v w) / c(v) + (1 - g(v)) * p(w),   g(v) = GAMMA * c(v) / (c(v) + KAPPA)
  p(w) = (c(w) + 1) / (N + V + 1)

Both lines sum to one.  As an automaton: a state per history v, an arc per
counted bigram with the weight of the first line, and a failure arc of weight
log(1 - g(v)) to the root state, whose arcs weigh log p(w).  A text is
traversed once from left to right: each token takes its state's arc or falls
back, and the log weights add up.

Nothing of the model is broadcast or collected.  Documents are dealt into
blocks by a hash of their id.  Each block asks for the counts of its own
distinct words and bigrams; counts are summed per hash in buckets and sent back
to the blocks that asked.  A bigram known to one block only needs no answer, as
its count is the block's own.  Counts travel as packed, sorted columns, so what is
gathered from the corpus grows with its distinct n-grams.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govlake.llm.textkit import U64, chunks, mix64, pieces_of, seeds, words
from govlake.session import materialize

GAMMA, KAPPA = 0.6, 2.0
#: Words are told apart by 64-bit hashes, bigrams by this many bits.
PAIR_BITS = 52
_END, _START = seeds(2, 401)
_PAIR = seeds(2, 409)


def held_out(id_col: Column) -> Column:
    """Documents the model does not learn from: crc32 of the id as text, modulo 7, is 2."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 7 == 2, F.lit(False))


def _pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as differences, and counts, byte plane by byte plane."""
    steps = np.diff(keys, prepend=U64(0)).astype("<u8").view("u1").reshape(-1, 8)
    planes = np.concatenate([steps, counts.astype("<u8").view("u1").reshape(-1, 8)], axis=1)
    return zstandard.compress(np.ascontiguousarray(planes.T).tobytes(), 1)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.decompress(blob), "u1").reshape(16, -1)
    steps, counts = (np.ascontiguousarray(p.T).view("<u8").ravel() for p in (planes[:8], planes[8:]))
    return np.cumsum(steps, dtype=U64), counts.astype(np.int64)


def _tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, token hashes with one end per document, n + 1
    offsets) of runs of whole documents."""
    for lo, hi, data, off in chunks(column):
        w = words(data, off)
        first = w.first + np.arange(len(w.first))
        tokens = np.empty(len(w.hash) + hi - lo, dtype=U64)
        ends = first[1:] - 1
        inner = np.ones(len(tokens), dtype=bool)
        inner[ends] = False
        tokens[inner] = w.hash
        tokens[ends] = _END
        yield lo, hi, tokens, first


def _bigrams(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[first[:-1]] = _START
    return mix64(before * _PAIR[0] + tokens * _PAIR[1]) >> U64(64 - PAIR_BITS)


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts."""
    if not parts:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    keys = np.concatenate([p[0] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], np.concatenate([p[1] for p in parts])[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def _count(parts: list, keys: np.ndarray, learn: np.ndarray) -> None:
    """Append the distinct keys with their number of learnable occurrences."""
    order = np.argsort(keys)
    keys, learn = keys[order], learn[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    parts.append((keys[at], np.add.reduceat(learn.astype(np.int64), at)))
    if len(parts) >= 24:
        parts[:] = [_merge(parts)]


#: Bytes of text in a block, at most about (one longer document apart): what a task holds.
BLOCK_BYTES = 32 << 20

#: A packed request: order 1 (words), 2 (bigrams) or 0 (statistics).
_REQUEST = "bucket int, ord int, block int, data binary"


def _requests(blocks: DataFrame, buckets: int) -> DataFrame:
    """Each block's distinct n-grams with their training counts, packed per bucket."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        one: list = []
        two: list = []
        column = pa.array(g["text"], pa.large_string())
        learn_doc = ~g["held"].to_numpy(dtype=bool)
        for lo, hi, tokens, first in _tokens(column):
            learn = np.repeat(learn_doc[lo:hi], np.diff(first))
            _count(one, tokens, learn)
            _count(two, _bigrams(tokens, first), learn)
        block, rows = int(g["block"].iloc[0]), []
        for order, parts in ((1, one), (2, two)):
            keys, counts = _merge(parts)
            # keys are sorted and a bucket is a range of hashes: each bucket is a slice
            cuts = np.searchsorted(_bucket(keys, order, buckets), np.arange(buckets + 1))
            for b in range(buckets):
                lo, hi = cuts[b], cuts[b + 1]
                if hi > lo:
                    rows.append((b, order, block, _pack(keys[lo:hi], counts[lo:hi])))
        return pd.DataFrame(rows, columns=["bucket", "ord", "block", "data"])

    return blocks.groupBy("block").applyInPandas(run, _REQUEST)


def _bucket(keys: np.ndarray, order: int, buckets: int) -> np.ndarray:
    top = keys >> U64(32 if order == 1 else PAIR_BITS - 32)
    return (top * U64(buckets) >> U64(32)).astype(np.int64)


def _answers(requests: DataFrame) -> DataFrame:
    """Counts of the whole corpus for the blocks that asked, and per bucket of
    words its token count and distinct words (block -1)."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        order = int(g["ord"].iloc[0])
        parts = [_unpack(d) for d in g["data"]]
        keys = np.concatenate([p[0] for p in parts])
        local = np.concatenate([p[1] for p in parts])
        uniq, inverse = np.unique(keys, return_inverse=True)
        total = np.zeros(len(uniq), dtype=np.int64)
        np.add.at(total, inverse, local)
        here = total[inverse]
        rows, at = [], 0
        for block, p in zip(g["block"], parts):
            n = len(p[0])
            other = np.flatnonzero(here[at:at + n] != p[1])    # else the block's own count is the answer
            if len(other):
                rows.append((order, int(block), _pack(p[0][other], here[at:at + n][other])))
            at += n
        if order == 1:
            rows.append((0, -1, struct.pack("<qq", total.sum(), (total > 0).sum())))
        return pd.DataFrame(rows, columns=["ord", "block", "data"])

    return requests.groupBy("ord", "bucket").applyInPandas(run, "ord int, block int, data binary")


class Automaton:
    """The states and arcs a block's texts can reach."""

    def __init__(self, one: tuple, two: tuple, n_tokens: int, n_words: int, n_docs: int):
        self.words, self.word_counts = one
        self.pairs, self.pair_counts = two
        self.n_docs = n_docs                       # documents learned from: the count of the start state
        self.floor = np.log10(float(n_tokens + n_words + 1))

    def score(self, tokens: np.ndarray, first: np.ndarray):
        """(number of known tokens, base score, score) per document."""
        c = self.word_counts[np.searchsorted(self.words, tokens)]
        base = np.log10(c + 1.0) - self.floor      # the root state's arcs
        state = np.empty(len(c), dtype=np.float64)
        state[1:] = c[:-1]
        state[first[:-1]] = self.n_docs
        arc = self.pair_counts[np.searchsorted(self.pairs, _bigrams(tokens, first))]
        g = GAMMA * state / (state + KAPPA)
        failure = np.log10(1 - g) + base           # failure arc, then the root's arc
        taken = np.log10(g * arc / np.maximum(state, 1) + (1 - g) * np.power(10.0, base))
        weight = np.where(arc > 0, taken, failure)
        add = lambda x: np.add.reduceat(x, first[:-1]) if len(first) > 1 else x[:0]
        return add((c > 0).astype(np.int64)), add(base), add(weight)


def _replace(keys: np.ndarray, counts: np.ndarray, blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    counts = counts.astype(np.int64)
    for blob in blobs:
        k, c = _unpack(blob)
        counts[np.searchsorted(keys, k)] = c
    return keys, counts


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens,
    base_score (add-one unigram model), score (the automaton's log10
    probability of the text).

    The model learns from every document that is not held out, over whole
    texts.  A null or empty text is one end token; a null id counts as not
    held out; repeated rows are learned from and scored each; no rows give no
    rows.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_blocks = pieces_of(docs, text_col, 2 * parts, BLOCK_BYTES)
    buckets = max(parts, -(-n_blocks // 2))
    kind = docs.schema[id_col].dataType.simpleString()
    dealt = docs.select(
        F.pmod(F.xxhash64(F.lit(5), F.col(id_col)), F.lit(n_blocks)).cast("int").alias("block"),
        F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held"), F.col(text_col).alias("text"))
    blocks = dealt.repartition(max(parts, n_blocks // 2), "block")
    answers = _answers(_requests(blocks, buckets))
    answers = materialize(answers, "counts")
    stats = [struct.unpack("<qq", r["data"])
             for r in answers.filter("ord = 0").select("data").collect()]   # two numbers per bucket
    n_tokens, n_words = (int(sum(s[i] for s in stats)) for i in (0, 1))
    n_docs = dealt.filter("not held").count()

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        column = pa.array(left["text"], pa.large_string())
        learn_doc = ~left["held"].to_numpy(dtype=bool)
        one: list = []
        two: list = []
        for lo, hi, tokens, first in _tokens(column):
            learn = np.repeat(learn_doc[lo:hi], np.diff(first))
            _count(one, tokens, learn)
            _count(two, _bigrams(tokens, first), learn)
        model = Automaton(_replace(*_merge(one), list(right.loc[right["ord"] == 1, "data"])),
                          _replace(*_merge(two), list(right.loc[right["ord"] == 2, "data"])),
                          n_tokens, n_words, n_docs)
        out = {"n_tokens": [], "n_known": [], "base_score": [], "score": []}
        for _lo, _hi, tokens, first in _tokens(column):
            for name, x in zip(out, (np.diff(first), *model.score(tokens, first))):
                out[name].append(x)
        frame = pd.DataFrame({k: np.concatenate(v) if v else [] for k, v in out.items()})
        frame.insert(0, "held_out", left["held"].to_numpy(dtype=bool))
        frame.insert(0, "id", left["id"].to_numpy())
        frame["train_tokens"] = n_tokens
        return frame[["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]]

    schema = (f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
              "base_score double, score double")
    out = (blocks.groupBy("block").cogroup(answers.filter("ord > 0").groupBy("block"))
           .applyInPandas(run, schema))
    return out.withColumnRenamed("id", id_col)
