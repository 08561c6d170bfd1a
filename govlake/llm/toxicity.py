"""Toxic spans by a linear-chain conditional random field.

Two states per token (clean, toxic).  A token's evidence is the summed weight
of its features (the word and its first 4, 5 and 6 bytes); transitions tie
neighbours.  Forward-backward gives each token's probability; a document's
score is a logistic function of its expected number of toxic tokens, its
largest probability and its length, and tokens of probability 1/2 or more are
the offending spans.

Fitting uses a bounded sample of labelled documents (``FIT_DOCS`` a class and
``FIT_BYTES`` in all); scoring covers every whole text.  Labels are given per
document, so the labelled tokens are: in toxic documents the tokens with a
feature that toxic documents hold far more often than clean ones; all other
tokens are clean.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govlake.llm.textkit import NON_ALNUM, U64, chunks, distinct_pairs, mix64, words

#: Bounds of the fitting sample: documents of each class, and UTF-8 bytes in all.
FIT_DOCS = 1000
FIT_BYTES = 6_000_000
#: Longest text fitted on, in bytes: a few huge texts would otherwise use up FIT_BYTES.
TEXT_BYTES = 30_000
#: Texts scored together: all advance token by token, so memory follows this.
SCORE_BYTES = 8 << 20
#: A feature is evidence if toxic documents hold it more often, with a
#: log-likelihood ratio (G squared) of at least this against equal rates.
MIN_G2 = 24.0
PREFIXES = (4, 5, 6)
STEPS = 60
#: Ridge on the standardised document features: weak, so that classes far
#: apart get scores near 0 and 1.
RIDGE = 0.03


@dataclass
class Crf:
    features: np.ndarray     # sorted 64-bit feature hashes
    weights: np.ndarray      # one per feature
    bias: float
    start: float             # log odds of a toxic first token
    trans: np.ndarray        # 2 x 2 log potentials
    doc: np.ndarray          # logistic weights of the document score


def _feature_hashes(w) -> list[np.ndarray]:
    return [w.hash] + [mix64(w.prefix_hash(n) ^ U64(n)) for n in PREFIXES]


def _evidence(w, m: Crf) -> np.ndarray:
    s = np.full(len(w.hash), m.bias)
    if len(m.features):
        for h in _feature_hashes(w):
            at = np.minimum(np.searchsorted(m.features, h), len(m.features) - 1)
            hit = m.features[at] == h
            s[hit] += m.weights[at[hit]]
    return s


def forward_backward(s: np.ndarray, first: np.ndarray, start: float, trans: np.ndarray):
    """(filtered probability, backward odds, marginal) of the toxic state for
    every token; ``first`` has the documents' n + 1 offsets.  All documents
    advance together, longest first."""
    count = np.diff(first)
    order = np.argsort(-count, kind="stable")
    head, length = first[:-1][order], count[order]
    longest = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(longest), "left")  # documents longer than t
    e = np.exp(np.clip(s, -30, 30))
    (t00, t01), (t10, t11) = np.exp(trans)
    p, r = np.empty(len(s)), np.ones(len(s))
    for t in range(longest):
        at = head[:active[t]] + t
        if t == 0:
            one = np.exp(start) * e[at]
            p[at] = one / (one + 1)
        else:
            q = p[at - 1]
            one = (q * t11 + (1 - q) * t01) * e[at]
            p[at] = one / (one + q * t10 + (1 - q) * t00)
    for t in range(longest - 2, -1, -1):
        at = head[:active[t + 1]] + t
        x = e[at + 1] * r[at + 1]
        r[at] = (t10 + t11 * x) / (t00 + t01 * x)
    return p, r, p * r / (p * r + 1 - p)


def _doc_features(marginal: np.ndarray, first: np.ndarray) -> np.ndarray:
    count = np.diff(first)
    total = np.concatenate([[0.0], np.cumsum(marginal)])
    expected = np.maximum(total[first[1:]] - total[first[:-1]], 0)
    top = np.zeros(len(count))
    full = np.flatnonzero(count)
    if len(full):
        top[full] = np.maximum.reduceat(marginal, first[full])
    return np.column_stack([np.ones(len(count)), np.log(expected + 1e-3), top, np.log1p(count)])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by damped Newton steps; a ridge on the
    standardised features."""
    mean, scale = x[:, 1:].mean(0), x[:, 1:].std(0) + 1e-6
    u = np.column_stack([np.ones(len(x)), (x[:, 1:] - mean) / scale])
    ridge = np.array([0.0] + [RIDGE] * (u.shape[1] - 1))

    def loss(c: np.ndarray) -> float:
        q = np.clip(u @ c, -500, 500)
        return float((weight * (np.logaddexp(0, q) - y * q)).sum() + (ridge * c * c).sum() / 2)

    c = np.zeros(u.shape[1])
    for _ in range(50):
        p = _sigmoid(u @ c)
        g = u.T @ (weight * (y - p)) - ridge * c
        h = (u * (weight * p * (1 - p))[:, None]).T @ u + np.diag(ridge + 1e-6)
        step, size = np.linalg.solve(h, g), 1.0
        while size > 1e-4 and loss(c + size * step) > loss(c):
            size /= 2
        c = c + size * step
        if np.abs(size * step).max() < 1e-6:
            break
    out = np.concatenate([[0.0], c[1:] / scale])
    out[0] = c[0] - (out[1:] * mean).sum()
    return out


def fit(texts: list[str], labels: list[int], toxic_rate: float) -> Crf:
    """Fit on a bounded sample; ``toxic_rate`` is the share of toxic documents
    among all labelled ones, for the level of the scores."""
    y = np.asarray(labels, dtype=float)
    # of every three documents two train the tagger, one the document score
    tagger = np.arange(len(y)) % 3 != 2 if len(y) >= 30 else np.ones(len(y), dtype=bool)
    n1, n0 = max(1.0, y[tagger].sum()), max(1.0, (1 - y[tagger]).sum())
    per_doc = []
    hashes, docs_of, first = [], [], [0]
    for lo, hi, data, off in chunks(pa.array(texts, pa.large_string()), 1 << 18):
        w = words(data, off, NON_ALNUM)
        hs = _feature_hashes(w)
        hashes.append(np.stack(hs, 1))
        d = w.doc + lo
        docs_of.append(d)
        first += list(w.first[1:] + first[-1])
        per_doc.append(distinct_pairs(np.tile(d, len(hs)), np.concatenate(hs)))
    if not hashes:
        return Crf(np.zeros(0, U64), np.zeros(0), -8.0, -8.0, np.zeros((2, 2)), np.array([-5.0, 0, 0, 0]))
    h, doc, first = np.concatenate(hashes), np.concatenate(docs_of), np.asarray(first)
    of, pf = np.concatenate([a for a, _ in per_doc]), np.concatenate([b for _, b in per_doc])
    del hashes, docs_of, per_doc
    keys, inverse = np.unique(pf, return_inverse=True)
    df1 = np.bincount(inverse, weights=(y * tagger)[of], minlength=len(keys))
    df0 = np.bincount(inverse, weights=((1 - y) * tagger)[of], minlength=len(keys))
    both = np.maximum(df1 + df0, 1)
    g2 = 2 * (df1 * np.log(np.maximum(df1, 1e-9) / (both * n1 / (n1 + n0)))
              + df0 * np.log(np.maximum(df0, 1e-9) / (both * n0 / (n1 + n0))))
    features = keys[(g2 >= MIN_G2) & (df1 / n1 >= 4 * df0 / n0)]
    del of, pf, keys, inverse, df1, df0, both, g2
    ids = np.full(h.shape, -1, dtype=np.int32)
    for j in range(h.shape[1] if len(features) else 0):
        at = np.minimum(np.searchsorted(features, h[:, j]), len(features) - 1)
        hit = features[at] == h[:, j]
        ids[hit, j] = at[hit]
    del h
    evident = (ids >= 0).any(1)
    z = (evident & (y[doc] == 1)).astype(float)
    inner = np.ones(len(doc), dtype=bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    nxt = np.flatnonzero(inner)                    # tokens with one before them in the document
    heads = first[:-1][np.diff(first) > 0]
    # parameters: feature weights, bias, start, transitions (clean to clean fixed at 0)
    k = len(features)
    theta = np.zeros(k + 2 + 3)
    theta[k], theta[k + 1] = -4.0, -2.0
    learn = tagger[doc]
    nxt, heads = nxt[learn[nxt]], heads[learn[heads]]
    rows, cols = np.nonzero(ids >= 0)
    flat = ids[rows, cols]
    m1 = v1 = np.zeros_like(theta)
    size = max(1, len(doc))
    for step in range(1, STEPS + 1):
        trans = np.array([[0.0, theta[k + 2]], [theta[k + 3], theta[k + 4]]])
        s = np.full(len(doc), theta[k])
        np.add.at(s, rows, theta[flat])
        p, r, mg = forward_backward(s, first, theta[k + 1], trans)
        g = np.zeros_like(theta)
        diff = (z - mg) * learn
        g[:k] = np.bincount(flat, weights=diff[rows], minlength=k)[:k] - 0.01 * theta[:k]
        g[k] = diff.sum()
        g[k + 1] = diff[heads].sum()
        a1 = p[nxt - 1]
        e = np.exp(np.clip(s[nxt], -30, 30)) * r[nxt]
        t = np.exp(trans)
        x01, x10, x11 = (1 - a1) * t[0, 1] * e, a1 * t[1, 0], a1 * t[1, 1] * e
        norm = (1 - a1) * t[0, 0] + x01 + x10 + x11
        z0, z1 = z[nxt - 1], z[nxt]
        g[k + 2] = ((1 - z0) * z1 - x01 / norm).sum()
        g[k + 3] = (z0 * (1 - z1) - x10 / norm).sum()
        g[k + 4] = (z0 * z1 - x11 / norm).sum()
        g /= size
        m1 = 0.9 * m1 + 0.1 * g
        v1 = 0.99 * v1 + 0.01 * g * g
        theta = theta + 0.3 * (m1 / (1 - 0.9 ** step)) / (np.sqrt(v1 / (1 - 0.99 ** step)) + 1e-9) / np.sqrt(step)
    trans = np.array([[0.0, theta[k + 2]], [theta[k + 3], theta[k + 4]]])
    s = np.full(len(doc), theta[k])
    np.add.at(s, rows, theta[flat])
    mg = forward_backward(s, first, theta[k + 1], trans)[2]
    rest = ~tagger if (~tagger).any() else tagger
    x, yr = _doc_features(mg, first)[rest], y[rest]
    weight = np.where(yr == 1, toxic_rate / max(1.0, yr.sum()),
                      (1 - toxic_rate) / max(1.0, (1 - yr).sum())) * len(yr)
    coef = _logistic(x, yr, weight)
    return Crf(features, theta[:k], float(theta[k]), float(theta[k + 1]), trans, coef)


def _spans(text: str, hot: np.ndarray) -> str:
    """Code point ranges of the tokens ``hot`` (numbers, ascending); neighbours
    are one range."""
    raw = np.frombuffer(text.encode(), np.uint8)
    w = words(raw, np.array([0, len(raw)]), NON_ALNUM)
    chars = np.cumsum((raw & 0xC0) != 0x80)
    new = np.ones(len(hot), dtype=bool)
    new[1:] = np.diff(hot) > 1
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(hot)) - 1
    return ",".join(f"{chars[a] - 1}:{chars[b - 1]}" for a, b in zip(w.start[hot[first]], w.end[hot[last]]))


def _score_slice(column: pa.Array, m: Crf) -> tuple[np.ndarray, list[str]]:
    evidence, first = [np.zeros(0)], [np.zeros(1, dtype=np.int64)]
    total = 0
    for _lo, _hi, data, off in chunks(column):
        w = words(data, off, NON_ALNUM)
        evidence.append(_evidence(w, m))
        first.append(w.first[1:] + total)
        total += len(w.hash)
    s, first = np.concatenate(evidence), np.concatenate(first)
    del evidence
    marginal = forward_backward(s, first, m.start, m.trans)[2]
    scores = _sigmoid(_doc_features(marginal, first) @ m.doc)
    spans = [""] * (len(first) - 1)
    hot = np.flatnonzero(marginal >= 0.5)
    doc = np.searchsorted(first, hot, "right") - 1
    for d in np.unique(doc):
        spans[d] = _spans(column[int(d)].as_py(), hot[doc == d] - first[d])
    return scores, spans


def score_batch(column: pa.Array, m: Crf) -> tuple[np.ndarray, list[str]]:
    """Scores and spans ("start:end,..." in code points) of a batch of texts."""
    scores, spans = [np.zeros(0)], []
    for lo, hi, _data, _off in chunks(column, SCORE_BYTES):
        x, y = _score_slice(column.slice(lo, hi - lo), m)
        scores.append(x)
        spans += y
    return np.concatenate(scores), spans


def held_out(id_col: Column) -> Column:
    """Rows never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          fit_docs: int = FIT_DOCS, fit_bytes: int = FIT_BYTES,
          text_bytes: int = TEXT_BYTES) -> Crf:
    """Fit on at most ``fit_docs`` labelled documents of each class and
    ``fit_bytes`` of text, chosen by the hash of their id among texts of at
    most ``text_bytes``, without held-out rows.  Unlabelled rows and null labels are not used; of several labels of
    one id the largest counts."""
    usable = (labels.select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_y"))
              .filter("_id is not null and _y is not null").groupBy("_id").agg(F.max("_y").alias("_y"))
              .filter(~held_out(F.col("_id"))))
    counts = {r["_y"]: r["n"] for r in usable.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    fitting = (docs.select(F.col(id_col).alias("_id"), F.octet_length(text_col).alias("_n"))
               .filter(F.col("_n") <= text_bytes).select("_id"))
    eligible = usable.join(fitting, "_id", "left_semi")
    sample = None
    for y in (0, 1):
        part = eligible.filter(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(fit_docs)
        sample = part if sample is None else sample.union(part)
    # at most 2 * fit_docs ids: a proven bound for the broadcast
    picked = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
              .join(F.broadcast(sample), "_id").filter("_t is not null")
              .filter(F.octet_length("_t") <= text_bytes)
              .orderBy(F.xxhash64("_id"), "_id", "_t").limit(2 * fit_docs))
    rate = counts.get(1, 0) / max(1, counts.get(0, 0) + counts.get(1, 0))

    def fit_sample(g: pd.DataFrame) -> pd.DataFrame:
        g = g.assign(h=[hashlib.blake2b(str(i).encode()).digest() for i in g["_id"]]).sort_values(["h", "_t"])
        size = np.cumsum([len(t.encode()) for t in g["_t"]])
        g = g[size <= fit_bytes]
        return pd.DataFrame({"model": [pickle.dumps(fit(list(g["_t"]), [int(y) for y in g["_y"]], rate))]})

    # one task fits the bounded sample; the driver gets the model only
    rows = picked.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(fit_sample, "model binary").collect()
    return pickle.loads(bytes(rows[0]["model"])) if rows else fit([], [], rate)


def score_toxicity(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text",
                   keep: list[str] | None = None) -> DataFrame:
    """One row per document: the columns ``keep`` (default: the id), ``toxicity``
    (0 to 1) and ``toxic_spans``.  A null or empty text has no token and gets
    the score of an empty document; rows of equal id are scored one by one;
    no rows give no rows."""
    keep = [id_col] if keep is None else keep
    cols = [c for c in dict.fromkeys([*keep, text_col]) if c not in ("toxicity", "toxic_spans")]
    src = docs.select(*cols)
    fields = [f for f in src.schema.fields if f.name in keep]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields]
                       + ["toxicity double", "toxic_spans string"])
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores, spans = score_batch(b.column(text_col), model)
            yield pa.RecordBatch.from_arrays(
                [b.column(n) for n in names] + [pa.array(scores), pa.array(spans, pa.string())],
                names=names + ["toxicity", "toxic_spans"])

    return src.mapInArrow(run, schema)
