"""Toxicity by weak supervision.

1. Candidate features of the labelled training texts (at most MAX_TRAIN, by hash order of ids): words and word prefixes of
   PREFIXES bytes, ASCII capitals lower-cased. Documents with each are counted by label; those whose excess among toxic
   texts passes a test corrected for the number of candidates become lexicon (word) and pattern (prefix) voters. One
   more voter says "clean" where none of them stands, and the given labels are a voter that may err as well.
2. A generative label model estimates by EM how often each voter fires on either class, and the correlation of voters given
   the class; a voter's evidence is divided by the squared correlations it shares, so nested prefixes don't count twice.
3. A logistic classifier over the voters' features is trained on the posterior labels and scores every whole text.

Only texts and training labels enter a score. Nulls: a null text is empty; rows with null labels aren't used; of several
labels of one id the largest counts. Empty texts have the score of a text without any feature. Without toxic labels every
score is the prior. Repeated rows get equal scores. Collected to the driver: at most MAX_VOTERS features, and for each
training row the numbers of those it has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .storage import cut

MAX_TRAIN = 20_000
MAX_VOTERS = 512
PREFIXES = (4, 5, 6, 7, 8)
MIN_TEXTS = 3


def features(raw: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, rows) of words, then of each length of prefix of longer words."""
    inside = K.WORDISH[raw]
    starts, ends, first = K.spans(inside, off)
    s = K.prefix_hash(K.LOWER[raw])
    rows = np.repeat(np.arange(len(off) - 1), np.diff(first))
    yield K.span_hash(s, starts, ends), rows
    for k in PREFIXES:
        long = ends - starts > k
        yield K.mix(K.span_hash(s, starts[long], starts[long] + k) ^ K.U(k)), rows[long]


def counts(texts: DataFrame) -> DataFrame:
    """feature, neg, pos: training texts of either label that have the feature. texts: text, toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toxic = np.asarray(b.column(1).to_numpy(zero_copy_only=False), bool)
            for row, raw, off in K.slices(b.column(0), 4 * K.SLICE):
                for h, rows in features(raw, off):
                    order = np.lexsort((h, rows))
                    h, rows = h[order], rows[order]
                    new = np.ones(len(h), bool)
                    new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
                    each, at = np.unique(h[new], return_inverse=True)
                    pos = np.bincount(at, weights=toxic[row + rows[new]], minlength=len(each)).astype(np.int64)
                    every = np.bincount(at, minlength=len(each))
                    yield pa.RecordBatch.from_arrays([pa.array(each.view(np.int64)), pa.array(every - pos), pa.array(pos)], ["feature", "neg", "pos"])

    return texts.select("text", "toxic").mapInArrow(K.lean(run), "feature long, neg long, pos long").groupBy("feature").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))


def _active(raw: np.ndarray, off: np.ndarray, known: np.ndarray, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, number of the feature in known)."""
    rows, numbers = [], []
    for h, r in features(raw, off):
        maybe = np.flatnonzero(sieve[h & K.U(0xFFFF)])
        if len(maybe):
            at = np.minimum(np.searchsorted(known, h[maybe]), len(known) - 1)
            hit = known[at] == h[maybe]
            rows.append(r[maybe[hit]])
            numbers.append(at[hit])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pair = np.unique(np.concatenate(rows) * len(known) + np.concatenate(numbers))
    return pair // len(known), pair % len(known)


def _sieve(known: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 16, bool)
    out[known & K.U(0xFFFF)] = True
    return out


def excess(neg: F.Column, pos: F.Column, n_neg: int, n_pos: int) -> F.Column:
    """Log-likelihood ratio statistic of pos among neg + pos against the base rate, 0 where there is no excess."""
    n, p = neg + pos, F.lit(n_pos / (n_neg + n_pos))
    term = lambda k, q: F.when(k > 0, k * F.log(k / (n * q))).otherwise(0.0)
    return F.when(pos > n * p, 2 * (term(pos, p) + term(neg, 1 - p))).otherwise(0.0)


@dataclass
class LabelModel:
    prior: float
    fires: np.ndarray  # by voter: P(fires | clean), P(fires | toxic)
    share: np.ndarray  # by voter: 1 / sum of squared correlations given the class
    posterior: np.ndarray


def label_model(votes: np.ndarray, given: np.ndarray, rounds: int = 25) -> LabelModel:
    """EM over binary voters and the given labels. votes: rows x voters; given: 0/1 for each row."""
    q = np.where(given > 0, 0.95, 0.05)
    v = np.concatenate([votes, (~votes.any(1))[:, None], (given > 0)[:, None]], 1).astype(np.float32)
    share = np.ones(v.shape[1])
    for i in range(rounds):
        w1, w0 = q.sum() + 2, (1 - q).sum() + 2
        one, zero = (q @ v + 1) / w1, ((1 - q) @ v + 1) / w0
        prior = w1 / (w1 + w0)
        if i % 5 == 0:  # correlations given the class
            apart = v - (q[:, None] * one + (1 - q)[:, None] * zero).astype(np.float32)
            size = np.sqrt((apart**2).mean(0)) + 1e-6
            rho = (apart.T @ apart) / len(v) / size / size[:, None]
            share = 1 / np.maximum(1.0, (np.clip(rho, 0, 1) ** 2).sum(0))
        on, off = np.log(one / zero), np.log((1 - one) / (1 - zero))
        logit = np.log(prior / (1 - prior)) + v @ (share * (on - off)) + (share * off).sum()
        q = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return LabelModel(float(prior), np.stack([zero, one]), share, q)


def train_linear(rows: np.ndarray, cols: np.ndarray, n: int, m: int, target: np.ndarray, ridge: float = 1e-3, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse binary features and soft labels, by accelerated gradient descent."""
    w, b = np.zeros(m), float(np.log((target.mean() + 1e-6) / (1 - target.mean() + 1e-6)))
    vw, vb = w.copy(), b
    rate = 4.0 / (1 + (np.bincount(rows, minlength=n).max() if len(rows) else 0))
    for t in range(steps):
        z = vb + np.bincount(rows, weights=vw[cols], minlength=n)
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / n
        nw = vw - rate * n / 50 * (np.bincount(cols, weights=g[rows], minlength=m) + ridge / 50 * vw) if m else vw
        nb = vb - rate * g.sum()
        k = t / (t + 3)
        vw, vb, w, b = nw + k * (nw - w), nb + k * (nb - b), nw, nb
    return w, b


@dataclass
class Model:
    known: np.ndarray
    weights: np.ndarray
    bias: float


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", max_train: int = MAX_TRAIN) -> Model:
    """labels: doc_id and toxic of the rows that may be learned from."""
    given = labels.where(F.col(toxic).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg(F.max(toxic).cast("int").alias("toxic"))
    chosen = given.orderBy(F.xxhash64("__id"), "__id").limit(max_train)
    d = docs.select(F.col(doc_id).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    texts = cut(d.join(F.broadcast(chosen), d["__key"] == chosen["__id"]).select("text", "toxic"), "toxic-train")
    n = {r.toxic: r.n for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = n.get(1, 0), n.get(0, 0)
    none = Model(np.zeros(0, K.U), np.zeros(0), float(np.log((n_pos + 0.5) / (n_neg + 0.5))) if n_pos + n_neg else -5.0)
    if not n_pos or not n_neg:
        return none
    found = counts(texts).where(F.col("neg") + F.col("pos") >= MIN_TEXTS)
    found = cut(found.withColumn("excess", excess(F.col("neg"), F.col("pos"), n_neg, n_pos)), "toxic-features")
    least = 2 * np.log(max(found.count(), 2))
    top = found.where(F.col("excess") >= float(least)).orderBy(F.desc("excess"), "feature").limit(MAX_VOTERS).collect()
    if not top:
        return none
    known = np.sort(np.array([r.feature for r in top], np.int64).view(K.U))
    sieve = _sieve(known)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[int]] = [[] for _ in range(b.num_rows)]
            for row, raw, off in K.slices(b.column(0)):
                for r, c in zip(*(x.tolist() for x in _active(raw, off, known, sieve))):
                    out[row + r].append(c)
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(out, pa.list_(pa.int32()))], ["toxic", "votes"])

    seen = texts.mapInArrow(K.lean(vote), "toxic int, votes array<int>").collect()
    seen.sort(key=lambda r: (r.toxic, r.votes))  # so that the fit doesn't depend on the order of tasks
    label = np.array([r.toxic for r in seen])
    rows = np.repeat(np.arange(len(seen)), [len(r.votes) for r in seen])
    cols = np.array([c for r in seen for c in r.votes], np.int64)
    votes = np.zeros((len(seen), len(known)), bool)
    votes[rows, cols] = True
    model = label_model(votes, label)
    weights, bias = train_linear(rows, cols, len(seen), len(known), model.posterior)
    return Model(known, weights, bias)


def score(docs: DataFrame, model: Model, keep_columns: list[str], text: str = "text") -> DataFrame:
    """keep_columns of every row and its score, 0 to 1. A scan; nothing is shuffled."""
    known, weights, bias, sieve = model.known, model.weights, model.bias, _sieve(model.known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = np.full(b.num_rows, bias)
            if len(known):
                for row, raw, off in K.slices(b.column(b.num_columns - 1)):
                    r, c = _active(raw, off, known, sieve)
                    z[row : row + len(off) - 1] += np.bincount(r, weights=weights[c], minlength=len(off) - 1)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], [*b.schema.names[:-1], "score"])

    return K.framed(docs, keep_columns, text, run, "score double")
