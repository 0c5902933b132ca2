"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text, no negatives: a small network minimises the non-negative
unbiased risk  prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))  with logistic
loss. The fit runs on a bounded, seeded sample on the driver; every text is scored in tasks.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named, small_batches, text_bytes

#: Most positives, and most unlabelled texts, that the fit reads (the smallest seeded hashes of their ids).
SAMPLE_ROWS = 20_000
#: PENALTY: weight of the squared weights against the risk, over the number of unlabelled texts.
HIDDEN, STEPS, PRIOR_STEPS, RATE, PENALTY = 16, 600, 150, 0.02, 2.0
_SYMBOLS = np.array([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])


def features(text: bytes) -> np.ndarray:
    """What a text looks like: shares of character classes and of each symbol, repetition of words and lines, lengths."""
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256).astype(np.float64)
    n = max(1.0, float(len(text)))
    words = text.split()
    m = max(1, len(words))
    counts = Counter(words)
    lines = text.split(b"\n")
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    upper, lower = hist[65:91].sum(), hist[97:123].sum()
    word_shares = [
        sum(map(operator.eq, words, words[1:])) / m,
        len(counts) / m,
        max(counts.values(), default=0) / m,
        sum(map(bytes.isupper, words)) / m,
        sum(map(bytes.isalpha, words)) / m,
        sum(map(bytes.isdigit, words)) / m,
        len(counts) / (m**0.7),
    ]
    class_shares = [upper / n, lower / n, upper / max(1.0, upper + lower), hist[48:58].sum() / n, hist[_SYMBOLS].sum() / n, hist[128:].sum() / n, hist[32] / n, hist[10] / n, hist[:32].sum() / n]
    sizes = [np.log1p(len(words)), np.log1p(lengths.mean()), np.log1p(lengths.max()), np.log1p(lengths.std()), len(set(lines)) / len(lines), np.log1p(len(text) / len(lines))]
    return np.r_[word_shares, class_shares, sizes, np.log1p(hist[_SYMBOLS] / n * 100)]


N_FEATURES = len(features(b""))


@dataclass
class Network:
    """score = sigmoid(tanh(standardised features @ w1 + b1) @ w2 + b2)."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -40, 40)))


def _log_loss(s: np.ndarray) -> np.ndarray:
    """Logistic loss of label 0 at scores s."""
    return -np.log1p(-np.clip(s, 0, 1 - 1e-12))


def risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """The non-negative unbiased risk of scores: prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))."""
    return prior * _log_loss(1 - positive).mean() + max(0.0, _log_loss(unlabelled).mean() - prior * _log_loss(positive).mean())


def risk_slope(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> np.ndarray:
    """What descent follows, by margin: the risk's slope, or where the bracket is negative the slope that lifts the bracket."""
    n, m = len(positive), len(unlabelled)
    if _log_loss(unlabelled).mean() - prior * _log_loss(positive).mean() >= 0:
        return np.r_[prior * (positive - 1) / n - prior * positive / n, unlabelled / m]
    return np.r_[prior * positive / n, -unlabelled / m]


def contrast_slope(positive: np.ndarray, unlabelled: np.ndarray) -> np.ndarray:
    """Slope of the plain logistic loss that tells positives from unlabelled texts, each kind weighing one half."""
    return np.r_[(positive - 1) / (2 * len(positive)), unlabelled / (2 * len(unlabelled))]


def _descend(positives: np.ndarray, unlabelled: np.ndarray, slope: Callable[[np.ndarray, np.ndarray], np.ndarray], seed: int, steps: int) -> Network:
    """Adam, full batches."""
    rng = np.random.default_rng(seed)
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-6
    d = unlabelled.shape[1]
    p = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    z = np.clip((np.vstack([positives, unlabelled]) - mean) / scale, -6, 6)
    n, decay = len(positives), PENALTY / len(unlabelled)
    for step in range(1, steps + 1):
        h = np.tanh(z @ p[0] + p[1])
        s = 1 / (1 + np.exp(-np.clip(h @ p[2] + p[3][0], -40, 40)))
        g = slope(s[:n], s[n:])
        back = (g[:, None] * p[2]) * (1 - h**2)
        grads = [z.T @ back + decay * p[0], back.sum(axis=0), h.T @ g + decay * p[2], np.array([g.sum()])]
        for k in range(4):
            first[k] = 0.9 * first[k] + 0.1 * grads[k]
            second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
            p[k] = p[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Network(mean, scale, *p)


def fit(positives: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 7) -> Network:
    """Minimise the non-negative risk."""
    return _descend(positives, unlabelled, lambda a, b: risk_slope(a, b, prior), seed, STEPS)


def class_prior(positives: np.ndarray, unlabelled: np.ndarray, seed: int = 7) -> float:
    """The share of positives among unlabelled texts, from these two alone.

    A network learns on one half of each to tell them apart. Above a threshold where only positives
    score, the other halves hold prior times as large a share of the unlabelled texts as of the
    positives; that ratio is read where its upper confidence bound is lowest (the best bin).
    """
    rng = np.random.default_rng(seed)
    p, u = (x[rng.permutation(len(x))] for x in (positives, unlabelled))
    net = _descend(p[::2], u[::2], contrast_slope, seed, PRIOR_STEPS)
    own, other = np.sort(net.margins(p[1::2] if len(p) > 1 else p)), np.sort(net.margins(u[1::2] if len(u) > 1 else u))
    above = np.arange(len(own), 0, -1) / len(own)  # share of positives at or above each of their own scores
    reach = (len(other) - np.searchsorted(other, own)) / len(other)
    doubt = np.sqrt(np.log(40) / 2 / len(own)) + np.sqrt(np.log(40) / 2 / len(other))
    best = int(np.argmin((reach + doubt) / above))
    return float(np.clip(reach[best] / above[best], 0.02, 0.98))


def held_out(doc_id: F.Column) -> F.Column:
    """Rows whose labels are never learned from: crc32 of the id as text, modulo 4, is 2. A row without an id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        rows = [features(t).tolist() for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1), batch.column(2)], names=["x", "positive", "unlabelled"])


def _sample(rows: DataFrame, seed: int, n: int) -> DataFrame:
    """At most n ids, those with the smallest seeded hashes. Where there are many more, only ids below a hash that some 4 n of them should reach are made distinct."""
    mark, total = F.xxhash64(F.lit(seed), "doc_id"), rows.count()
    if total > 8 * n:
        low = rows.filter(mark < -(1 << 63) + (4 * n << 64) // total)
        if low.select("doc_id").distinct().count() >= n:  # else rows repeat their ids too often
            rows = low
    return rows.select("doc_id").distinct().orderBy(mark, "doc_id").limit(n)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> Network | None:
    """Learn from rows that aren't held out. Positives: ids whose labels all say quality 1. Unlabelled: any text, label unseen.

    Labels of quality 0 are never used: the class prior comes from the positives and the unlabelled
    texts. The sample is bounded in rows, at most sample_rows ids of each kind with one row each (of rows
    that repeat an id that with the smallest text hash). None if there are no positives or no texts.
    """
    known = labels.filter(~held_out(labels["doc_id"]) & labels["quality"].isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = _sample(known.filter("quality = 1"), seed, sample_rows).select("doc_id", F.lit(True).alias("positive"), F.lit(False).alias("unlabelled"))
    rest = _sample(docs.filter(~held_out(F.col("doc_id"))), seed + 1, sample_rows)
    chosen = chosen.unionByName(rest.select("doc_id", F.lit(False).alias("positive"), F.lit(True).alias("unlabelled")))
    chosen = chosen.groupBy("doc_id").agg(F.bool_or("positive").alias("positive"), F.bool_or("unlabelled").alias("unlabelled"))
    # at most 2 * sample_rows ids: the bound that makes this broadcast safe
    picked = docs.select("doc_id", text_bytes(docs).alias("t")).join(F.broadcast(chosen), "doc_id")
    one = picked.groupBy("doc_id", "positive", "unlabelled").agg(F.min_by("t", F.xxhash64("t")).alias("t")).select("t", "positive", "unlabelled")
    rows = one.mapInArrow(_feature_rows, "x array<double>, positive boolean, unlabelled boolean").toArrow()
    if not rows.num_rows:
        return None
    x = np.array(rows.column("x").combine_chunks().flatten()).reshape(-1, N_FEATURES)
    order = np.lexsort(x.T[::-1])  # one order whatever task finished first
    x, positive, unlabelled = x[order], np.array(rows.column("positive"))[order], np.array(rows.column("unlabelled"))[order]
    if not positive.any() or not unlabelled.any():
        return None
    return fit(x[positive], x[unlabelled], class_prior(x[positive], x[unlabelled], seed), seed)


def score(docs: DataFrame, network: Network | None) -> DataFrame:
    """(doc_id, score): a row per row; null and empty texts are scored as empty. Without a network every score is 1: nothing is rejected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = batch.column(1).to_pylist()
            if network is None or not texts:
                s = np.ones(len(texts))
            else:
                s = network.scores(np.vstack([features(t) for t in texts]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], names=["doc_id", "score"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_bytes(docs).alias("t")).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, network: Network | None, threshold: float = 0.7) -> DataFrame:
    """docs, whole, of which those scoring below the threshold are gone; columns unchanged, whatever their names."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            out = pa.RecordBatch.from_arrays(batch.columns[1:], names=names)
            if network is not None:
                out = out.filter(pa.array(network.scores(np.vstack([features(t) for t in batch.column(0).to_pylist()])) >= threshold))
            yield out

    return docs.select(text_bytes(docs).alias("t"), *(named(docs, c).alias(f"c{k}") for k, c in enumerate(names))).mapInArrow(run, docs.schema)
