"""Quality classifier: histogram gradient-boosted trees over statistics of a document's text.

Trees are grown level by level on binned statistics with logistic loss, and flattened into arrays: all documents of a batch walk all trees by array indexing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, slices, text_buffer
from .kernels import SPACE, U, doc_words, mix

#: Most labelled rows a model is fitted on (a sample by hash of doc_id beyond that).
MAX_LABELS = 20_000
THRESHOLD = 0.7
TREES, DEPTH, BINS, RATE, RIDGE, LEAST = 60, 4, 64, 0.15, 1.0, 10.0

#: Classes of bytes: lower case, upper case, digits, ordinary punctuation, other ASCII signs, new lines, bytes over 127.
CLASS = np.full(256, 4, np.uint8)
CLASS[97:123], CLASS[65:91], CLASS[48:58], CLASS[128:] = 0, 1, 2, 6
CLASS[[ord(c) for c in ".,;:'\"?()-"]] = 3
CLASS[SPACE], CLASS[10] = 7, 5
N_CLASS = 8
FEATURES = 19


def statistics(texts: pa.Array) -> np.ndarray:
    """FEATURES numbers for each text."""
    data, off = text_buffer(texts)
    n = len(off) - 1
    out = np.zeros((n, FEATURES))
    size = np.diff(off).astype(float)
    doc = np.repeat(np.arange(n), np.diff(off))
    share = np.bincount(doc * N_CLASS + CLASS[data], minlength=n * N_CLASS).reshape(n, N_CLASS)
    out[:, :N_CLASS] = share / np.maximum(size, 1)[:, None]
    _, start, end, words, of = doc_words(data, off)
    count = np.bincount(of, minlength=n)
    some = np.maximum(count, 1)
    length = (end - start).astype(float)
    mean = np.bincount(of, length, minlength=n) / some
    out[:, 8], out[:, 9] = np.log1p(size), np.log1p(count)
    out[:, 10] = mean
    out[:, 11] = np.sqrt(np.maximum(np.bincount(of, length**2, minlength=n) / some - mean**2, 0))
    if len(words):
        _, first, times = np.unique(words + mix(of.astype(U) + U(1)), return_index=True, return_counts=True)
        own = of[first]
        out[:, 12] = np.bincount(own, minlength=n) / some
        top = np.zeros(n)
        np.maximum.at(top, own, times)
        out[:, 13] = top / some
        again = (words[1:] == words[:-1]) & (of[1:] == of[:-1])
        out[:, 14] = np.bincount(of[1:][again], minlength=n) / some
        signs = CLASS[data[end - 1]] == 4
        out[:, 15] = np.bincount(of[signs], minlength=n) / some
        upper = (CLASS[data[start]] == 1) & (CLASS[data[np.minimum(start + 1, end - 1)]] == 1) & (length > 1)
        out[:, 16] = np.bincount(of[upper], minlength=n) / some
        out[:, 17] = np.bincount(of[length == 1], minlength=n) / some
    lines = share[:, 5] + 1
    out[:, 18] = np.log1p(count / lines)
    return out


@dataclass
class Trees:
    """A forest as arrays: feature and threshold of inner nodes (trees x 2**depth - 1), values of leaves (trees x 2**depth)."""

    prior: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.prior), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < inner:  # all rows are on one level
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total += value[at - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees for labels y (0/1). One class alone gives its prior; no rows give the score 1: nothing learned rejects nothing."""
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    if not len(y):
        return Trees(50.0, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)))
    mean = (y.sum() + 0.5) / (len(y) + 1)
    prior = float(np.log(mean / (1 - mean)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    total = np.full(len(y), prior)
    found = []
    for _ in range(TREES if 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(inner, int), np.full(inner, np.inf)
        for level in range(DEPTH):
            base, nodes = 2**level - 1, 2**level
            best = np.full(nodes, 1e-9)
            split = np.full((nodes, 2), -1)
            for f in range(x.shape[1]):
                key = (at - base) * BINS + binned[:, f]
                sums = [np.bincount(key, w, nodes * BINS).reshape(nodes, BINS).cumsum(1) for w in (g, h, None)]
                (gl, gt), (hl, ht), (cl, ct) = [(s[:, :-1], s[:, -1:]) for s in sums]
                gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
                gain[(cl < LEAST) | (ct - cl < LEAST)] = 0
                k = gain.argmax(1)
                top = gain[np.arange(nodes), k]
                new = top > best
                best[new] = top[new]
                split[new] = np.stack([np.full(nodes, f), k], 1)[new]
            for node, (f, k) in enumerate(split):
                if f >= 0 and k < len(edges[f]):
                    feature[base + node], threshold[base + node] = f, edges[f][k]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > threshold[at])
        leaf = at - inner
        value = RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + RIDGE)
        total += value[leaf]
        found.append((feature, threshold, value))
    return Trees(prior, *(np.stack([t[k] for t in found]) if found else np.zeros((0, inner if k < 2 else leaves), int if not k else float) for k in range(3)))


def held_out():
    """Rows whose labels are never learned."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> Trees:
    """Trees from at most max_labels labelled rows that are not held out, those with the smallest hashes of doc_id (and of text, where rows repeat an id). Repeated labels of an id are averaged; null labels and ids are left out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality")).dropna().where(~held_out())
    n = known.count()
    part = int(min(1.0, 0.95 * max_labels / max(n, 1)) * 1_000_000)
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < part) if part < 1_000_000 else known
    chosen = F.xxhash64("doc_id")
    sample = sample.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality")).orderBy(chosen, "doc_id").limit(max_labels)

    def measure(batches):
        for b in batches:
            for s in slices(b.column("text")):
                x = statistics(b.column("text").slice(*s))
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(*s) for c in ("quality", "chosen", "own")), pa.array(list(x), pa.list_(pa.float64()))], names=["quality", "chosen", "own", "x"])

    texts = documents(docs).join(F.broadcast(sample), "doc_id").select("text", "quality", chosen.alias("chosen"), F.xxhash64("text").alias("own"))
    rows = texts.mapInArrow(measure, "quality int, chosen long, own long, x array<double>").orderBy("chosen", "own").limit(max_labels).toArrow()
    x = np.array(rows.column("x").to_pylist(), float).reshape(-1, FEATURES)
    return fit(x, rows.column("quality").to_numpy().astype(float))


def scorer(trees: Trees):
    """A column function: text to score."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        parts = [trees.score(statistics(texts.slice(*s))) for s in slices(texts)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return score


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Null texts count as empty; empty texts get a score as any other. Rows with a null id are scored and never held out. Without labels every score is 1. Other columns are not looked at. Empty input: empty output.
    """
    score = scorer(train(docs, labels))
    return documents(docs).select("doc_id", held_out().alias("held_out"), score("text").alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
