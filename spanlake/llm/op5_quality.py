"""Quality classifier: pairwise ranking after Bradley and Terry.

Method.  A document's score is linear in features of its text (shares of byte classes, word and line
shape, repetition, all from the whole text).  For a preference pair of a good and a bad labelled
document, P(good over bad) is the logistic of the difference of their scores; the weights minimise the
logistic loss of the feature differences with a small ridge.  The threshold is a quantile of the training
scores, the one with the highest training accuracy, and the reported score is the logistic of the distance
to it, shifted so that the threshold is reported as ``cut``.

Fit.  On a sample of at most ``max_labels`` labelled rows, those with the smallest hash of doc_id: a
documented bound, and the only thing that reaches the driver.  Features and scores cover all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import raw_bytes, slices, split_words, word_hashes

MARKS = "!|%$#&*.,?:;/-_<>{}()[]=+@\"'~^\\`"
FOLD = 5


def features(arr: pa.Array) -> np.ndarray:
    """One row of features per text; null and empty texts give the same row."""
    data, off = raw_bytes(arr)
    n = len(off) - 1
    size = np.diff(off)
    row = np.repeat(np.arange(n), size)

    def share(mask: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.bincount(row[mask], minlength=n) / np.maximum(of, 1)

    w = split_words(arr)
    words = w.counts()
    wrow = np.repeat(np.arange(n), words)
    length = w.ends - w.starts
    h = word_hashes(w)
    cols = [np.log1p(size), np.log1p(words), share((data >= 65) & (data <= 90), size), share((data >= 48) & (data <= 57), size),
            share(data >= 128, size), share(data == 10, words), share(data == 32, size)]
    cols += [share(data == ord(c), words) for c in MARKS]
    mean = np.bincount(wrow, length, n) / np.maximum(words, 1)
    square = np.bincount(wrow, length.astype(np.float64) ** 2, n) / np.maximum(words, 1)
    cols += [mean, np.sqrt(np.maximum(square - mean ** 2, 0)), np.bincount(wrow, length == 1, n) / np.maximum(words, 1),
             np.bincount(wrow, length > 20, n) / np.maximum(words, 1)]
    # repetition: distinct words, equal neighbours, words that a capital or an odd mark ends
    at = np.lexsort((h, wrow))
    new = np.ones(len(at), bool)
    new[1:] = (h[at][1:] != h[at][:-1]) | (wrow[at][1:] != wrow[at][:-1])
    cols.append(np.bincount(wrow[at][new], minlength=n) / np.maximum(words, 1))
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (wrow[1:] == wrow[:-1])
    cols.append(np.bincount(wrow[same], minlength=n) / np.maximum(words, 1))
    first, last = w.data[w.starts], w.data[w.ends - 1] if len(h) else w.data[:0]
    cols.append(np.bincount(wrow, (first >= 65) & (first <= 90), n) / np.maximum(words, 1))
    cols.append(np.bincount(wrow, (last >= 33) & (last <= 47) & (last != 44) & (last != 46), n) / np.maximum(words, 1))
    x = np.stack(cols, 1)
    return np.concatenate([x, np.sqrt(np.abs(x[:, 2:]))], 1)


def held_out(doc_id) -> "F.Column":
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLD == 0


class Ranker:
    """Weights, scaling and threshold."""

    def __init__(self, x: np.ndarray, good: np.ndarray, pairs: int = 60000, ridge: float = 1e-3, steps: int = 60):
        self.mean, self.std = (x.mean(0), x.std(0) + 1e-9) if len(x) else (0.0, 1.0)
        self.weights, self.threshold = np.zeros(x.shape[1]), 0.0
        g, b = np.flatnonzero(good), np.flatnonzero(~good)
        if not len(g) or not len(b):  # nothing to prefer: every document gets the threshold's score
            return
        rng = np.random.default_rng(7)
        z = np.clip((x - self.mean) / self.std, -8, 8)
        diff = z[rng.choice(g, pairs)] - z[rng.choice(b, pairs)]
        v = self.weights
        for _ in range(steps):  # Newton steps on the ridge logistic loss of the differences
            p = 1 / (1 + np.exp(-np.clip(diff @ v, -30, 30)))
            grad = -(diff * (1 - p)[:, None]).mean(0) + ridge * v
            hess = (diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + ridge * np.eye(len(v))
            step = np.linalg.solve(hess, grad)
            v = v - step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = v
        s = z @ v
        cuts = np.unique(np.quantile(s, np.linspace(0, 1, 401)))
        hits = [((s >= c) == good).mean() for c in cuts]
        best = int(np.argmax(hits))
        low = s[s < cuts[best]]
        self.threshold = float((cuts[best] + low.max()) / 2 if len(low) else cuts[best])

    def score(self, x: np.ndarray, cut: float) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -8, 8)
        return 1 / (1 + np.exp(-np.clip(z @ self.weights - self.threshold, -500, 500) - np.log(cut / (1 - cut))))


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = 6000) -> Ranker:
    """Learn from labelled rows outside the held-out fold.  Ids that are null, labels other than 0 and 1 and ids with
    both labels are left out; of documents with the same id, one (the smallest text) is read."""
    own = (labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
           .groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").alias("low"), F.max("quality").alias("good"))
           .where("low = good").orderBy(F.xxhash64("id"), "id").limit(max_labels).select("id", "good"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                x = features(b.column(2))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["id", "good", "x"])

    rows = (docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(own, "id").select("id", "good", "text")
            .mapInArrow(run, "id long, good int, x array<double>").groupBy("id", "good").agg(F.min("x").alias("x"))
            .orderBy("id").toPandas())  # max_labels rows at most
    if not len(rows):
        return Ranker(np.zeros((0, features(pa.array(["a"])).shape[1])), np.zeros(0, bool))
    return Ranker(np.stack(rows["x"].tolist()), rows["good"].to_numpy() == 1)


def scored(docs: DataFrame, model: Ranker, cut: float = 0.3) -> DataFrame:
    """``docs`` (``doc_id``, ``text`` and any others) with ``held_out, score, predicted`` added.

    Null texts score like empty ones; a null id counts as the empty text in the fold; rows repeat as they
    came; an empty table gives an empty result.  Added names replace columns of the same name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.drop("held_out", "score", "predicted")
    from pyspark.sql import types as T
    schema = T.StructType(base.schema.fields + [T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                s = shared.value.score(features(b.column(b.schema.get_field_index("text"))), cut)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], [*b.schema.names, "score"])

    out = base.mapInArrow(run, schema)
    return (out.withColumn("held_out", held_out(F.col("doc_id")))
            .withColumn("predicted", F.when(F.col("score") >= cut, 1).otherwise(0)))


def quality(docs: DataFrame, labels: DataFrame, cut: float = 0.3, max_labels: int = 6000) -> DataFrame:
    return scored(docs, fit(docs, labels, max_labels), cut)
