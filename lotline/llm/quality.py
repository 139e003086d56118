"""Quality by regularised quadratic discriminant analysis.

A text becomes a few statistics (shares of capitals, marks, symbols, bars and
digits, repeated and distinct words, lengths), smoothed for short texts and put
on a log scale.  Counts, sums and sums of products per class are added up by
Spark over all labelled rows that may be learned from; from them come class
means and covariances, the latter shrunk towards the pooled variances.  The
score of a text is the posterior of label 1 from the two log densities, whose
Mahalanobis terms use the Cholesky factors computed once.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as T
from .common import held_out, map_batches, texts_of, written

FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
SHRINKAGE = 0.1
RIDGE = 1e-3
SMOOTH = 20.0          # words of usual text added to every text

FEATURES = ["capitals", "shouts", "symbols", "bars", "digits", "stops", "high", "echoes", "variety", "words", "length", "lines"]


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars)] = 1
    return out


_CLASSES = np.stack([_mask(bytes(range(65, 91))), _mask(b"!"), _mask(b"#$%&*@^~_=+<>\\/{}[]"), _mask(b"|"),
                     _mask(b"0123456789"), _mask(b".,;:?"), _mask(bytes(range(128, 256))), _mask(b"\n")], axis=1)


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of ``FEATURES`` for each text."""
    out = np.empty((len(texts), len(FEATURES)))
    for i, (text, w) in enumerate(zip(texts, T.documents_words(texts))):
        n, size = len(w), len(text)
        caps, shouts, symbols, bars, digits, stops, high, lines = (
            np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256) @ _CLASSES)
        per = n + SMOOTH
        echoes = int((w[1:] == w[:-1]).sum())
        out[i] = (caps / (size + 6 * SMOOTH), shouts / per, symbols / per, bars / per, digits / per, stops / per,
                  high / (size + 6 * SMOOTH), echoes / per, (len(np.unique(w)) + SMOOTH) / per, n, (size + 6 * SMOOTH) / per,
                  lines / per)
    scale = out[:, [8, 9, 10]]
    out = np.log(out + 0.01)
    out[:, 8] = np.log(scale[:, 0])
    out[:, 9] = np.log1p(scale[:, 1])
    out[:, 10] = np.log(scale[:, 2])
    return out


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x) for every row of documents."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        x = statistics(texts_of(b.column(1)))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
        return pa.RecordBatch.from_arrays([b.column(0), lists], ["doc_id", "x"])
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, x array<double>")


class Discriminant:
    """Class means and Cholesky factors of shrunken covariances."""

    def __init__(self, count: np.ndarray, total: np.ndarray, product: np.ndarray):
        """Of classes 0 and 1: rows, sums (2, d), sums of products (2, d, d)."""
        d = total.shape[1]
        self.prior = float(np.log((count[1] + 1) / (count[0] + 1)))
        self.known = bool((count > 1).all())
        if not self.known:
            return
        self.mean = total / count[:, None]
        cov = product / count[:, None, None] - self.mean[:, :, None] * self.mean[:, None, :]
        pooled = np.diag((cov * count[:, None, None]).sum(axis=0) / count.sum())
        pooled = np.maximum(pooled, 1e-6)
        self.factor, self.logdet = [], []
        for c in range(2):
            s = (1 - SHRINKAGE) * cov[c] + SHRINKAGE * np.diag(pooled) + RIDGE * np.eye(d)
            chol = np.linalg.cholesky(s)
            self.factor.append(np.linalg.inv(chol))
            self.logdet.append(2 * np.log(np.diag(chol)).sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        """Posterior of class 1."""
        z = np.full(len(x), self.prior)
        if self.known:
            for c, sign in ((1, 1.0), (0, -1.0)):
                y = (x - self.mean[c]) @ self.factor[c].T
                z -= sign * 0.5 * (np.einsum("ij,ij->i", y, y) + self.logdet[c])
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def train(feats: DataFrame, labels: DataFrame) -> Discriminant:
    """From (doc_id, x) and labels (doc_id, quality), all rows that are not held out."""
    labels = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()
                          & ~held_out(F.col("doc_id"), FOLDS, HELD_OUT))
    labels = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    d = len(FEATURES)
    pairs = list(combinations_with_replacement(range(d), 2))
    x = lambda i: F.element_at("x", i + 1)
    rows = feats.join(labels, "doc_id").groupBy("quality").agg(
        F.count("*").alias("n"), *[F.sum(x(i)).alias(f"s{i}") for i in range(d)],
        *[F.sum(x(i) * x(j)).alias(f"p{i}_{j}") for i, j in pairs]).collect()
    count, total, product = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for r in rows:
        c = r["quality"]
        count[c] = r["n"]
        total[c] = [r[f"s{i}"] for i in range(d)]
        for i, j in pairs:
            product[c, i, j] = product[c, j, i] = r[f"p{i}_{j}"]
    return Discriminant(count, total, product)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every document (doc_id, text) as ``labels`` (doc_id, quality) marks quality.

    Returns doc_id, held_out (crc32 of the id as text mod 5 is 0; such labels
    are not learned from), score (0 to 1) and predicted (score >= 0.3), one row
    for each row.  Null and empty texts are scored by the statistics of an empty
    text.  A null id is not held out but has no label either.  Of repeated
    labels of an id the smaller counts; null labels do not.  Without two rows of
    each label every score is the smoothed share of label 1.  Other columns are
    not looked at."""
    feats = written(features(docs), "features")
    model = train(feats, labels)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], ["doc_id", "score"])
    out = map_batches(feats, run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
