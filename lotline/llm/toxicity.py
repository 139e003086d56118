"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are positives; the other side is unlabelled text, which
holds toxic texts as well.  The risk of a linear classifier is

    prior * R_pos(+) + max(0, R_unl(-) - prior * R_pos(-))

with logistic losses; the second term estimates the risk on clean text and is
kept from going below zero, as it would when the classifier learns the
positives by heart.  Inputs are which words a text holds, and the purest of
them.  The words are those that positives hold ``LIFT`` times as often as
unlabelled text.

Near copies (equal smallest shingle hash) count once.  The words are chosen by counts
over all rows that may be learned from: a word that three positives or more hold is
counted in every text, and taken if its share among positives is ``LIFT`` times that
among all texts and the difference is significant (likelihood ratio, at a false
discovery rate of ``ERROR`` over all words tried).  Positives are a bounded sample of labelled rows, of about
``POSITIVES``; the descent sees about ``UNLABELLED`` other texts, of which only which
of the chosen words they hold comes to the driver.  Samples are taken by a hash of the
id.  Scores then cover all rows and whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as T
from .common import held_out, map_batches, texts_of, written

POSITIVES = 3000
UNLABELLED = 8000
LIFT = 4.0
HOLDERS = 3               # positives that hold a word, at least
ERROR = 0.1               # share of the chosen words that may be there by chance
STEPS = 400
RATE = 0.2
SHRINK = 1e-4
BETA = 0.0
NOTHING = -10.0           # score (logit) where nothing could be learned
THRESHOLD = 0.7
FOLDS, HELD_OUT = 3, 1


def _words(texts: list[bytes]) -> list[np.ndarray]:
    return T.documents_words(texts, T.IS_MARK)


def _sampled(df: DataFrame, n: int, wanted: int) -> DataFrame:
    """About ``wanted`` of the ``n`` rows, by a hash of the id."""
    if n <= wanted:
        return df
    return df.where(F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1 << 30)) < int((1 << 30) * wanted / n))


def _bags(df: DataFrame, name: str, known: np.ndarray | None = None) -> DataFrame:
    """(mark, bag): distinct word hashes of each text, near copies once; with
    ``known`` (sorted hashes) the places of those of them that the text holds."""
    kind = pa.int64() if known is None else pa.int32()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        bags, marks = [], []
        for w in _words(texts_of(b.column(1))):
            s = T.shingle_set(w)
            marks.append(int(s[0].view(np.int64)) if len(s) else 0)
            w = np.unique(w)
            if known is None:
                bags.append(w.view(np.int64))
            else:
                at = np.minimum(np.searchsorted(known, w), len(known) - 1)
                bags.append(at[known[at] == w].astype(np.int32))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(bags, pa.list_(kind)), pa.array(marks, pa.int64())],
                                          ["doc_id", "bag", "mark"])
    rows = map_batches(df.select("doc_id", "text"), run, f"doc_id long, bag array<{'long' if known is None else 'int'}>, mark long")
    # of near copies the smallest id, so a fit is the same every time
    return written(rows.groupBy("mark").agg(F.min_by("bag", "doc_id").alias("bag")), name)


def significant(held: np.ndarray, n_pos: int, times: np.ndarray, n_all: int) -> np.ndarray:
    """Words held by ``held`` of ``n_pos`` positives and ``times`` of ``n_all`` texts that
    mark positives: by the likelihood ratio of the two shares, at a false discovery
    rate of ``ERROR`` over all words tried (Benjamini-Hochberg)."""
    base = (times + 0.5) / (n_all + 1)
    share = held / n_pos
    with np.errstate(divide="ignore", invalid="ignore"):
        rest = np.where(share < 1, (1 - share) * np.log((1 - share) / (1 - base)), 0.0)
        ratio = 2 * n_pos * (share * np.log(share / base) + rest)
    # a chi-square of one degree exceeds x with a probability below exp(-x / 2)
    chance = np.where(share > base, np.exp(-ratio / 2), 1.0)
    ranked = np.sort(chance)
    passed = np.flatnonzero(ranked <= ERROR * np.arange(1, len(ranked) + 1) / max(len(ranked), 1))
    return (share >= LIFT * base) & (chance <= (ranked[passed[-1]] if len(passed) else -1.0))


def choose_words(pos: DataFrame, rows: DataFrame, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Words (hashes, sorted) that mark positives, and how purely: the share of
    the texts with a word that the prior lets be toxic, with a margin of two
    standard errors of the word's count.  ``pos``: bags of positives; ``rows``: all
    texts that may be learned from, each of which is looked through for the
    words of positives.  Counts come back, a row for each of these words."""
    n_pos = pos.count()
    tried = (pos.select(F.explode("bag").alias("w")).groupBy("w").agg(F.count("*").alias("held"))
             .where(F.col("held") >= HOLDERS).collect())
    known = np.array([r["w"] for r in tried], dtype=np.int64).view(np.uint64)
    order = np.argsort(known)
    known, held = known[order], np.array([r["held"] for r in tried], dtype=np.float64)[order]
    if not len(known):
        return known, np.empty(0)
    bags = _bags(rows, "texts", known)
    n_all, times = bags.count(), np.zeros(len(known))
    for r in bags.select(F.explode("bag").alias("i")).groupBy("i").agg(F.count("*").alias("n")).collect():
        times[r["i"]] = r["n"]
    best = significant(held, n_pos, times, n_all)
    known, held, times = known[best], held[best], times[best]
    sure = held / n_pos / ((times + 0.5 + 2 * np.sqrt(times + 0.5)) / (n_all + 1))
    return known, np.minimum(prior * sure, 1)


def _matrix(bags: DataFrame, words: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """A row for each bag: which words it holds, the largest mark among them, and a one."""
    signed = words.view(np.int64)
    known = F.array(*[F.lit(int(w)) for w in signed])
    rows = bags.select("mark", F.array_intersect("bag", known).alias("hit")).toArrow().sort_by("mark")["hit"].to_pylist()
    out = np.zeros((len(rows), len(words) + 2), dtype=np.float64)
    out[:, -1] = 1
    place = {int(w): i for i, w in enumerate(signed)}
    for i, hit in enumerate(rows):
        at = [place[h] for h in hit]
        if at:
            out[i, at] = 1
            out[i, -2] = marks[at].max()
    return out


def fit(pos: np.ndarray, unl: np.ndarray, prior: float) -> np.ndarray:
    """Weights (the last one is the constant) by descent on the non-negative risk."""
    soft = lambda z: np.logaddexp(0, z)                # noqa: E731
    up = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    w = np.zeros(pos.shape[1])
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    free = np.ones_like(w)
    free[-1] = 0
    for t in range(1, STEPS + 1):
        zp, zu = pos @ w, unl @ w
        clean = soft(zu).mean() - prior * soft(zp).mean()
        plus = -prior * pos.T @ up(-zp) / len(pos)
        rest = unl.T @ up(zu) / len(unl) - prior * pos.T @ up(zp) / len(pos)
        grad = plus + rest if clean >= -BETA else -rest
        grad = grad + SHRINK * free * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - RATE * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-9)
    return w


Model = tuple[np.ndarray, np.ndarray, np.ndarray]     # words, marks, weights
BLANK: Model = (np.empty(0, dtype=np.uint64), np.empty(0), np.array([0.0, NOTHING]))


def train(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, out: int = HELD_OUT) -> Model:
    """Model from documents (doc_id, text) and labels (doc_id, toxic).

    The class prior is the share of toxic among the labelled rows that may be
    learned from.  Unlabelled text is any text outside the held-out rows."""
    labels = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds, out))
    labels = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    n, toxic = labels.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not toxic:
        return BLANK
    rows = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds, out))
    confirmed = _sampled(labels.where("toxic = 1"), toxic, POSITIVES).select("doc_id")
    pos = _bags(rows.join(F.broadcast(confirmed), "doc_id", "left_semi"), "positives")
    prior = min(max(toxic / n, 1e-4), 0.5)
    words, marks = choose_words(pos, rows, prior)
    if not len(words):
        return BLANK
    unl = _bags(_sampled(rows, rows.select("doc_id").count(), UNLABELLED), "unlabelled")
    return words, marks, fit(_matrix(pos, words, marks), _matrix(unl, words, marks), prior)


def scores(texts: list[bytes], model: Model) -> np.ndarray:
    words, marks, weights = model
    out = np.full(len(texts), weights[-1])
    if len(words):
        for i, x in enumerate(_words(texts)):
            at = np.minimum(np.searchsorted(words, x), len(words) - 1)
            hit = np.unique(at[words[at] == x])
            if len(hit):
                out[i] += weights[hit].sum() + weights[-2] * marks[hit].max()
    return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of documents (doc_id, text)."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(scores(texts_of(b.column(1)), model))], ["doc_id", "score"])
    out = map_batches(docs.select("doc_id", "text"), run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, with all columns, that the model does not call toxic."""
    at = docs.columns.index("text")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return b.filter(pa.array(scores(texts_of(b.column(at)), model) < THRESHOLD))
    return map_batches(docs, run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every document (doc_id, text) as ``labels`` (doc_id, toxic) marks toxicity.

    Returns doc_id, held_out (crc32 of the id as text mod 3 is 1; such labels
    are not learned from), score (0 to 1) and predicted (score >= 0.7), one row
    for each row.  Null and empty texts score like texts without marked words.
    A null id is not held out but has no label either.  Of repeated labels of an
    id the larger counts; null labels do not.  Without positives every score is
    near 0.  Other columns are not looked at."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return score(docs, train(docs, labels))
