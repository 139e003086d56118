"""Benchmark items hidden in documents: containment search with MinHash sketches.

An item is in a document if the document holds ``PERCENT`` of the item's word
shingles.  Similarity of the two sets says little, as a document may be
thousands of times as long, so the search goes by the items' sketches alone.
Items are partitioned by the size of their sets, doubling from one partition to
the next.  Of a set of n a document that holds enough lacks at most ``n - need``
shingles; the largest of a partition gives the length of its sketches, one more
than that many smallest hashes, and of those the document holds one at least.
Documents are scanned once for sketch hashes; a document that has one is a
candidate for that item, and candidates are verified by their exact shingle
sets.  No pair is missed.

While the items are few (``SKETCHES`` shingles, ``ITEM_CHARS``, both counted first) sketches and item
sets go along with the scan; beyond that, documents' shingles are joined with
the sketches by shuffles, and candidates are verified the same way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as T
from .common import map_batches, texts_of, written

WORDS = 5
PERCENT = 80
SKETCHES = 2_000_000      # shingles, and
ITEM_CHARS = 32 << 20     # characters, of items that a scan carries


def words_of(text: bytes) -> list[bytes]:
    """The words themselves, lower-cased as the hashes see them."""
    return text.translate(T.LOWER.tobytes()).split()


def shingles_of(words: list[bytes], n: int) -> set[tuple[bytes, ...]]:
    return {tuple(words[i: i + n]) for i in range(len(words) - n + 1)} if n else set()


def need(size: int, percent: int = PERCENT) -> int:
    """How many of ``size`` shingles a document has to hold."""
    return -(-percent * size // 100)


def partition(size: int) -> int:
    """Size partition of a set: 0 for 1, 1 for 2-3, 2 for 4-7, ..."""
    return size.bit_length() - 1


def sketch_length(part: int) -> int:
    """Smallest hashes kept of the sets of a partition: one more than a document
    may lack of its largest sets (larger sets may lack more)."""
    largest = (2 << part) - 1
    return largest - need(largest) + 1


def sketch(s: np.ndarray) -> np.ndarray:
    """The smallest hashes of a sorted set, as many as its partition asks for."""
    return s[: sketch_length(partition(len(s)))]


def item_sets(items: DataFrame, words: int = WORDS) -> DataFrame:
    """(item_id, width, shingles, sketch) of items (item_id, text) that have
    words; width is the number of words of a shingle (fewer in shorter items)."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, width, sets, low = [], [], [], []
        for i, w in zip(b.column(0).to_pylist(), T.documents_words(texts_of(b.column(1)))):
            if len(w):
                s = T.shingle_set(w, words)
                ids.append(i)
                width.append(min(words, len(w)))
                sets.append(s.view(np.int64))
                low.append(sketch(s).view(np.int64))
        lists = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(width, pa.int32()), pa.array(sets, lists),
                                           pa.array(low, lists)], ["item_id", "width", "shingles", "sketch"])
    return map_batches(items.select(F.col("item_id").cast("long").alias("item_id"), "text"), run,
                       "item_id long, width int, shingles array<long>, sketch array<long>")


def _hashes(words: np.ndarray, widths: list[int]) -> np.ndarray:
    return np.concatenate([T.ngrams(words, w) for w in widths]) if widths else np.empty(0, np.uint64)


_PAIR = "doc_id long, item_id long, n_item long, n_shared long"


def _pairs(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], [x.split()[0] for x in _PAIR.split(", ")])


def _verified(text: bytes, wanted: list[tuple[int, bytes]], doc_id, words: int) -> list[tuple]:
    """Exact containment of items (item_id, text) in one text."""
    out, own = [], {}
    doc = words_of(text)
    for item_id, item in wanted:
        w = words_of(item)
        n = min(words, len(w))
        s = shingles_of(w, n)
        if n not in own:
            own[n] = shingles_of(doc, n)
        both = len(s & own[n])
        if s and both >= need(len(s)):
            out.append((doc_id, item_id, len(s), both))
    return out


def _scan(docs: DataFrame, items: list[tuple], words: int) -> DataFrame:
    """Pairs found by a scan that carries the items (item_id, text, width, shingles, sketch)."""
    order = np.concatenate([np.asarray(x[4], dtype=np.int64) for x in items]).view(np.uint64)
    owner = np.repeat(np.arange(len(items)), [len(x[4]) for x in items])
    at = np.argsort(order, kind="stable")
    order, owner = order[at], owner[at]
    sets = [np.asarray(x[3], dtype=np.int64).view(np.uint64) for x in items]
    texts = [(x[0], x[1].encode()) for x in items]
    widths = sorted({x[2] for x in items})

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple] = []
        ids, docs_ = b.column(0).to_pylist(), texts_of(b.column(1))
        for i, w in enumerate(T.documents_words(docs_)):
            h = _hashes(w, widths)
            if not len(h):
                continue
            hit = np.unique(h[order[np.minimum(np.searchsorted(order, h), len(order) - 1)] == h])
            if not len(hit):
                continue
            lo, hi = np.searchsorted(order, hit, "left"), np.searchsorted(order, hit, "right")
            found = np.unique(np.concatenate([owner[x:y] for x, y in zip(lo, hi)]))
            own = np.unique(h)
            wanted = [texts[k] for k in found.tolist()
                      if np.isin(sets[k], own, assume_unique=True).sum() >= need(len(sets[k]))]
            if wanted:
                rows += _verified(docs_[i], wanted, ids[i], words)
        return _pairs(rows)
    return map_batches(docs.select("doc_id", "text"), run, _PAIR)


def _joined(docs: DataFrame, items: DataFrame, sets: DataFrame, words: int) -> DataFrame:
    """The same by shuffles: document shingles meet the sketches in a join."""
    widths = sorted(r[0] for r in sets.select("width").distinct().collect())

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        hs = [np.unique(_hashes(w, widths)) for w in T.documents_words(texts_of(b.column(1)))]
        rid = np.repeat(b.column(0).to_numpy(), [len(h) for h in hs])
        return pa.RecordBatch.from_arrays([pa.array(rid), pa.array(np.concatenate([*hs, np.empty(0, np.uint64)]).view(np.int64))],
                                          ["rid", "h"])
    docs = docs.withColumn("rid", F.xxhash64("doc_id", "text"))
    grams = map_batches(docs.select("rid", "text"), run, "rid long, h long")
    # by a hash of the id, as ids may be null; what it takes in too much is verified below
    key = F.xxhash64("item_id").alias("key")
    posted = sets.select(key, F.explode("sketch").alias("h"))
    found = grams.join(posted, "h").select("rid", "key").distinct()
    lists = found.join(items.select(key, "item_id", F.col("text").alias("item")), "key").groupBy("rid").agg(
        F.collect_list(F.struct("item_id", "item")).alias("items"))

    def check(b: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple] = []
        for d, text, wanted in zip(b.column(0).to_pylist(), texts_of(b.column(1)), b.column(2).to_pylist()):
            rows += _verified(text, [(x["item_id"], x["item"].encode()) for x in wanted], d, words)
        return _pairs(rows)
    return map_batches(docs.join(lists, "rid").select("doc_id", "text", "items"), check, _PAIR)


def contaminated(docs: DataFrame, items: DataFrame, words: int = WORDS, sketches: int = SKETCHES) -> DataFrame:
    """Pairs (doc_id, item_id, n_item, n_shared) of documents (doc_id, text) and
    items (item_id, text) where the document holds 80 of 100 of the item's
    distinct five-word shingles, and how many.

    An item of fewer words has one shingle, all of its words in a row.  Null and
    empty items and documents give no pairs.  Repeated items and documents give
    their pairs as often; of items of one id with different texts each counts.
    Other columns are not looked at.  Every document is read whole."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    sets = written(item_sets(items, words), "items")
    size = sets.agg(F.coalesce(F.sum(F.size("shingles")), F.lit(0))).first()[0]
    if not size:
        return docs.sparkSession.createDataFrame([], _PAIR)
    if size > sketches or items.agg(F.sum(F.length("text"))).first()[0] > ITEM_CHARS:
        return _joined(docs, items, sets, words)
    kept = [(r["item_id"], r["text"]) for r in items.collect()]
    rows = []
    for (i, text), w in zip(kept, T.documents_words([t.encode() for _, t in kept])):
        if len(w):
            s = T.shingle_set(w, words)
            rows.append((i, text, min(words, len(w)), s.view(np.int64), sketch(s).view(np.int64)))
    return _scan(docs, rows, words)
