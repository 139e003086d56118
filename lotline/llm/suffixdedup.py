"""Removal of every long byte string that starts at two places or more.

1. Every window of ``length`` bytes has an anchor: the smallest hash of the
   32-byte strings in it, the last one on ties.  Equal windows have equal
   anchors at equal places, so windows with an anchor that no other run of
   windows has are settled by counting anchors alone.
2. Neighbouring windows with the same anchor position are one run.  Runs whose
   whole text occurs again are covered entirely.
3. What is left are runs that share an anchor but not their whole text: the
   edges of copied passages.  One run of each text is fetched, and the runs of
   an anchor meet in one shard, where a suffix array (induced sorting) and the
   permuted common prefixes show which windows occur again.
4. An anchor with more different runs than ``SPLIT`` is dealt over several
   shards; what is single in its shard is then compared by a 128-bit hash of
   the window, one row for each different window of a shard.

Shards have a bounded number of bytes, and no step gathers a hot string: copies
are counted before they are shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import suffixes
from . import textkit as T
from .common import map_batches, texts_of, written

LENGTH = 200
GRAM = 32
SPLIT = 8192             # different runs of one anchor in one shard
SHARD_BYTES = 1 << 20
PART = 1 << 22           # windows of a text handled at once
_PLACE = np.uint64((1 << 24) - 1)
_FACTORS = T.mix(np.arange(1, 40, dtype=np.uint64)) | np.uint64(1)
_SECOND_RADIX = 0xD6E8FEB86659FD93
_SECOND_INV = pow(_SECOND_RADIX, -1, 1 << 64)


def _grams(a: np.ndarray) -> np.ndarray:
    """Hash of the 32 bytes from each position."""
    h, step, k = T._BYTE[a], 1, 0
    while step < GRAM:
        h = h[:-step] * _FACTORS[k] + h[step:]
        step, k = step * 2, k + 1
    return T.mix(h)


def _window_min(h: np.ndarray, width: int) -> np.ndarray:
    step, m = 1, h
    while step * 2 <= width:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    rest = width - step
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


class _Sums:
    """128-bit hashes of substrings from two polynomial prefix sums."""

    def __init__(self, h: np.ndarray):
        n = len(h)
        self.sums = []
        for x, radix, inv in ((h, T._RADIX, T._RADIX_INV), (T.mix(h ^ _FACTORS[20]), _SECOND_RADIX, _SECOND_INV)):
            total = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(x * T._power(radix, n)[:-1], out=total[1:])
            self.sums.append((total, T._power(inv, n)))

    def of(self, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        return [T.mix((total[end] - total[start]) * inv[start] + (end - start).astype(np.uint64)).view(np.int64)
                for total, inv in self.sums]


def window_runs(texts: list[bytes], length: int) -> list[np.ndarray]:
    """(text number, start, windows, anchor, h1, h2) of the runs of windows."""
    parts = []                         # (text, offset, bytes): windows start in one part only
    for i, x in enumerate(texts):
        for at in range(0, max(0, len(x) - length + 1), PART):
            parts.append((i, at, x[at: at + PART + length - 1]))
    out: list[list[np.ndarray]] = [[] for _ in range(6)]
    width = length - GRAM + 1
    for first, group in T.batches([p[2] for p in parts]):
        a = np.frombuffer(b"".join(group), dtype=np.uint8)
        size = np.array([len(g) for g in group])
        h = _grams(a)
        here = np.arange(len(h), dtype=np.uint64)
        low = _window_min((h & ~_PLACE) | (_PLACE - here), width)
        place = (_PLACE - (low & _PLACE)).astype(np.int64)
        n = len(place)
        own = np.repeat(np.arange(len(group)), size)[:n]
        begin = np.cumsum(size) - size
        fits = np.arange(n) + length <= (begin + size)[own]
        new = np.ones(n, dtype=bool)
        new[1:] = (place[1:] != place[:-1]) | (own[1:] != own[:-1]) | (fits[1:] != fits[:-1])
        s = np.flatnonzero(new)
        e = np.append(s[1:], n)
        s, e = s[fits[s]], e[fits[s]]
        h1, h2 = _Sums(h).of(s, e - 1 + width)
        k = own[s]
        text = np.array([p[0] for p in parts[first: first + len(group)]])
        offset = np.array([p[1] for p in parts[first: first + len(group)]])
        for col, x in zip(out, (text[k], s - begin[k] + offset[k], e - s, h[place[s]].view(np.int64), h1, h2)):
            col.append(x)
    return [np.concatenate(c) if c else np.empty(0, dtype=np.int64) for c in out]


def _runs(docs: DataFrame, length: int) -> DataFrame:
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        i, s, n, a, h1, h2 = window_runs(texts_of(b.column(1)), length)
        return pa.RecordBatch.from_arrays(
            [pa.array(b.column(0).to_numpy()[i]), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32)),
             pa.array(a), pa.array(h1), pa.array(h2)], ["rid", "start", "n", "a", "h1", "h2"])
    return map_batches(docs.select("rid", "text"), run, "rid long, start int, n int, a long, h1 long, h2 long")


def _slices(docs: DataFrame, length: int) -> DataFrame:
    """Texts of the runs listed with each document (rid, text, runs)."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(6)]
        for rid, text, runs in zip(b.column(0).to_pylist(), texts_of(b.column(1)), b.column(2).to_pylist()):
            for r in runs:
                for col, x in zip(out, (r["shard"], r["split"], r["single"], rid, r["start"],
                                        text[r["start"]: r["start"] + r["n"] + length - 1])):
                    col.append(x)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int32(), pa.binary()))],
            ["shard", "split", "single", "rid", "start", "piece"])
    return map_batches(docs, run, "shard long, split boolean, single boolean, rid long, start int, piece binary")


def shard_repeats(pieces: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the text of the pieces, each ended by a byte that UTF-8 never has:
    (text, window may start here, it occurs twice or more, it is the first of its kind in order)."""
    t = np.frombuffer(b"\xff".join([*pieces, b""]), dtype=np.uint8)
    size = np.array([len(p) for p in pieces])
    end = np.cumsum(size + 1) - 1
    starts = np.zeros(len(t) + 1, dtype=np.int32)
    np.add.at(starts, end - size, size >= length)
    np.add.at(starts, np.maximum(end - length + 1, end - size), -(size >= length).astype(np.int32))
    valid = np.cumsum(starts)[:-1] > 0
    plcp, before = suffixes.permuted_lcp(t, suffixes.suffix_array(t))
    again = plcp >= length
    twice = again.copy()
    twice[before[again]] = True
    return t, valid, twice, ~again


def _matched(slices: DataFrame, length: int) -> DataFrame:
    """Per shard: kind 0 (rid, start, n): windows of single runs that occur again;
    kind 1 (h1, h2[, rid, start]): different windows of split anchors, placed if single."""
    def run(t: pa.Table) -> pa.Table:
        pieces = t["piece"].to_pylist()
        split, single, rid, start = (t[c].to_numpy() for c in ("split", "single", "rid", "start"))
        text, valid, twice, first = shard_repeats(pieces, length)
        size = np.array([len(p) for p in pieces])
        own = np.repeat(np.arange(len(pieces), dtype=np.int32), size + 1)
        place = np.arange(len(text), dtype=np.int32) - (np.cumsum(size + 1) - size - 1)[own] + start[own]
        hit = valid & twice & single[own]
        edge = np.diff(np.concatenate(([0], hit.view(np.int8), [0])))
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        kind, r, p, n = [np.zeros(len(s), np.int32)], [rid[own[s]]], [place[s]], [e - s]
        h1, h2 = [np.zeros(len(s), np.int64)], [np.zeros(len(s), np.int64)]
        known = [np.ones(len(s), dtype=bool)]
        w = np.flatnonzero(valid & first & split[own])
        if len(w):
            f1, f2 = _Sums(_grams(text)).of(w, w + length - GRAM + 1)
            kind.append(np.ones(len(w), np.int32))
            r.append(rid[own[w]])
            p.append(place[w])
            n.append(np.ones(len(w), np.int64))
            h1.append(f1)
            h2.append(f2)
            known.append(single[own[w]] & ~twice[w])
        gone = ~np.concatenate(known)
        cols = [pa.array(np.concatenate(kind)), pa.array(np.concatenate(r), mask=gone),
                pa.array(np.concatenate(p).astype(np.int32), mask=gone), pa.array(np.concatenate(n).astype(np.int32)),
                pa.array(np.concatenate(h1)), pa.array(np.concatenate(h2))]
        return pa.table(cols, ["kind", "rid", "start", "n", "h1", "h2"])
    return slices.groupBy("shard").applyInArrow(run, "kind int, rid long, start int, n int, h1 long, h2 long")


def remove_repeats(docs: DataFrame, length: int = LENGTH, text_out: bool = False, split: int = SPLIT,
                   shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Remove each byte of a text (doc_id, text) that lies in a string of
    ``length`` bytes which starts anywhere else, too, in any text.

    Returns, for every row, doc_id, n_bytes, n_removed, n_spans (maximal removed
    runs), kept_sha256 and, if asked for, ``kept`` (binary).  Judged on the
    input, not on what is left; matches do not cross texts; null texts are
    empty.  Rows are texts of their own, repeated rows (and ids) too, so of
    texts of ``length`` bytes that occur twice nothing stays.  Null ids are
    kept.  Other columns are not looked at."""
    if length < GRAM:
        raise ValueError(f"length must be {GRAM} at least")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("rid", F.xxhash64("doc_id", "text"))
    runs = _runs(docs, length)
    # written first, so that the join reads plain shuffles, which can be split
    shared = written(runs.groupBy("a").agg(F.count("*").alias("k")).where("k > 1").select("a"), "shared")
    runs = written(runs.join(shared, "a", "left_semi"), "runs")
    kinds = runs.groupBy("a", "h1", "h2").agg(F.count("*").alias("k"), F.min(F.struct("rid", "start", "n")).alias("one"))
    kinds = written(kinds, "kinds")
    spans = runs.join(kinds.where("k > 1").select("a", "h1", "h2"), ["a", "h1", "h2"], "left_semi").select("rid", "start", "n")

    mixed = written(kinds.groupBy("a").agg(F.count("*").alias("held")).where("held > 1"), "mixed")
    edges = written(kinds.join(mixed, "a").select("a", "one.*", (F.col("k") == 1).alias("single"), "held"), "edges")
    size, most = edges.agg(F.coalesce(F.sum(F.col("n") + length), F.lit(0)), F.max("held")).first()
    if size:
        shards = max(1, -(-size // shard_bytes))
        salts = F.ceil(F.col("held") / split)
        salt = F.pmod(F.xxhash64("rid", "start"), salts)
        edges = edges.withColumn("shard", F.pmod(F.xxhash64("a", salt), F.lit(shards))
                                 ).withColumn("split", salts > 1)
        listed = edges.groupBy("rid").agg(F.collect_list(F.struct("shard", "split", "single", "start", "n")).alias("runs"))
        one = docs.select("rid", "text").join(listed, "rid")
        if docs.groupBy("rid").count().where("count > 1").limit(1).count():
            one = one.dropDuplicates(["rid"])       # of equal rows one fetches their common runs
        found = written(_matched(_slices(one, length), length), "matched")
        spans = spans.unionAll(found.where("kind = 0").select("rid", "start", "n"))
        if most > split:
            again = written(found.where("kind = 1").groupBy("h1", "h2").agg(F.count("*").alias("k")).where("k > 1")
                            .select("h1", "h2"), "again")
            spans = spans.unionAll(found.where("kind = 1 and rid is not null").join(again, ["h1", "h2"], "left_semi")
                                   .select("rid", "start", "n"))
    # a set: equal rows name the same spans, and share the list
    listed = spans.groupBy("rid").agg(F.collect_set(F.struct("start", "n")).alias("spans"))
    return _cut(docs.join(listed, "rid", "left").select("doc_id", "text", "spans"), length, text_out)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of (start, end) spans that overlap or touch."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def _cut(docs: DataFrame, length: int, text_out: bool) -> DataFrame:
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * text_out

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        lists = b.column(2)
        flat = lists.flatten()
        s, n = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        at = np.cumsum(sizes) - sizes
        size, gone, count, digest, texts = [], [], [], [], []
        for text, a, m in zip(texts_of(b.column(1)), at.tolist(), sizes.tolist()):
            cut = merged(zip(s[a: a + m].tolist(), (s[a: a + m] + n[a: a + m] + length - 1).tolist())) if m else []
            h, last, kept = hashlib.sha256(), 0, []
            for x, y in [*cut, (len(text), len(text))]:
                h.update(text[last:x])
                if text_out:
                    kept.append(text[last:x])
                last = y
            size.append(len(text))
            gone.append(sum(y - x for x, y in cut))
            count.append(len(cut))
            digest.append(h.hexdigest())
            texts.append(b"".join(kept))
        cols = [b.column(0), *(pa.array(c, pa.int64()) for c in (size, gone, count)), pa.array(digest, pa.string())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if text_out:
            cols, names = [*cols, pa.array(texts, pa.binary())], [*names, "kept"]
        return pa.RecordBatch.from_arrays(cols, names)
    return map_batches(docs, run, schema)
