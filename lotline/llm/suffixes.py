"""Suffix array and permuted common prefixes of a byte string, as array passes.

Induced sorting: suffixes are classified as smaller (S) or larger (L) than
their successor; the leftmost S of each run (LMS) are sorted and order all
others.  Induction goes bucket by bucket (by first byte), each bucket's
suffixes at once, in rounds only along runs of one byte.  The LMS substrings
are first sorted by the same induction and named; where names repeat, the
string of names is sorted by naming pairs of names again and again, since its
alphabet is too wide for passes by bucket.  Time and memory are linear in the
string but for that step.
"""

from __future__ import annotations

import numpy as np

from . import textkit as T


def _types(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the empty suffix is smallest."""
    n = len(t)
    step = np.zeros(n, dtype=np.int8)
    step[:-1] = (t[:-1] < t[1:]).astype(np.int8) - (t[:-1] > t[1:])
    step[-1] = -1
    at = np.where(step != 0, np.arange(n, dtype=np.int32), np.int32(n))
    return step[np.minimum.accumulate(at[::-1])[::-1]] > 0


class _Buckets:
    def __init__(self):
        self.parts: list[list[np.ndarray]] = [[] for _ in range(256)]

    def deal(self, p: np.ndarray, c: np.ndarray) -> None:
        """Append positions to the buckets of their bytes, in order."""
        if not len(p):
            return
        p = p[np.argsort(c, kind="stable")]
        count = np.bincount(c, minlength=256)
        at = 0
        for b in np.flatnonzero(count):
            self.parts[b].append(p[at: at + count[b]])
            at += count[b]

    def take(self, b: int) -> np.ndarray:
        x = self.parts[b]
        self.parts[b] = []
        return x[0] if len(x) == 1 else np.concatenate(x) if x else np.empty(0, dtype=np.int32)


def _induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Suffix array from the LMS positions in order."""
    ahead = _Buckets()
    lms = lms.astype(np.int32)
    ahead.deal(np.array([len(t) - 1], dtype=np.int32), t[-1:])
    first = np.searchsorted(t[lms], np.arange(257)) if len(lms) else np.zeros(257, dtype=np.int64)
    larger: list[np.ndarray] = []
    for b in range(256):
        front, own = ahead.take(b), []
        while len(front):
            own.append(front)
            p = front[front > 0] - 1
            p = p[~small[p]]
            c = t[p]
            ahead.deal(p[c != b], c[c != b])
            front = p[c == b]
        larger.append(np.concatenate(own) if own else front)
        p = lms[first[b]: first[b + 1]] - 1
        ahead.deal(p, t[p])
    back, out = _Buckets(), []
    for b in range(255, -1, -1):
        front, own = back.take(b), []
        while len(front):
            own.append(front)
            p = front[front > 0] - 1
            p = p[small[p]]
            c = t[p]
            back.deal(p[c != b], c[c != b])
            front = p[c == b]
        x = larger[b][::-1]
        p = x[x > 0] - 1
        p = p[small[p]]
        back.deal(p, t[p])
        out.append(np.concatenate([larger[b], *[o[::-1] for o in own[::-1]]]))
    return np.concatenate(out[::-1])


def _ranked(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names, by naming pairs."""
    n, far, rank = len(names), 1, names.astype(np.int64) + 1
    while True:
        key = rank * (n + 1)
        key[:-far] += rank[far:]
        order = np.argsort(key)
        new = np.empty(n, dtype=bool)
        new[0] = True
        np.not_equal(key[order[1:]], key[order[:-1]], out=new[1:])
        rank[order] = np.cumsum(new)
        if new.all():
            return order
        far *= 2


def suffix_array(t: np.ndarray) -> np.ndarray:
    n = len(t)
    if n < 2:
        return np.arange(n)
    small = _types(t)
    at = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(at) < 2:
        return _induce(t, small, at)
    order = _induce(t, small, at[np.argsort(t[at], kind="stable")])
    is_lms = np.zeros(n, dtype=bool)
    is_lms[at] = True
    order = order[is_lms[order]]                       # by LMS substring
    end = np.append(at[1:] + 1, n)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(T._BYTE[t] * T._power(T._RADIX, n)[:-1], out=total[1:])
    h = T.mix((total[end] - total[at]) * T._power(T._RADIX_INV, n)[at] + (end - at).astype(np.uint64))
    h[-1] = h[-1] ^ np.uint64(0x5555)                  # ends with the text: like no other
    index = np.empty(n, dtype=np.int32)
    index[at] = np.arange(len(at))
    sub = index[order]
    new = np.ones(len(sub), dtype=bool)
    np.not_equal(h[sub[1:]], h[sub[:-1]], out=new[1:])
    if not new.all():
        names = np.empty(len(sub), dtype=np.int64)
        names[sub] = np.cumsum(new) - 1
        order = at[_ranked(names)]
    return _induce(t, small, order)


def permuted_lcp(t: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(plcp, before): for each position, the suffix before it in order (-1 for
    the first) and how many bytes they share.  Only positions whose preceding
    byte differs from that of ``before`` are compared; along the others the
    shared length falls by one."""
    n = len(t)
    before = np.full(n, -1, dtype=np.int32)
    before[sa[1:]] = sa[:-1]
    here = np.arange(n, dtype=np.int32)
    fresh = (here == 0) | (before <= 0)
    rest = np.flatnonzero(~fresh)
    fresh[rest] = t[rest - 1] != t[before[rest] - 1]
    padded = np.concatenate([t, np.zeros(16, dtype=np.uint8)])
    words = np.zeros(n + 8, dtype=np.uint64)
    for k in range(8):
        words |= padded[k: k + n + 8].astype(np.uint64) << np.uint64(8 * k)
    i = np.flatnonzero(fresh & (before >= 0))
    shared = np.zeros(n, dtype=np.int32)
    x, y, k = i.astype(np.int32), before[i], np.zeros(len(i), dtype=np.int32)
    while len(x):
        room = n - np.maximum(x, y) - k
        diff = words[np.minimum(x + k, n)] ^ words[np.minimum(y + k, n)]
        low = diff & (~diff + np.uint64(1))
        same = np.where(diff == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int32) // 8)
        k = (k + np.minimum(same, room)).astype(np.int32)
        go = (same == 8) & (room > 8)
        shared[x[~go]] = k[~go]
        x, y, k = x[go], y[go], k[go]
    start = np.maximum.accumulate(np.where(fresh, here, 0))
    plcp = np.maximum(shared[start] - (here - start), 0)
    return plcp, before
