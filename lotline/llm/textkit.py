"""Words and word shingles as 64-bit hashes, computed on whole byte buffers.

A word is a maximal run of bytes other than space and 0x09-0x0D; A-Z are
lower-cased first.  UTF-8 text and its bytes agree on this, so everything here
works on bytes.  Buffers are processed in segments cut at separators, so the
working memory is bounded by the segment (or by one word, if that is longer)
plus eight bytes a word.
"""

from __future__ import annotations

import numpy as np

SEGMENT = 1 << 19
MASK64 = (1 << 64) - 1

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SEP = np.zeros(256, dtype=bool)
IS_SEP[32] = True
IS_SEP[9:14] = True
# Letters and digits only: any other ASCII byte separates.
IS_MARK = np.zeros(256, dtype=bool)
IS_MARK[:128] = True
IS_MARK[48:58] = IS_MARK[65:91] = IS_MARK[97:123] = False

_RADIX = 0x9E3779B97F4A7C15 | 1
_RADIX_INV = pow(_RADIX, -1, 1 << 64)
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE_LOWER = _BYTE[LOWER]
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        a = np.full(max(n, SEGMENT) + 1, base, dtype=np.uint64)
        a[0] = 1
        have = np.multiply.accumulate(a)
        if n <= 4 * SEGMENT:
            _powers[base] = have
    return have[: n + 1]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _segment_words(a: np.ndarray, is_sep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the words of one segment, which no word crosses."""
    sep = is_sep[a]
    edge = np.diff(np.concatenate(([True], sep, [True])).view(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return start, np.empty(0, dtype=np.uint64)
    total = np.empty(len(a) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(_BYTE_LOWER[a] * _power(_RADIX, len(a))[:-1], out=total[1:])
    h = (total[end] - total[start]) * _power(_RADIX_INV, len(a))[start]
    return start, mix(h + (end - start).astype(np.uint64))


def word_hashes(data: bytes, is_sep: np.ndarray = IS_SEP) -> tuple[np.ndarray, np.ndarray]:
    """(start offset, 64-bit hash) of every word of ``data``."""
    a = np.frombuffer(data, dtype=np.uint8)
    starts, hashes, at = [], [], 0
    while at < len(a):
        end = min(at + SEGMENT, len(a))
        if end < len(a):
            back = np.flatnonzero(is_sep[a[at:end]][::-1])
            if len(back):
                end -= int(back[0])
            else:  # one long word: take it whole
                step = end
                while step < len(a):
                    found = np.flatnonzero(is_sep[a[step: step + SEGMENT]])
                    if len(found):
                        break
                    step = min(step + SEGMENT, len(a))
                end = step + int(found[0]) if step < len(a) else len(a)
        s, h = _segment_words(a[at:end], is_sep)
        starts.append(s + at)
        hashes.append(h)
        at = end
    if not starts:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


_ORDER = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words, in order, with repeats."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, dtype=np.uint64)
    h = np.full(m, np.uint64(n), dtype=np.uint64)
    for j in range(n):
        h += words[j: j + m] * _ORDER[j]
    return mix(h)


def batches(texts: list[bytes], limit: int = SEGMENT):
    """Consecutive groups of texts of about ``limit`` bytes (one text at least)."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= limit):
            size += len(texts[end])
            end += 1
        yield at, texts[at:end]
        at = end


def documents_words(texts: list[bytes], is_sep: np.ndarray = IS_SEP) -> list[np.ndarray]:
    """Word hashes of each text."""
    out: list[np.ndarray] = []
    for _, group in batches(texts):
        start, h = word_hashes(b" ".join(group), is_sep)
        ends = np.cumsum([len(t) + 1 for t in group])
        cut = np.searchsorted(start, ends)
        out.extend(np.split(h, cut[:-1]))
    return out


def shingle_set(words: np.ndarray, n: int = 5) -> np.ndarray:
    """Sorted distinct ``n``-word shingle hashes; with fewer words the whole
    sequence counts as one; without words the set is empty."""
    if not len(words):
        return words
    return np.unique(ngrams(words, n if len(words) >= n else len(words)))
