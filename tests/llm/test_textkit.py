import random

import numpy as np

from lotline.llm import textkit as T


def test_words_are_found_whatever_the_segments(monkeypatch):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("ab \t\n\x0bCé") for _ in range(rnd.randrange(0, 200))).encode() for _ in range(60)]
    texts += [b"", b" ", b"x" * 5000, b"a " * 3000]
    whole = T.documents_words(texts)
    for segment in (7, 64, 1000):
        monkeypatch.setattr(T, "SEGMENT", segment)
        assert all((a == b).all() for a, b in zip(whole, T.documents_words(texts)))
    seen = {}
    for text, w in zip(texts, whole):
        words = text.translate(T.LOWER.tobytes()).split()
        assert len(words) == len(w)
        for x, h in zip(words, w.tolist()):
            assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)


def test_shingle_sets():
    w = T.documents_words([b"a b c d e f a b c d e"])[0]
    assert len(T.ngrams(w, 5)) == 7 and len(T.shingle_set(w)) == 6
    assert len(T.shingle_set(w[:3])) == 1 and len(T.shingle_set(w[:0])) == 0
    a, b = T.documents_words([b"a b", b"b a"])
    assert T.shingle_set(a)[0] != T.shingle_set(b)[0]
    assert not np.isin(T.ngrams(w, 2), T.ngrams(w, 3)).any()
