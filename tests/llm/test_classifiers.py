import random
import zlib

import numpy as np

from lotline.llm import quality as Q
from lotline.llm import toxicity as X
from tests.llm.conftest import docs

WORDS = ["".join(random.Random(i).choice("aeioubcdfg") for _ in range(2 + i % 6)) for i in range(300)]


def corpus(n=1500):
    rnd = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        w = [rnd.choice(WORDS) for _ in range(rnd.randrange(1, 120))]
        toxic, junk = rnd.random() < 0.12, rnd.random() < 0.15
        if toxic:
            for _ in range(rnd.randrange(1, 4)):
                w.insert(rnd.randrange(len(w) + 1), rnd.choice(["Grumblefig,", "snarkle!", "(BLORT)"]))
        if junk:
            w = [x.upper() + "!!" for x in w] if rnd.random() < 0.5 else [x + " |" for x in w]
            w += w[-1:] * 5
        rows.append((i, " ".join(w)))
        if rnd.random() < 0.7:
            labels.append((i, int(not junk), int(toxic)))
    rows += [(n, None), (n + 1, ""), (None, "nothing"), (0, rows[0][1]), (n + 2, "snarkle " * 20000)]
    labels += [(n, None, None), (None, 1, 1), (labels[0][0], 1, 0)]
    return rows, labels


def frames(spark):
    rows, labels = corpus()
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows, labels


def _held(i, mod, rest):
    return i is not None and zlib.crc32(str(i).encode()) % mod == rest


def test_toxicity_on_held_out_rows(spark):
    d, l, rows, labels = frames(spark)
    out = X.toxicity(d, l).collect()
    assert len(out) == len(rows) and out[0].asDict().keys() == {"doc_id", "held_out", "score", "predicted"}
    assert all(r.held_out == _held(r.doc_id, 3, 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    mark = {i: t for i, _, t in labels if t is not None}
    held = [(r.predicted, mark[r.doc_id]) for r in out if r.held_out and r.doc_id in mark]
    assert sum(p and not t for p, t in held) <= 2
    assert sum(p and t for p, t in held) >= 0.9 * sum(t for _, t in held) > 20
    by = {r.doc_id: r for r in out}
    assert by[len(rows) - 5].predicted == 0 and by[len(rows) - 4].predicted == 0 and by[len(rows) - 3].predicted == 1
    assert X.toxicity(d.limit(0), l).count() == 0


def test_toxicity_words_and_scores_by_counting(spark):
    """Words are chosen by counts over every text outside the fold, near copies once; scores are sums over words."""
    import math
    import re
    from lotline.llm import textkit as T
    d, l, rows, labels = frames(spark)
    words, marks, weights = X.train(d.select("doc_id", "text"), l)
    split = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").lower())
    toxic = {}
    for i, _, t in labels:
        if t is not None and i is not None and not _held(i, 3, 1):
            toxic[i] = max(t, toxic.get(i, 0))
    prior = sum(toxic.values()) / len(toxic)

    def bags(chosen):
        """Of texts whose smallest five-word shingle hash is the same that of the smallest id."""
        out = {}
        for i, t in sorted(chosen):
            s = T.shingle_set(T.documents_words([(t or "").encode()], T.IS_MARK)[0])
            out.setdefault(int(s[0]) if len(s) else 0, (i, set(split(t))))
        return [b for _, b in out.values()]
    learn = [(i, t) for i, t in rows if i is not None and not _held(i, 3, 1)]
    pos, every = bags([r for r in learn if toxic.get(r[0]) == 1]), bags(learn)
    tried = {w for b in pos for w in b if sum(w in c for c in pos) >= 3}
    chance, lift, sure = {}, {}, {}
    for w in tried:
        p, n = sum(w in b for b in pos) / len(pos), sum(w in b for b in every)
        q = (n + 0.5) / (len(every) + 1)
        g = 2 * len(pos) * (p * math.log(p / q) + ((1 - p) * math.log((1 - p) / (1 - q)) if p < 1 else 0))
        chance[w], lift[w] = math.exp(-g / 2) if p > q else 1.0, p / q
        sure[w] = min(prior * p / ((n + 0.5 + 2 * math.sqrt(n + 0.5)) / (len(every) + 1)), 1)
    order = sorted(tried, key=chance.get)
    last = max((k for k, w in enumerate(order) if chance[w] <= X.ERROR * (k + 1) / len(order)), default=-1)
    want = {w for w in order[: last + 1] if lift[w] >= X.LIFT}
    code = {int(T.documents_words([w.encode()], T.IS_MARK)[0][0]): w for w in tried}
    assert {code[int(h)] for h in words} == want >= {"grumblefig", "snarkle", "blort"}
    assert np.allclose(marks, [sure[code[int(h)]] for h in words])
    weight = {code[int(h)]: (weights[k], marks[k]) for k, h in enumerate(words)}
    for r, (i, t) in zip(sorted(X.score(d, (words, marks, weights)).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.score)),
                         sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))):
        hit = [weight[w] for w in set(split(t)) & weight.keys()]
        z = weights[-1] + sum(a for a, _ in hit) + (weights[-2] * max(m for _, m in hit) if hit else 0)
        assert r.doc_id == i and abs(r.score - 1 / (1 + math.exp(-z))) < 1e-9


def test_toxicity_without_positives(spark):
    d, l, _, _ = frames(spark)
    for labels in (l.limit(0), l.where("toxic = 0")):
        assert {r.predicted for r in X.toxicity(d, labels).collect()} == {0}


def test_non_negative_risk_keeps_clean_words_clean():
    """Unlabelled text holds positives; the classifier still separates them, whatever it makes of a word both share."""
    rng = np.random.default_rng(0)
    pos = np.c_[np.ones(300), rng.random(300) < 0.5, np.ones(300)]
    hidden = rng.random(3000) < 0.1
    unl = np.c_[hidden, rng.random(3000) < 0.5, np.ones(3000)]
    w = X.fit(pos, unl, 0.1)
    assert w[0] + w[2] - abs(w[1]) > 1 and w[2] + abs(w[1]) < -2 and abs(w[1]) < w[0] / 3


def test_quality_on_held_out_rows(spark):
    d, l, rows, labels = frames(spark)
    out = Q.quality(d, l).collect()
    assert len(out) == len(rows) and out[0].asDict().keys() == {"doc_id", "held_out", "score", "predicted"}
    assert all(r.held_out == _held(r.doc_id, 5, 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    mark = {i: q for i, q, _ in labels if q is not None}
    held = [r.predicted == mark[r.doc_id] for r in out if r.held_out and r.doc_id in mark]
    assert sum(held) >= 0.95 * len(held) > 50
    assert Q.quality(d.limit(0), l).count() == 0
    assert len({r.score for r in Q.quality(d, l.limit(0)).collect()}) == 1


def test_discriminant_is_the_difference_of_log_densities():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(400, 3)), rng.normal(size=(900, 3)) @ np.diag([1, 2, .5]) + [1, 0, 0]
    m = Q.Discriminant(np.array([400., 900.]), np.stack([a.sum(0), b.sum(0)]), np.stack([a.T @ a, b.T @ b]))
    pooled = (400 * np.cov(a.T, bias=True) + 900 * np.cov(b.T, bias=True)) / 1300
    x = rng.normal(size=(5, 3))
    logit = np.full(5, np.log(901 / 401))
    for c, s, sign in ((a, 0, -1), (b, 1, 1)):
        cov = 0.9 * np.cov(c.T, bias=True) + 0.1 * np.diag(np.diag(pooled)) + Q.RIDGE * np.eye(3)
        d = x - c.mean(0)
        logit += sign * -0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) + np.linalg.slogdet(cov)[1])
    assert np.allclose(m.score(x), 1 / (1 + np.exp(-logit)))
