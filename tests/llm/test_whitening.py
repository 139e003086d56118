"""Whitening against numpy's symmetric eigensolver and exact whole numbers."""
import math

import numpy as np
import pytest

from lotline.llm import whitening
from lotline.llm.queries import QUERIES
from tests.llm.conftest import SF

NAN, INF = float("nan"), float("inf")


def check(rows, vectors, most=32):
    """``rows`` hold against the fit of (vec_id, vector) pairs."""
    good = [(i, v) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * c) + 1000000 for c in v] for _, v in good], dtype=object)
    n, d = x.shape
    sums = x.sum(axis=0)
    y = n * x - sums                                   # exact
    cov = (y.T @ y).astype(float) / float(n) ** 3
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    k = min(most, int((e > d * 1e-15 * e[0]).sum()) if e[0] > 0 else 0)
    assert len(rows) == n * k
    dev = [int((r * r).sum()) for r in y]
    want = {}
    for (i, _), g in zip(good, dev):
        want.setdefault((i, g), 0)
        want[i, g] += k
    for r in rows:
        want[r.vec_id, r.deviation] -= 1
        assert r.n == n and 0 <= r.identity_error <= 1e-4
        assert math.isclose(r.explained, e[r.component - 1] / e.sum(), rel_tol=1e-9)
    assert not any(want.values())
    by = {}
    for r in rows:
        by.setdefault(r.component, {}).setdefault(r.vec_id, []).append(r.whitened)
    centred = y.astype(float) / n
    for c in range(1, k + 1):
        gap = min(abs(e[c - 1] - e[j]) for j in range(d) if j != c - 1) if d > 1 else 1.0
        if gap < 1e-6 * e[0]:
            continue                                   # any basis of equal eigenvalues will do
        mine = centred @ u[:, c - 1] / math.sqrt(e[c - 1])
        got = {i: list(v) for i, v in by[c].items()}
        sign = None
        for (i, _), m in sorted(zip(good, mine), key=lambda p: -abs(p[1])):
            near = min(got[i], key=lambda v: abs(abs(v) - abs(m)))
            got[i].remove(near)
            sign = sign or math.copysign(1, near * m)
            assert abs(near - sign * m) < 1e-7


def _frame(spark, vectors):
    return spark.createDataFrame([(i, v, 1, "x", [1]) for i, v in vectors],
                                 "vec_id long, embedding array<float>, label int, n string, sums array<int>")


@pytest.mark.parametrize("d,n", [(1, 5), (2, 3), (7, 40), (40, 300), (33, 20)])
def test_like_an_eigensolver(spark, d, n):
    rnd = np.random.default_rng(d)
    data = (rnd.normal(size=(n, d)) * np.linspace(0.1, 2, d)) @ rnd.normal(size=(d, d)) + 3
    vectors = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(data)]
    check(whitening.whitened(_frame(spark, vectors)).collect(), vectors)


def test_rows_that_take_no_part_and_repeats(spark):
    rnd = np.random.default_rng(1)
    vectors = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(rnd.normal(size=(50, 4)))]
    vectors += vectors[:3] + [(90, None), (91, [1.0, None, 2.0, 3.0]), (92, [1.0, NAN, 0.0, 0.0]), (93, [INF, 1.0, 1.0, 1.0]),
                              (None, [0.5, 0.5, 0.5, 0.5]), (94, [0.0] * 4), (95, [])]
    taking = [v for v in vectors if v[0] not in (90, 91, 92, 93, 95)]
    check(whitening.whitened(_frame(spark, vectors)).collect(), taking)
    # another length is a fit of its own
    other = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(rnd.normal(size=(30, 3)), 1000)]
    rows = whitening.whitened(_frame(spark, vectors + other)).collect()
    check([r for r in rows if r.n == 30], other)
    check([r for r in rows if r.n != 30], taking)


def test_without_variance(spark):
    one = _frame(spark, [(1, [1.0, 2.0])])
    assert whitening.whitened(one).count() == 0
    assert whitening.whitened(one.unionAll(one)).count() == 0
    empty = whitening.whitened(one.limit(0))
    assert empty.count() == 0 and empty.columns == [c.split()[0] for c in whitening.SCHEMA.split(", ")]
    # a constant dimension takes rank away
    flat = _frame(spark, [(i, [float(i), 7.0, float(i * i)]) for i in range(6)])
    assert {r.component for r in whitening.whitened(flat).collect()} == {1, 2}


def test_deviation_beyond_a_long_is_null(spark):
    c = whitening.Centre(2, [0, 0])
    assert c.deviation(np.array([[1 << 31, 0], [3, 4]])) == [None if 4 * (1 << 62) >= 1 << 63 else 0, 100]


def test_many_lengths_are_refused(spark):
    df = _frame(spark, [(n, [1.0] * n) for n in range(1, whitening.LENGTHS + 2)])
    with pytest.raises(ValueError, match="lengths"):
        whitening.whitened(df)


def test_decompositions():
    rnd = np.random.default_rng(3)
    for d, r in ((6, 6), (9, 4), (30, 30)):
        b = rnd.normal(size=(d, r)) * 10.0 ** rnd.integers(-4, 4, size=r)
        a = b @ b.T
        low = whitening.pivoted_cholesky(a)
        assert np.allclose(low @ low.T, a, atol=1e-12 * a.max())
        w = whitening.one_sided_jacobi(low)
        norms = np.sqrt((w * w).sum(axis=0))
        cos = (w / norms).T @ (w / norms) - np.eye(w.shape[1])
        assert np.abs(cos).max() < 1e-13 and np.allclose(w @ w.T, a, atol=1e-12 * a.max())


def test_whole_table(spark):
    vectors = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(QUERIES["op12_whitening"](spark, SF).collect(), vectors)
