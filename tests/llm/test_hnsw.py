import numpy as np

from lotline.llm import hnsw as H

SCHEMA = "vec_id long, embedding array<float>, shard string, q int"


def brute(ids, x, query, k=20):
    s = x @ x[ids == query][0]
    o = [i for i in np.lexsort((ids, -s)) if ids[i] != query][:k]
    return [(int(ids[i]), float(s[i])) for i in o]


def test_recall_with_unequal_norms_and_clusters(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(12, 24)) * 3
    x = (centre[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 24))) * rng.uniform(0.3, 3, (1500, 1))
    x = x.astype(np.float32).astype(np.float64)
    ids = np.arange(1500) * 3
    df = spark.createDataFrame([(int(i), [float(v) for v in r], "s", 1) for i, r in zip(ids, x)], SCHEMA)
    out = H.nearest(df, "vec_id % 20 = 0", shard_rows=400).collect()
    found = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score, r.rank))
    assert set(found) == {int(i) for i in ids if i % 20 == 0}
    hits = 0
    for q, rows in found.items():
        want = brute(ids, x, q)
        assert [r[2] for r in rows] == list(range(1, 21)) and rows == sorted(rows, key=lambda r: (-r[1], r[0]))
        own = dict(zip(ids.tolist(), x @ x[ids == q][0]))
        assert all(abs(own[v] - s) < 1e-9 for v, s, _ in rows)
        hits += len({v for v, _ in want} & {r[0] for r in rows})
    assert hits / (20 * len(found)) >= 0.95


def test_rows_that_take_no_part(spark):
    rows = [(1, [1., 0.]), (2, [0., 0.]), (3, None), (4, [1., None]), (20, [2., 1.]), (20, [2., 1.]), (40, [float("nan"), 1.]),
            (60, [1., 1., 1.]), (None, [1., 1.]), (5, [1., 0.]), (7, []), (6, [float("inf"), 0.])]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], SCHEMA)
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in H.nearest(df, "vec_id % 20 = 0").orderBy("rank").collect()]
    assert got == [(20, 1, 1, 2.0), (20, 2, 5, 2.0)]    # ties to the smaller id; others of its length only
    assert H.nearest(df.limit(0), "vec_id % 20 = 0").count() == 0
    assert H.nearest(df.where("vec_id = 60"), "vec_id % 20 = 0").count() == 0


def test_equal_vectors_are_all_reached(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0], "s", 1) for i in range(300)], SCHEMA)
    out = H.nearest(df, "vec_id % 100 = 0").where("query_id = 0").orderBy("rank").collect()
    assert len(out) == 20 and {r.score for r in out} == {5.0}


def test_whole_table(spark):
    from lotline.llm.queries import QUERIES
    from tests.llm.conftest import SF
    t = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in t]), np.array([r.embedding for r in t], dtype=np.float64)
    rows = QUERIES["op8_hnsw"](spark, SF).collect()
    asked = [int(i) for i in ids if i % 20 == 0]
    assert len(rows) == 20 * len(asked)
    hits = sum(len({v for v, _ in brute(ids, x, q)} & {r.vec_id for r in rows if r.query_id == q}) for q in asked)
    assert hits / len(rows) >= 0.9


def test_copies_beyond_the_width_answer_by_id(spark):
    """A third of the rows are copies, more than the search width in a shard."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 8)).astype(np.float32).astype(np.float64)
    ids = rng.permutation(900)
    x[600:] = 4 * x[0]
    df = spark.createDataFrame([(int(i), [float(v) for v in r], "s", 1) for i, r in zip(ids, x)], SCHEMA)
    asked = sorted({int(i) for i in ids[600:]})[:3] + [int(i) for i in ids[[0, 700, 899]]]
    out = H.nearest(df, f"vec_id in ({', '.join(map(str, asked))})", min_shards=1).collect()
    for q in set(asked):
        got = [r.vec_id for r in sorted((r for r in out if r.query_id == q), key=lambda r: r.rank)]
        assert got == [v for v, _ in brute(ids, x, q)]


def test_an_id_with_several_vectors(spark):
    df = spark.createDataFrame([(i, v, "s", 1) for i, v in [(20, [1., 0.]), (20, [0., 1.]), (1, [2., 0.]), (2, [0., 3.]), (2, [5., 0.])]], SCHEMA)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in H.nearest(df, "vec_id = 20").collect())
    assert got == sorted([(20, 1, 2, 5.), (20, 2, 1, 2.), (20, 3, 2, 0.), (20, 1, 2, 3.), (20, 2, 1, 0.), (20, 3, 2, 0.)])


def test_recall_on_a_full_shard():
    """As many vectors as one shard may hold, around the given ones: 0.9 of the nearest at least."""
    import numpy as np
    import pyarrow.parquet as pq
    from lotline.llm import hnsw as H
    given = [v for v in pq.read_table("/root/testdata/sf0.1/embeddings.parquet")["embedding"].to_pylist() if v]
    rng = np.random.default_rng(1)
    x = np.array(given, dtype=np.float64)
    n = H.SHARD_BYTES // (8 * x.shape[1])
    x = np.concatenate([x, x[rng.integers(0, len(x), n - len(x))] + rng.normal(scale=0.05, size=(n - len(x), x.shape[1]))])
    square = (x * x).sum(axis=1)
    g = H.build(np.concatenate([x, np.sqrt(np.maximum(square.max() - square, 0))[:, None]], axis=1).astype(np.float32))
    asked = rng.choice(n, 200, replace=False)
    found = H._search(g, x, x[asked], 20, H.SEARCH_WIDTH)
    hits = 0
    for row, best in zip(x[asked], found):
        score = x @ row
        best = best[best >= 0]
        hits += len(set(np.argsort(-score)[:20]) & set(best[np.argsort(-score[best])][:20]))
    assert hits >= 0.9 * 20 * len(asked)


def test_ties_beyond_the_search_width(spark):
    """More different vectors of one score than the search is wide: the smallest ids are the answer."""
    import numpy as np
    rng = np.random.default_rng(2)
    rows = [(0, [1.0, 0.0, 0.0, 0.0])] + [(i, [0.5, *rng.normal(size=3).tolist()]) for i in range(1, 500)]
    df = spark.createDataFrame(rows[::-1], "vec_id long, embedding array<double>")
    from lotline.llm import hnsw as H
    got = H.nearest(df, "vec_id = 0", k=20, min_shards=1, width=40).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(i, 0.5) for i in range(1, 21)]
