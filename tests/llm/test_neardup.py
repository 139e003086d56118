import random
from itertools import combinations

from lotline.llm import components as C
from lotline.llm import neardup as N
from tests.llm.conftest import SF, docs


def shingles(text, n=5):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = (text or "").translate(table).replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").replace("\t", " ").replace("\n", " ")
    w = [x for x in w.split(" ") if x]
    n = min(n, len(w))
    return {tuple(w[i: i + n]) for i in range(len(w) - n + 1)} if n else set()


def brute(rows):
    """component of each row, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i
    for i, j in combinations([i for i, (d, _) in enumerate(rows) if d is not None and sets[i]], 2):
        both = len(sets[i] & sets[j])
        if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
            up[top(i)] = top(j)
    out = []
    for i, (d, _) in enumerate(rows):
        c = None if d is None else min(rows[j][0] for j in range(len(rows)) if rows[j][0] is not None and top(j) == top(i)) if sets[i] else d
        out.append((d, len(sets[i]), c, c is None or c == d))
    return sorted(out, key=repr)


def ours(spark, rows, **k):
    out = N.near_duplicates(docs(spark, rows), **k)
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out.collect()), key=repr)


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    rows = []
    for _ in range(14):
        base = [word() for _ in range(rnd.choice([3, 12, 60, 150]))]
        for _ in range(rnd.choice([1, 3, 9])):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 6])):
                k = rnd.randrange(len(w))
                w[k: k + rnd.choice([0, 1])] = [word()] * rnd.choice([0, 1])
            rows.append((rnd.randrange(10**6), " ".join(w)))
    # a chain: neighbours similar, ends not
    w = [word() for _ in range(120)]
    for i in range(12):
        w = [*w[:8 * i], word(), *w[8 * i + 1:]]
        rows.append((2_000_000 + i, " ".join(w)))
    return rows


def test_all_links_are_found(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        assert ours(spark, rows) == brute(rows)


def test_blocks_of_a_large_list(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 3)
    monkeypatch.setattr(N, "BUCKET_ROWS", 5)
    rows = corpus(3)
    assert ours(spark, rows) == brute(rows)


def test_edge_rows(spark):
    rows = [(5, "A b"), (3, "a\tB"), (9, "a b c"), (1, None), (2, ""), (4, " \n\x0b "), (None, "a b"), (7, "w " * 30000), (6, "w " * 40000),
            (8, "x"), (8, "x"), (10, "p q r s t u"), (10, "other words are in this one"), (11, "é f g h i j")]
    assert ours(spark, rows) == brute(rows)
    assert ours(spark, []) == []
    assert ours(spark, [(1, None), (2, "")]) == brute([(1, None), (2, "")])


def test_components_of_a_chain_a_star_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(7, 7), (200, 201), (201, 200), (200, 201), (None, 3)]
    got = {r.id: r.component for r in C.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_whole_table(spark):
    from lotline.llm.queries import QUERIES
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in QUERIES["op3_minhash_neardup"](spark, SF).collect()), key=repr)
    assert got == brute(rows)
