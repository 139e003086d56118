import hashlib
import random
from collections import Counter

import numpy as np

from lotline.llm import suffixdedup as S
from lotline.llm import suffixes as X
from tests.llm.conftest import SF, docs


def test_suffix_arrays():
    rnd = random.Random(1)
    for k in range(300):
        letters = rnd.choice([b"a", b"ab", b"abc", bytes(range(256)), b"\x00\xff"])
        b = bytes(rnd.choice(letters) for _ in range(rnd.randrange(1, 100))) * rnd.choice([1, 3])
        t = np.frombuffer(b, np.uint8)
        sa = X.suffix_array(t)
        want = sorted(range(len(b)), key=lambda i: b[i:])
        assert sa.tolist() == want
        plcp, before = X.permuted_lcp(t, sa)
        for i, j in zip(want[1:], want):
            n = 0
            while max(i, j) + n < len(b) and b[i + n] == b[j + n]:
                n += 1
            assert (plcp[i], before[i]) == (n, j)


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i: i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for (d, _), b in zip(rows, texts):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i: i + length]] > 1:
                gone[i: i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def ours(spark, rows, length=200, **k):
    return sorted((tuple(r) for r in S.remove_repeats(docs(spark, rows), length, **k).collect()), key=repr)


def corpus():
    rnd = random.Random(3)
    text = lambda n, letters="abcdefghij é\n": "".join(rnd.choice(letters) for _ in range(n))
    base = text(900)
    rows = [(i, text(rnd.randrange(0, 400)) + base[rnd.randrange(0, 300): rnd.randrange(300, 900)] + text(rnd.randrange(0, 300)))
            for i in range(50)]
    return rows + [(100, None), (101, ""), (102, "a" * 1500), (103, "ab" * 700 + text(50)), (104, rows[0][1]), (104, rows[1][1]),
                   (104, rows[1][1]), (None, rows[2][1][50:]), (105, text(3000, "ab")), (106, "x" * 199), (107, "x" * 200), (108, "x" * 199)]


def test_every_repeat_and_nothing_else(spark):
    rows = corpus()
    for length in (200, 64):
        assert ours(spark, rows, length) == brute(rows, length)


def test_split_anchors_and_small_parts(spark, monkeypatch):
    rows = corpus()
    assert ours(spark, rows, 64, split=3, shard_bytes=3000) == brute(rows, 64)
    monkeypatch.setattr(S, "PART", 250)   # applies where the runs are made in this process
    made = S.window_runs([(t or "").encode() for _, t in rows], 64)
    assert made[2].sum() == sum(max(0, len((t or "").encode()) - 63) for _, t in rows)


def test_texts_and_empty_table(spark):
    assert ours(spark, []) == []
    r = S.remove_repeats(docs(spark, [(1, "q" * 10 + "z" * 40), (2, "z" * 40)]), 40, text_out=True).orderBy("doc_id").collect()
    assert [(x.n_removed, bytes(x.kept)) for x in r] == [(40, b"q" * 10), (40, b"")]


def test_whole_table(spark):
    from lotline.llm.queries import QUERIES
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in QUERIES["op10_suffix_dedup"](spark, SF).collect()), key=repr) == brute(rows, 200)


def test_equal_rows_share_one_list_of_spans(spark, monkeypatch):
    """5,000 equal rows have the spans of one row of two, not those of all rows each."""
    from pyspark.sql import functions as F
    rnd = random.Random(8)
    text = "".join(rnd.choice("abcdefghij \n") for _ in range(2300))
    part = (2, text[300:900] + "".join(rnd.choice("klmnop") for _ in range(300)))
    lists = []
    cut = S._cut
    monkeypatch.setattr(S, "_cut", lambda df, *a: lists.append(
        df.select("doc_id", F.size("spans").alias("k")).distinct().collect()) or cut(df, *a))
    got = {}
    for n in (2, 5000):
        rows = ours(spark, [(1, text)] * n + [part])
        assert len(rows) == n + 1 and len(set(rows)) == 2
        got[n] = set(rows)
    assert got[2] == got[5000] == set(brute([(1, text)] * 2 + [part], 200))
    assert sorted(lists[0]) == sorted(lists[1]) and len(lists[1]) == 2
