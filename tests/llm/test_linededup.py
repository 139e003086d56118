import random

from lotline.llm import linededup as L
from tests.llm.conftest import docs


def brute(rows, run=3):
    """Text of each row after the runs that occur at an earlier place are gone."""
    keyed = {}
    for i, t in rows:
        if t is not None:
            keyed[i, t] = [(x.strip(" \t\n\r\x0b\x0c"), k) for k, x in enumerate(t.split("\n")) if x.strip(" \t\n\r\x0b\x0c")]
    seen, gone = set(), {}
    for i, t in sorted(keyed, key=lambda x: (x[0] is None, x[0] or 0)):
        lines = keyed[i, t]
        for s in range(len(lines) - run + 1):
            key = tuple(x for x, _ in lines[s: s + run])
            if key in seen:
                gone.setdefault((i, t), set()).update(k for _, k in lines[s: s + run])
            seen.add(key)
    out = []
    for i, t in rows:
        g = gone.get((i, t), set())
        out.append((i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in g),
                    0 if t is None else len(t.split("\n")), len(g)))
    return sorted(out, key=repr)


def ours(spark, rows, **k):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_removed)
                   for r in L.remove_repeated_lines(docs(spark, rows), **k).collect()), key=repr)


def test_later_repeats_go(spark):
    rnd = random.Random(4)
    lines = [f"line {i}" for i in range(25)] + ["", "  ", "dup", "dup"]
    rows = [(i, "\n".join(rnd.choice(lines) if rnd.random() < .2 else lines[(i * 7 + j) % 29] for j in range(rnd.randrange(0, 20))))
            for i in range(50)]
    rows += [(60, "a\na\na\na\na\na"), (61, None), (62, ""), (63, "\n\n\n\n\n\n"), (64, " x \ny\t\n z"), (65, "x\ny\nz\n"),
             (66, "x\ny"), (67, "x\n\ny\n \nz"), (70, "\n".join(f"l{i}" for i in range(3000))), (71, "\n".join(f"l{i}" for i in range(2000, 4000)))]
    for run in (3, 2):
        assert ours(spark, rows, run=run) == brute(rows, run)
    assert sum(r[3] for r in brute(rows)) > 1000


def test_repeated_rows_and_missing_ids(spark):
    t = "p\nq\nr\ns"
    rows = [(2, t), (2, t), (None, t), (1, "x\ny\nz\n" + t)]
    assert ours(spark, rows) == brute(rows) == [(1, "x\ny\nz\n" + t, 7, 0), (2, "", 4, 4), (2, "", 4, 4), (None, "", 4, 4)]
    assert ours(spark, []) == []


def test_columns_come_through(spark):
    out = L.remove_repeated_lines(docs(spark, [(1, "a\nb\nc")]))
    assert out.columns == ["doc_id", "text", "rid", "n", "v", "n_lines", "n_removed"]
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def brute_words(rows, run=3, words=50):
    """As ``brute``, and runs of fewer lines that hold ``words`` words or more."""
    keyed = {}
    for i, t in rows:
        if t is not None:
            keyed[i, t] = [(x.strip(" \t\n\r\x0b\x0c"), k) for k, x in enumerate(t.split("\n")) if x.strip(" \t\n\r\x0b\x0c")]
    seen, gone = set(), {}
    for i, t in sorted(keyed, key=lambda x: (x[0] is None, x[0] or 0)):
        lines = keyed[i, t]
        for n in range(1, run + 1):
            for s in range(len(lines) - n + 1):
                key = tuple(x for x, _ in lines[s: s + n])
                if n == run or sum(len(x.split()) for x in key) >= words:
                    if key in seen:
                        gone.setdefault((i, t), set()).update(k for _, k in lines[s: s + n])
                    seen.add(key)
    out = []
    for i, t in rows:
        g = gone.get((i, t), set())
        out.append((i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in g),
                    0 if t is None else len(t.split("\n")), len(g)))
    return sorted(out, key=repr)


def test_long_repeats_of_one_or_two_lines_go(spark):
    long, half, rest = (" ".join(f"{x}{k}" for k in range(n)) for x, n in (("w", 60), ("a", 30), ("b", 20)))
    rows = [(1, long), (2, f"x\n {long} \ny"), (3, f"{half}\n\n{rest}\np"), (4, f"q\n{half}\n{rest}"), (5, f"{half}\nr"),
            (6, f"{long}\n{long}"), (7, "x\ny"), (None, long), (8, None), (9, "")]
    got = {r[0]: r[1:] for r in ours(spark, rows, words=50)}
    assert got[1] == (long, 1, 0) and got[2] == ("x\ny", 3, 1) and got[4] == ("q", 3, 2) and got[5][2] == 0 and got[6] == ("", 2, 2)
    assert got[None] == ("", 1, 1) and got[7][2] == 0
    assert ours(spark, rows, words=50) == brute_words(rows)
    rnd = random.Random(9)
    lines = [" ".join(rnd.choice("abcdef") for _ in range(rnd.randrange(1, 12))) for _ in range(60)] + [""]
    rows = [(i, "\n".join(rnd.choice(lines) for _ in range(rnd.randrange(0, 8)))) for i in range(120)]
    for run, words in ((3, 10), (2, 8), (4, 14)):
        assert ours(spark, rows, run=run, words=words) == brute_words(rows, run, words) != brute(rows, run)


def test_whole_table(spark):
    """The query takes long repeats of one or two lines as well; of lines of 50 words or more none is left twice."""
    import hashlib
    from lotline.llm.queries import QUERIES
    from tests.llm.conftest import SF
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = brute_words(rows)
    got = sorted(((r.doc_id, r.n_lines, r.n_removed, r.text_sha256) for r in QUERIES["op6_line_dedup"](spark, SF).collect()), key=repr)
    assert got == sorted(((d, n, k, hashlib.sha256((t or "").encode()).hexdigest()) for d, t, n, k in want), key=repr)
    assert want != brute(rows)
    long = [x.strip() for _, t, _, _ in want for x in (t or "").split("\n") if len(x.split()) >= 50]
    assert len(long) == len(set(long))


def test_clashing_names_come_through(spark):
    names = ["rid", "gone", "lines", "_rid", "__rid", "__gone", "__lines", "h", "at", "i"]
    df = spark.createDataFrame([(1, "a\nb\nc", *names), (2, "a\nb\nc\nd", *names)], ", ".join(
        ["doc_id long", "text string", *(f"{n} string" for n in names)]))
    out = L.remove_repeated_lines(df, words=50)
    assert out.columns == [*df.columns, "n_lines", "n_removed"]
    rows = {r.doc_id: r for r in out.collect()}
    assert all(r[n] == n for r in rows.values() for n in names) and rows[2].text == "d" and rows[1].n_removed == 0
