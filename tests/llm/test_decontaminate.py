import random

from lotline.llm import decontaminate as D
from tests.llm.conftest import docs
from tests.llm.test_neardup import shingles


def brute(rows, items):
    out = []
    for d, text in rows:
        for i, item in items:
            own = shingles(item)
            if own:
                width = len(next(iter(own)))
                both = len(own & (shingles(text, width) if len(shingles(text, 1)) and len((text or "").split()) >= width else set()))
                if 100 * both >= 80 * len(own):
                    out.append((d, i, len(own), both))
    return sorted(out, key=repr)


def corpus():
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(3))
    items = [(i, " ".join(word() for _ in range(rnd.choice([1, 2, 4, 5, 9, 30])))) for i in range(25)]
    items += [(25, None), (26, ""), (0, items[0][1]), (None, items[3][1]), (27, "a a a a a a a")]
    rows = []
    for i in range(80):
        w = [word() for _ in range(rnd.choice([0, 3, 40, 400]))]
        for _ in range(rnd.choice([0, 0, 1, 2])):
            x = (rnd.choice(items[:25])[1]).split()
            for _ in range(rnd.choice([0, 1, 2])):
                x[rnd.randrange(len(x))] = word()
            at = rnd.randrange(len(w) + 1)
            w[at:at] = x
        rows.append((i, " ".join(w)))
    return rows + [(100, None), (101, ""), (None, items[5][1]), (0, rows[0][1]), (102, "A a\ta\nA a a"), (103, "q " * 50000 + items[8][1])], items


def ours(spark, rows, items, **k):
    t = spark.createDataFrame([(*r, 1, "w") for r in items], "item_id long, text string, width int, sketch string")
    return sorted((tuple(r) for r in D.contaminated(docs(spark, rows), t, **k).collect()), key=repr)


def test_every_contained_item(spark):
    rows, items = corpus()
    want = brute(rows, items)
    assert len(want) > 20
    assert ours(spark, rows, items) == want
    assert ours(spark, rows, items, sketches=0) == want      # by shuffles


def test_empty_tables(spark):
    rows, items = corpus()
    assert ours(spark, [], items) == [] and ours(spark, rows, []) == [] and ours(spark, rows, [(1, None), (2, "")]) == []
    assert ours(spark, [], items, sketches=0) == []


def test_sketch_is_as_long_as_the_threshold_asks():
    for n in range(1, 200):
        # a document that holds enough shingles lacks fewer than the sketch has
        assert D.sketch_length(D.partition(n)) > n - D.need(n) and 100 * D.need(n) >= 80 * n > 100 * (D.need(n) - 1)
        assert 1 << D.partition(n) <= n < 2 << D.partition(n)


def test_items_without_an_id_are_found_on_both_paths(spark):
    item = " ".join(f"w{k}" for k in range(30))
    d = spark.createDataFrame([(1, f"before {item} after"), (2, "other words")], "doc_id long, text string")
    i = spark.createDataFrame([(None, item), (7, " ".join(f"v{k}" for k in range(30)))], "item_id long, text string")
    for sketches in (D.SKETCHES, 1):
        assert [tuple(r) for r in D.contaminated(d, i, sketches=sketches).collect()] == [(1, None, 26, 26)]
