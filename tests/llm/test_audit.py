"""The audit against counting every order by applying the filters to the documents."""
import re
from collections import Counter
from itertools import permutations

from lotline.llm import audit
from lotline.llm.queries import QUERIES
from tests.llm.conftest import SF


def brute(docs, labels):
    """Rows by running each order over the documents of a part."""
    good, toxic = ({d for d, *x in labels if d is not None and x[i] == 1} for i in (0, 1))
    fails = []
    for d, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        own = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words))
        own += "C" * (100 * len(re.findall("[A-Z]", text)) > 3 * len(text)) + "D" * bool(re.search("[#$%&*|]", text))
        own += "E" * (d is not None and any(e is not None and e < d and (t or "") == text for e, t, _ in docs))
        fails.append((lang or "", d, set(own)))
    out = []
    for part in {p for p, *_ in fails}:
        removed, rows = Counter(), []
        for order in permutations("ABCDE"):
            left = [(d, own) for p, d, own in fails if p == part]
            everything = left
            for step, f in enumerate(order, 1):
                gone = [d for d, own in left if f in own]
                left = [(d, own) for d, own in left if f not in own]
                removed[f] += len(gone)
                rows.append((part, "".join(order), step, len(left), len(gone),
                             sum(f in own for _, own in everything) - len(gone), sum(own == {f} for _, own in everything),
                             sum(d in good for d in gone), sum(d in toxic for d in gone)))
        out += [(*r, removed[r[1][r[2] - 1]]) for r in rows]
    return sorted(out)


def _frames(spark, docs, labels):
    d = spark.createDataFrame([(*r, "x", 5, 7) for r in docs], "doc_id long, text string, lang string, part string, mask int, n long")
    return d, spark.createDataFrame([(*r, 1) for r in labels], "doc_id long, quality int, toxic int, n int")


LONG = " ".join(f"w{i}" for i in range(250))
DOCS = [(1, LONG, "en"), (2, LONG, "en"), (3, LONG + " $", "en"), (4, "a " * 300, "en"), (5, "AB c", None), (6, "AB c", ""),
        (7, None, "de"), (8, "", "de"), (8, "", "de"), (8, "", "de"), (None, "", "de"), (None, LONG, "en"), (9, LONG.upper(), "en"),
        (10, " \t\n\x0b\x0c\r", "fr"), (11, "a " * 60_000 + "| Ä", "fr"), (12, "x\x1cy z" * 250, "fr"), (12, "a " * 300, "de"),
        (13, "é" * 97 + "ABC", "fr"), (14, "é" * 96 + "ABCD", "fr")]
LABELS = [(1, 1, 0), (2, 1, 1), (3, None, 1), (4, 0, 1), (4, 1, None), (7, 1, 1), (8, 1, 0), (99, 1, 1), (None, 1, 1)]


def test_every_order_like_applying_the_filters(spark):
    got = audit.audit(*_frames(spark, DOCS, LABELS))
    assert sorted(map(tuple, got.collect())) == brute(DOCS, LABELS)
    assert got.columns == [c.split()[0] for c in audit.SCHEMA.split(", ")]


def test_empty_tables(spark):
    docs, labels = _frames(spark, DOCS, LABELS)
    assert audit.audit(docs.limit(0), labels).count() == 0
    rows = audit.audit(docs, labels.limit(0)).collect()
    assert len(rows) == 600 * 4 and all(r.good_lost == r.toxic_lost == 0 for r in rows)


def test_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert sorted(map(tuple, QUERIES["op13_filter_audit"](spark, SF).collect())) == brute(docs, labels)


def test_swaps_lead_through_all_orders_of_a_reduced_diagram():
    names = "ABCDE"
    d = audit.Diagram(names, {0: (5, 1, 0), 3: (5, 1, 0), 16: (1, 0, 0)})
    seen = ["ABCDE"]
    for k in audit.plain_changes(5):
        d.swap(k)
        seen.append("".join(d.order))
        # nodes of a level are distinct: sharing survives the swaps
        for level in range(5):
            pairs = [(id(n.low), id(n.high)) for n in d.level(level)]
            assert len(pairs) == len(set(pairs))
    assert len(seen) == len(set(seen)) == 120
    assert len(d.level(4)) < 16
