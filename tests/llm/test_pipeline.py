from itertools import combinations

import corpus_pipeline as P
from lotline.llm import common, toxicity
from tests.llm.conftest import SF
from tests.llm.test_decontaminate import brute as contained
from tests.llm.test_linededup import brute as lines
from tests.llm.test_linededup import brute_words
from tests.llm.test_neardup import brute as near
from tests.llm.test_neardup import shingles


def _rows(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_stages_do_what_their_brute_force_versions_do(spark):
    docs = common.table(spark, SF, "documents")
    columns = docs.columns
    model = toxicity.train(docs.select("doc_id", "text"), common.table(spark, SF, "labels"))
    start = _rows(docs)
    scores = toxicity.scores([t.encode() for _, t in start], model)
    items = [tuple(r) for r in common.table(spark, SF, "benchmark").select("item_id", "text").collect()]
    want = [r for r, s in zip(start, scores) if s < 0.7]
    after = []
    for name, stage in P.STAGES:
        docs = common.written(stage(spark, docs, SF), "test")
        after.append(name)
        if name == "line dedup":
            want = [(d, t) for d, t, _, _ in brute_words(want)]
        elif name == "near-dedup":
            kept = _groups80(want)
            want = [r for r in want if r[0] in kept]
        elif name == "decontamination":
            leaks = {d for d, *_ in contained(want, items)}
            want = [r for r in want if r[0] not in leaks]
        if name == "BPE":
            assert sorted(r.doc_id for r in docs.collect()) == sorted(d for d, _ in want)
            assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        else:
            assert _rows(docs) == sorted(want, key=repr), name
            assert docs.columns == columns
            if "n_chars" in columns and name != "toxicity":
                assert docs.where("n_chars <> length(text)").count() == 0
    assert after == ["toxicity", "line dedup", "near-dedup", "decontamination", "BPE"]
    assert 0 < len(want) < len(start)


def test_odd_rows_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, n_chars long, n_lines int"
    rows = [(1, "a b c d e f", "en", 1, 0), (1, "a b c d e f", "en", 1, 0), (2, "a b c d e f", "fr", 1, 0), (None, "x", "en", None, 0),
            (3, None, None, None, None), (1, "q r s t u v", "en", 2, 0), (4, "", "en", 0, 0), (3, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in P.STAGES:
        assert stage(spark, docs.limit(0) if name != "BPE" else docs.limit(0), SF).count() == 0
        out = common.written(stage(spark, docs, SF), "test")
        if name != "BPE":
            assert out.columns == (docs.columns if name != "line dedup" else docs.columns)
        if name == "near-dedup":
            assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(
                [(1, "a b c d e f"), (1, "q r s t u v"), (None, "x"), (3, None), (3, None), (4, "")], key=repr)


def test_run_gives_the_last_stage(spark):
    out = P.run(spark, SF)
    assert out.count() > 0 and "n_tokens" in out.columns


def test_line_stage_takes_long_repeats_of_one_line(spark):
    docs = common.table(spark, SF, "documents")
    rows = _rows(docs)
    want = [(d, t) for d, t, _, _ in brute_words(rows)]
    assert want != [(d, t) for d, t, _, _ in lines(rows)]
    assert _rows(P.drop_repeated_lines(spark, docs, SF)) == sorted(want, key=repr)


def _groups80(rows):
    """Smallest id of each group of rows linked by 80 of 100 shared shingles, by all pairs."""
    sets = {d: shingles(t) for d, t in rows}
    up = {d: d for d in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i
    for i, j in combinations([d for d in sorted(sets) if sets[d]], 2):
        both = len(sets[i] & sets[j])
        if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            i, j = sorted((top(i), top(j)))
            up[j] = i
    return {d for d in sets if top(d) == d}


def test_near_stage_takes_copies_from_80_of_100_on(spark):
    """On raw documents, and in the chain with long line repeats gone before and benchmark items after."""
    docs = common.table(spark, SF, "documents")
    rows = _rows(docs)
    kept = _groups80(rows)
    assert kept < {d for d, _, _, k in near(rows) if k}
    assert _rows(P.drop_near_duplicates(spark, docs, SF)) == sorted((r for r in rows if r[0] in kept), key=repr)

    want = [(d, t) for d, t, _, _ in brute_words(rows)]
    kept = _groups80(want)
    items = [tuple(r) for r in common.table(spark, SF, "benchmark").select("item_id", "text").collect()]
    want = [r for r in want if r[0] in kept]
    leaks = {d for d, *_ in contained(want, items)}
    for name, stage in P.STAGES[1:4]:
        docs = common.written(stage(spark, docs, SF), "test")
    assert _rows(docs) == sorted((r for r in want if r[0] not in leaks), key=repr)


def test_rows_that_differ_in_other_columns_only(spark):
    """Of rows equal in id and text the least by the other columns stays; names of helpers may be taken."""
    rows = [(1, "a b c d e f", x, y, 1) for x, y in (("fr", "z"), ("en", "z"), ("en", "b"), (None, "q"))] + [(2, "g h i j k l", "en", "a", 2)]
    for _ in range(2):
        rows = rows[::-1]
        docs = spark.createDataFrame([(d, t, x, y, n, "own", "own") for d, t, x, y, n in rows],
                                     "doc_id long, text string, lang string, source string, n_chars long, rid string, __rid string")
        out = common.written(P.drop_near_duplicates(spark, docs, SF), "test")
        assert sorted(map(tuple, out.collect())) == [(1, "a b c d e f", "en", "b", 1, "own", "own"), (2, "g h i j k l", "en", "a", 2, "own", "own")]
        out = P.drop_benchmark(spark, docs, SF)
        assert out.columns == docs.columns and out.where("rid <> 'own' or __rid <> 'own'").count() == 0
