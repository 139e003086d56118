"""Ranks of the whole table and keyset pages, against sorting in Python."""

import random

import pytest

from lotline.operators import ranking as R


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(2)
    rows = [(f"V{i:04d}", rnd.choice(["b", "B", "a", "Ä", "c", None, ""]), rnd.choice([1.0, 2.0, 2.0, None, -1.0, 5e9]), rnd.choice([2020, 2021, None]))
            for i in range(700)]
    return rows, spark.createDataFrame(rows, "vin string, title string, price double, year int")


def _sorted(rows, i, ascending):
    key = (lambda r: r[i].lower()) if i == 1 else (lambda r: r[i])
    some = sorted((r for r in rows if r[i] is not None), key=lambda r: r[0])
    some.sort(key=key, reverse=not ascending)
    return some + sorted((r for r in rows if r[i] is None), key=lambda r: r[0])


@pytest.mark.parametrize("column,i", [("title", 1), ("price", 2), ("year", 3)])
@pytest.mark.parametrize("ascending", [True, False])
def test_ranks_and_pages(spark, data, tmp_path, column, i, ascending):
    rows, df = data
    want = [r[0] for r in _sorted(rows, i, ascending)]
    out = R.ranked(df, str(tmp_path / "r"), column, ascending)
    assert [r.vin for r in sorted(out.collect(), key=lambda r: r.sort_rank)] == want
    assert out.columns == [*df.columns, "sort_rank"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan
    seen, after = [], None
    while True:
        page = R.page_after(df, column, 60, after, ascending).collect()
        if not page:
            break
        seen += [r.vin for r in page]
        after = (page[-1][column], page[-1].vin)
    assert seen == want


def test_refusals_and_empty(spark, data, tmp_path):
    _, df = data
    with pytest.raises(ValueError):
        R.ranked(df, str(tmp_path / "x"), "vin; drop")
    with pytest.raises(ValueError):
        R.page_after(df, "price", -1)
    assert R.ranked(df.limit(0), str(tmp_path / "e"), "price").count() == 0
    p = R.page_after(df, "price", 5, (2.0, "V1"))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in p
