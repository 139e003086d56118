"""Listing queries over the five-vehicle fixture."""

import datetime as dt

import pytest

from lotline.operators import search as S
from lotline.sources.schemas import VEHICLES

NOW = dt.datetime(2026, 1, 1)
ROWS = [
    ("BMW of North America", "2024 BMW X5 xDrive40i", 2024, "X5", "5UXCR6C04R9S12345", 67000.0, 65000.0, 100,
     "Alpine White", "dealerrater"),
    ("BMW of Manhattan", "2024 BMW M3 Competition", 2024, "M3", "WBS8M9C09PCP12346", 78000.0, 76000.0, 50,
     "Brooklyn Grey", "dealerrater"),
    ("BMW of North America", "2023 BMW 3 Series 330i", 2023, "3 Series", "WBA5R1C07NBP12347", 45000.0, 42000.0,
     5000, "Jet Black", "cargurus"),
    ("BMW of Los Angeles", "2024 BMW X7 xDrive40i", 2024, "X7", "5UXCW6C07P9M12348", 85000.0, 83000.0, 0,
     "Mineral White", "autotrader"),
    ("BMW of Manhattan", "2024 BMW M4 Coupe", 2024, "M4", "WBS83AJ08PCP12349", 75000.0, 72000.0, 25,
     "Isle of Man Green", "dealerrater"),
]


@pytest.fixture(scope="module")
def vehicles(spark):
    data = [(i + 1, d, t, y, "BMW", m, None, vin, msrp, p, o, c, None, "[]", plat, "https://x/" + vin,
             NOW, NOW, NOW) for i, (d, t, y, m, vin, msrp, p, o, c, plat) in enumerate(ROWS)]
    return spark.createDataFrame(data, VEHICLES)


def _n(df):
    return df.count()


def test_all_sorted_by_price(vehicles):
    got = [r.price for r in S.search_vehicles(vehicles).collect()]
    assert got == [83000.0, 76000.0, 72000.0, 65000.0, 42000.0]


def test_filters(vehicles):
    assert _n(S.search_vehicles(vehicles, dealer="BMW of Manhattan")) == 2
    assert _n(S.search_vehicles(vehicles, model="M3")) == 1
    assert _n(S.search_vehicles(vehicles, min_price=70000, max_price=80000)) == 2
    assert _n(S.search_vehicles(vehicles, min_price=75000)) == 2
    assert [r.price for r in S.search_vehicles(vehicles, max_price=45000).collect()] == [42000.0]
    assert _n(S.search_vehicles(vehicles, min_price=80000, max_price=50000)) == 0
    assert _n(S.search_vehicles(vehicles, min_price=0)) == 5


def test_search(vehicles):
    assert _n(S.search_vehicles(vehicles, search="M3")) >= 1
    assert _n(S.search_vehicles(vehicles, search="5UXCR6C04R9S12345")) == 1
    assert _n(S.search_vehicles(vehicles, search="alpine")) == 1
    assert _n(S.search_vehicles(vehicles, search="")) == 5
    assert _n(S.search_vehicles(vehicles, search="%")) == 5
    assert _n(S.search_vehicles(vehicles, search="M_ Coupe")) == 1


def test_limits(vehicles):
    assert _n(S.search_vehicles(vehicles, limit=2)) == 2
    assert _n(S.search_vehicles(vehicles, limit=-1)) == 5
    assert _n(S.search_vehicles(vehicles, limit=999999)) == 5


def test_bad_price_is_an_error(vehicles):
    with pytest.raises(ValueError):
        S.search_vehicles(vehicles, min_price="cheap")


def test_stats_dealers_models(vehicles):
    st = S.stats(vehicles).first()
    assert (st.total_vehicles, st.total_dealers) == (5, 3)
    assert [r.dealer for r in S.dealers_distinct(vehicles).collect()] == sorted({r[0] for r in ROWS})
    models = [r.model for r in S.models_union(vehicles).collect()]
    assert len(models) >= 28 and models == sorted(models) and None not in models


def test_envelope(vehicles):
    e = S.envelope(S.search_vehicles(vehicles, limit=2), 2).first()
    assert e["count"] == 2 and e.vehicles.startswith('[{"vin":"5UXCW6C07P9M12348"')
    with pytest.raises(ValueError):
        S.envelope(vehicles, -1)


def test_user_sort_nulls_last_case_insensitive(vehicles, spark):
    page = S.with_position(S.search_vehicles(vehicles))
    asc = [r.ext_color for r in S.sort_rows(page, "ext_color").orderBy("sort_rank").collect()]
    assert asc == sorted(asc, key=str.lower)
    desc = [r.odometer for r in S.sort_rows(page, "odometer", ascending=False).orderBy("sort_rank").collect()]
    assert desc == sorted(desc, reverse=True)


def test_stats_approx_close(vehicles):
    st = S.stats(vehicles, approx=True).first()
    assert st.total_vehicles == 5 and abs(st.total_dealers - 3) <= 1


def test_stats_with_last_run(vehicles, spark):
    from lotline.sources.schemas import RUNS
    no_runs = spark.createDataFrame([], RUNS)
    r = S.stats_with_last_run(vehicles.where("false"), no_runs).first()
    assert (r.total_vehicles, r.total_dealers, r.last_run_status) == (0, 0, None)
    runs = spark.createDataFrame([(1, "all", "failed", 3, 1, "x", NOW, NOW, 5),
                                  (2, "all", "running", 7, 1, None, NOW.replace(hour=5), None, 6)], RUNS)
    r = S.stats_with_last_run(vehicles, runs).first()
    assert (r.total_vehicles, r.last_run_status, r.last_run_vehicles_scraped) == (5, "running", 7)


def test_first_n_zero_means_all(spark):
    from lotline.operators.dealers import first_n
    d = spark.createDataFrame([(f"D{i}", i) for i in range(7)], "name string, ord long")
    assert first_n(d, 0).count() == 7 and first_n(d, None).count() == 7
    assert [r.name for r in first_n(d, 3).collect()] == ["D0", "D1", "D2"]
