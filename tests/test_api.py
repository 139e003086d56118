"""End-to-end use of the user-level API: ingest pages twice into a store,
then query it."""

import json

from lotline import api


def _caps(spark, pages):
    rows = [(d, plat, i, url, None, ts, json.dumps(p), "page") for i, (d, plat, url, ts, p) in enumerate(pages)]
    return spark.createDataFrame(rows, "dealer string, platform string, page_no long, source_url string, "
                                       "next_url string, captured_at timestamp_ntz, payload string, capture_kind string")


def test_ingest_then_query(spark, tmp_path):
    import datetime as dt
    t1, t2 = dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 2)
    store = api.VehicleStore(spark, str(tmp_path / "vehicles"))
    first = _caps(spark, [
        ("Dealer A", "dealercom", "https://a.example.com/inv", t1,
         {"DDC": {"InvData": {"inventory": {"inventory": [
             {"vin": "V1", "title": "2024 BMW X5 xDrive40i", "price": 65000, "extColor": "Alpine White"},
             {"vin": "V2", "title": "2024 BMW M3 Competition", "sellingPrice": "$76,000"},
             {"title": "no vin"}]}}}}),
        ("Dealer B", "roadster", "https://b.example.com/inventory", t1,
         {"search": {"vehicles": [{"vin": "V3", "year": 2023, "model": "X7", "price": "$83,000"}]}}),
    ])
    table, rejects = api.ingest(spark, first, store, "2026-01-01 00:00:00")
    assert store.read().count() == 3
    assert [(r.reason, r.dealer, r.page_no, r.pos, r.captured_at) for r in rejects.collect()] == [("no_vin", "Dealer A", 0, 2, t1)]
    second = _caps(spark, [
        ("Dealer A", "dealercom", "https://a.example.com/inv", t2,
         {"inventory": [{"vin": "V1", "title": "2024 BMW X5 xDrive40i", "price": 61000}]}),
    ])
    api.ingest(spark, second, store, "2026-01-02 00:00:00")
    v = store.read()
    assert len(store.versions()) == 2
    rows = {r.vin: r for r in api.get_vehicles(v).collect()}
    assert rows["V1"].price == 61000.0 and rows["V3"].title == "2023 BMW X7" and rows["V2"].price == 76000.0
    assert [r.vin for r in api.get_vehicles(v, search="x5").collect()] == ["V1"]
    assert rows["V1"].ext_color is None  # the newer item carries no colour: a supplied NULL overwrites
    assert [r.dealer for r in api.get_dealers(v).collect()] == ["Dealer A", "Dealer B"]
    assert api.get_models(v).count() >= 28


def test_load_dealers_and_iso(spark, tmp_path):
    csv = tmp_path / "dealers.csv"
    csv.write_text("Dealer,City,Website,Phone\nDealer A,Town,https://a.example.com,1\nDealer B,City,https://b.example.com,2\n"
                   "Dealer C,Ville,https://c.example.com,3\n", encoding="utf-8")
    pm = spark.createDataFrame([("Dealer A", "dealercom", "https://a.example.com/inv"),
                                ("Dealer B", "cargurus", "https://b.example.com/inv")],
                               "name string, platform string, inventory_url string")
    cfg = api.load_dealers(spark, str(csv), pm)
    rows = {r.name: r for r in cfg.collect()}
    assert rows["Dealer A"].supported and not rows["Dealer B"].supported and rows["Dealer C"].platform is None
    from lotline.operators.dealers import first_n
    assert [r.name for r in first_n(cfg, 2).collect()] == ["Dealer A", "Dealer B"]


def test_export_report_and_dealer_lookup(spark, tmp_path):
    import datetime as dt
    import pytest
    from lotline.operators.dealers import by_name, require_rows
    from lotline.sources.schemas import VEHICLES
    now = dt.datetime(2026, 1, 1)
    v = spark.createDataFrame([(1, "A & B <Motors>", "2024 BMW X5", 0, "BMW", "X5", None, "V1", None, 42000.5, 0,
                                None, None, None, "Dealer.com", None, now, now, now)], VEHICLES)
    path = api.export_report(v, str(tmp_path / "report"))
    r = spark.read.option("header", True).csv(path).first()
    assert (r.dealer, r.year, r.price, r.miles, r.ext_color, r.link) == \
        ("A &amp; B &lt;Motors&gt;", "-", "$42,001", "-", "-", "#")
    regs = spark.createDataFrame([("Dealer A",)], "name string")
    assert require_rows(by_name(regs, "Dealer A"), "dealer").count() == 1
    with pytest.raises(LookupError):
        require_rows(by_name(regs, "Nobody"), "dealer")


def test_documented_sql_over_registered_views(spark):
    import datetime as dt
    from lotline.sources.schemas import RUNS, VEHICLES
    now = dt.datetime(2026, 1, 1)
    rows = [(i, d, "t", 2024, "BMW", m, None, f"V{i}", None, 1.0, 1, None, None, None, "Dealer.com", "u", now, now, now)
            for i, (d, m) in enumerate([("A", "X3"), ("A", "X3 M"), ("B", "X5")])]
    runs = [(i, "all", "completed", 0, 0, None, now + dt.timedelta(minutes=i), None, None) for i in range(12)]
    api.register_views(spark, spark.createDataFrame(rows, VEHICLES), spark.createDataFrame(runs, RUNS))
    by_dealer = {r[0]: r[1] for r in spark.sql("SELECT dealer, count(*) FROM vehicles GROUP BY dealer").collect()}
    assert by_dealer == {"A": 2, "B": 1}
    assert spark.sql("SELECT * FROM vehicles WHERE model LIKE '%X3%'").count() == 2
    recent = spark.sql("SELECT * FROM scrape_runs ORDER BY started_at DESC LIMIT 10").collect()
    assert len(recent) == 10 and recent[0].id == 11


def test_old_versions_go_and_readers_follow_the_pointer(spark, tmp_path):
    import datetime as dt
    from lotline.sources.schemas import VEHICLES
    now = dt.datetime(2026, 1, 1)
    store = api.VehicleStore(spark, str(tmp_path / "v"), buckets=2, keep=2)
    for i in range(4):
        store.write(spark.createDataFrame([(i, "D", "t", 2024, "BMW", "X5", None, "V1", None, float(i), 0, None, None, None,
                                            "Dealer.com", "u", now, now, now)], VEHICLES), stamp=f"2026010{i}")
        assert [r.price for r in store.read().collect()] == [float(i)]
    assert store.versions() == ["v=20260102-b2", "v=20260103-b2"]
