"""VIN upsert semantics: insert, update, null overwrite, absent keep, last
write wins, constraint rejects, order-aware merge and idempotence."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lotline.operators.upsert import duplicate_vins, merge
from lotline.sources.schemas import VEHICLES

T0 = dt.datetime(2025, 1, 1)
AS_OF = "2026-01-01 00:00:00"
ITEM_SCHEMA = ("vin string, dealer string, dealer_platform string, source_url string, title string, "
               "price double, odometer int, seq int")


def _target(spark, rows=()):
    data = [(i + 1, "D", t, None, "BMW", "X3", None, vin, None, p, None, None, None, None, "Dealer.com",
             "https://u", T0, T0, T0) for i, (vin, t, p) in enumerate(rows)]
    return spark.createDataFrame(data, VEHICLES)


def _items(spark, rows):
    return spark.createDataFrame(rows, ITEM_SCHEMA)


def _by_vin(df):
    return {r.vin: r.asDict() for r in df.collect()}


def test_insert_then_update_keeps_id_and_created_at(spark):
    target = _target(spark, [("V1", "2024 BMW X5 xDrive40i", 65000.0)])
    items = _items(spark, [("V1", "D", "Dealer.com", "https://u", "2024 BMW X5 xDrive40i", 61000.0, 10, 1),
                           ("V2", "E", "Roadster", "https://v", "2025 BMW M4 Competition", 90000.0, 5, 1)])
    out, rej = merge(target, items, AS_OF, seq=["seq"])
    rows = _by_vin(out)
    assert rows["V1"]["id"] == 1 and rows["V1"]["created_at"] == T0
    assert rows["V1"]["price"] == 61000.0 and rows["V1"]["updated_at"] == dt.datetime(2026, 1, 1)
    assert rows["V1"]["model"] == "X5" and rows["V1"]["trim"] == "xDrive40i"
    assert rows["V2"]["created_at"] == dt.datetime(2026, 1, 1) and rows["V2"]["model"] == "M4"
    assert rej.count() == 0 and duplicate_vins(out).count() == 0


def test_last_write_wins(spark):
    items = _items(spark, [("V1", "D", "Dealer.com", "https://u", "2024 BMW X5", 80000.0, 1, 1),
                           ("V1", "D", "Dealer.com", "https://u", "2024 BMW X5", 82000.0, 1, 2)])
    out, _ = merge(_target(spark), items, AS_OF, seq=["seq"])
    assert _by_vin(out)["V1"]["price"] == 82000.0


def test_supplied_null_overwrites_absent_keeps(spark):
    target = _target(spark, [("V1", "2024 BMW X5", 65000.0)])
    items = spark.createDataFrame([("V1", None, 7)], "vin string, price double, odometer int")
    out, _ = merge(target, items, AS_OF, identity="payload")
    r = _by_vin(out)["V1"]
    assert r["price"] is None and r["odometer"] == 7 and r["title"] == "2024 BMW X5" and r["model"] == "X3"


def test_invalid_item_rejected_previous_write_stands(spark):
    items = _items(spark, [("V1", "D", "Dealer.com", "https://u", "2024 BMW X5", 1.0, 1, 1),
                           ("V1", "D", "Dealer.com", "https://u", None, 2.0, 1, 2),
                           ("V2", None, "Dealer.com", "https://u", "2024 BMW X1", 3.0, 1, 1)])
    out, rej = merge(_target(spark), items, AS_OF, seq=["seq"])
    assert _by_vin(out)["V1"]["price"] == 1.0 and "V2" not in _by_vin(out)
    assert sorted((r.vin, tuple(r.violations)) for r in rej.collect()) == [("V1", ("title",)), ("V2", ("dealer",))]


def test_insert_missing_required_column_is_rejected(spark):
    items = spark.createDataFrame([("V9", 5.0)], "vin string, price double")
    out, rej = merge(_target(spark), items, AS_OF, identity="payload")
    assert out.count() == 0 and rej.first().vin == "V9"


def test_order_aware_merge_ignores_older_items(spark):
    items_new = _items(spark, [("V1", "D", "Dealer.com", "https://u", "2024 BMW X5", 2.0, 1, 5)])
    items_old = _items(spark, [("V1", "D", "Dealer.com", "https://u", "2024 BMW X5", 1.0, 1, 3)])
    t1, _ = merge(_target(spark).withColumn("_seq", F.lit(None).cast("struct<seq:int>")), items_new, AS_OF,
                  seq=["seq"], keep_seq=True)
    t2, _ = merge(t1, items_old, AS_OF, seq=["seq"], keep_seq=True)
    assert _by_vin(t2)["V1"]["price"] == 2.0


def test_merge_is_idempotent(spark):
    items = _items(spark, [("V1", "D", "Dealer.com", "https://u", "2024 BMW X5", 2.0, 1, 5)])
    once, _ = merge(_target(spark), items, AS_OF, seq=["seq"])
    twice, _ = merge(once, items, AS_OF, seq=["seq"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


@pytest.mark.parametrize("price", [0.0, -1000.0, None])
def test_unusual_prices_allowed(spark, price):
    items = _items(spark, [("V1", "D", "Dealer.com", "https://u", "2024 BMW X5", price, 1, 1)])
    out, rej = merge(_target(spark), items, AS_OF, seq=["seq"])
    assert _by_vin(out)["V1"]["price"] == price and rej.count() == 0


def test_create_tables_and_bulk_insert(spark, tmp_path):
    from lotline.operators.upsert import bulk_insert, create_tables
    paths = create_tables(spark, str(tmp_path))
    assert spark.read.parquet(paths["vehicles"]).count() == 0
    assert spark.read.parquet(paths["scrape_runs"]).columns[:3] == ["id", "platform", "status"]
    bulk_insert(_target(spark, [("V1", "t", 1.0), ("V2", "u", 2.0)]), paths["vehicles"])
    assert spark.read.parquet(paths["vehicles"]).count() == 2


def test_last_rows_by_a_packed_order(spark):
    import random
    from lotline.operators.upsert import last_per_key, last_rows, packed_order
    rnd = random.Random(7)
    rows = [(rnd.choice(["a", "b", "c", None]), rnd.choice([None, T0, T0 + dt.timedelta(microseconds=rnd.randrange(9))]),
             rnd.choice([None, -5, 2 ** 40]), i, str(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "vin string, at timestamp_ntz, big bigint, n int, note string")
    order = ["at", "big", "n"]
    got = last_rows(df, "vin", order)
    # nulls come first in both
    assert sorted(map(str, got.collect())) == sorted(map(str, last_per_key(df, "vin", order).select(*df.columns).collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan and "partial_max(" in plan
    # an order of 38 digits and more, or of text, is left to the other way
    wide = spark.createDataFrame([("a", -2 ** 62, 2 ** 62, 1), ("a", 2 ** 62, -2 ** 62, 2), ("a", 2 ** 62, -2 ** 62, 3)],
                                 "vin string, x bigint, y bigint, n int")
    assert packed_order(wide.withColumn("z", F.col("x")), ["x", "y", "z"]) is None and packed_order(df, ["note"]) is None
    assert last_rows(wide.withColumn("z", F.col("x")), "vin", ["x", "y", "z", "n"]).first().n == 3
    assert last_rows(df.limit(0), "vin", order).count() == 0
