"""The pages are built of narrow rows: shuffled once, in partitions that follow the number of pages."""

import json

from lotline.operators import normalize as N
from lotline.operators.platforms import DEALERCOM, ROADSTER
from lotline.plans import derived, inputs
from lotline.sources import captures as C


def _obs(spark, n=400):
    """Sightings of five dealers, one of them with most rows; some values null, one row twice."""
    d = spark.range(n).selectExpr(
        "concat('V', id) AS vin", "id", "concat('D', IF(id % 8 < 4, 0, id % 8)) AS dealer", "IF(id % 8 < 4, 0, id % 8) AS dealer_key",
        "IF(id % 8 = 5, 'Roadster', 'Dealer.com') AS dealer_platform", "cast(1990 + id % 50 AS int) AS year", "'BMW' AS make", "'3 Series' AS model",
        "'SPORT' AS trim", "concat('t', id) AS title", "IF(id % 11 = 0, NULL, id * 1.5D) AS price", "id * 2.5D AS msrp", "cast(id * 100 AS int) AS odometer",
        "'red' AS ext_color", "IF(id % 3 = 0, NULL, 'tan') AS int_color", "IF(id % 4 = 0, NULL, '[\"a\",\"b\"]') AS options", "'u' AS source_url",
        "timestamp_ntz'2024-01-01' AS scraped_at", "id AS l_orderkey", "cast(1 + id % 7 AS int) AS l_linenumber")
    return d.unionByName(d.where("id = 10"))


def test_json_is_made_behind_the_one_shuffle(spark, monkeypatch):
    monkeypatch.setattr(C, "PAGES_PER_TASK", 2)
    caps = C.build_captures(_obs(spark))
    above, below = caps._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression [dealer_key", 1)
    assert "StructsToJson" in above and "StructsToJson" not in below and "RepartitionByExpression" not in below
    pages = caps.where("capture_kind = 'page'")
    assert caps.rdd.getNumPartitions() >= max(pages.count() // 2 + 1, spark.sparkContext.defaultParallelism)
    # no sighting is lost or doubled, and a page is put together once
    assert pages.count() == pages.select("dealer", "page_no").distinct().count()
    records = [r for p in pages.select("payload").collect() for r in _lists(json.loads(p.payload))]
    assert len(records) == 401


def _lists(x):
    if isinstance(x, list):
        return x
    return [r for v in x.values() for r in _lists(v)] if isinstance(x, dict) else []


def test_records_written_by_platform_give_the_items_of_the_pages(spark, tmp_path, monkeypatch):
    """A platform's folder at a time; both have the columns of all keys."""
    monkeypatch.setattr(derived, "obs", lambda spark, sf: _obs(spark))
    monkeypatch.setattr(inputs, "key", lambda spark, sf: "test-captures-scale")
    stored = inputs.records(spark, str(tmp_path))
    for spec in (DEALERCOM, ROADSTER):
        got = N.normalize_records(spec, stored.where(f"platform = '{spec.name}'"))
        want = N.normalize(spec, inputs.captures(spark, str(tmp_path)), with_rejects=True)
        cols = ["vin", "title", "price", "options", "page_no", "pos", "reject_reason"]
        assert sorted(map(str, got.select(*cols).collect())) == sorted(map(str, want.select(*cols).collect()))
        assert got.count() > 0


def _lineitems(spark, folder):
    """Tables of three dealers; one supplier and one part twice, some keys null or unknown."""
    spark.range(300).selectExpr(
        "id AS l_orderkey", "IF(id = 7, NULL, id % 12) AS l_partkey", "IF(id = 9, NULL, id % 4) AS l_suppkey", "cast(1 + id % 7 AS int) AS l_linenumber",
        "cast(id % 50 AS double) AS l_quantity", "id * 1.5D AS l_extendedprice", "'R' AS l_returnflag",
        "timestamp_ntz'2024-01-01' AS l_shipdate").write.parquet(f"{folder}/lineitem.parquet")
    spark.range(12).selectExpr("IF(id = 11, 10, id) AS p_partkey", "'red tan' AS p_name", "'B' AS p_brand", "'SPORT' AS p_type", "cast(id AS int) AS p_size",
                               "id * 2.5D AS p_retailprice").write.parquet(f"{folder}/part.parquet")
    spark.range(4).selectExpr("IF(id = 3, 2, id) AS s_suppkey", "concat('D', id) AS s_name", "1 AS s_nationkey", "1.0D AS s_acctbal").write.parquet(
        f"{folder}/supplier.parquet")


def test_sightings_are_shuffled_for_the_parts_and_the_pages_only(spark, tmp_path, monkeypatch):
    """Neither the dealers nor their page counts have the wide rows shuffled."""
    _lineitems(spark, str(tmp_path))
    sf = str(tmp_path)
    monkeypatch.setattr(inputs, "key", lambda spark, sf: "test-captures-shuffles")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        counts = inputs.dealer_pages(spark, sf)
        built = C.build_captures(derived.obs(spark, sf), counts=counts)
        plan = built._jdf.queryExecution().executedPlan().toString()
        rows = sorted(map(str, built.collect()))
        monkeypatch.setattr(C, "BROADCAST_GROUPS", 0)
        monkeypatch.setattr(derived, "BROADCAST_SUPPLIERS", 0)
        shuffled = C.build_captures(derived.obs(spark, sf), counts=counts)
        assert "BroadcastHashJoin" not in shuffled._jdf.queryExecution().executedPlan().toString()
        plain = C.build_captures(derived.obs(spark, sf))
        want = sorted(map(str, plain.collect()))
        assert want == sorted(map(str, shuffled.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert plan.count("SortMergeJoin") == 1 and plan.count("BroadcastHashJoin") == 2
    assert plan.count("ReadSchema: struct<l_orderkey") == 1
    assert plan.count("Exchange hashpartitioning(") == 3    # the sightings and the parts by key, the sightings by page
    assert rows == want and len(rows) > 10
