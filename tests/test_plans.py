"""Plan properties the scale design relies on, asserted on physical plans."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_listing_filters_reach_the_scan(spark):
    p = _plan(E.queries()["filter_combined"](spark, SF))
    assert "PushedFilters: [IsNotNull(model), IsNotNull(price), EqualTo(model,X5)" in p
    assert "Window" not in p


def test_top_k_is_take_ordered(spark):
    p = _plan(E.queries()["top_price"](spark, SF))
    assert "TakeOrderedAndProject(limit=100" in p and "Exchange" not in p


def test_model_request_prunes_captures_before_they_are_parsed(spark):
    p = _plan(E.queries()["capture_pruned"](spark, SF))
    scans = [ln for ln in p.split("\n") if "FileScan" in ln]
    assert len(scans) == 2 and all("PartitionFilters: [isnotnull(req_model" in ln and "req_year" in ln for ln in scans)


def test_pages_of_a_dealer_are_dealt_out_after_the_join(spark):
    from lotline.plans import derived
    from lotline.sources.captures import build_captures
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = _plan(build_captures(derived.obs(spark, SF)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert p.index("ObjectHashAggregate") < p.index("Exchange hashpartitioning(dealer_key") < p.index("SortMergeJoin")
    assert "page_no" in p[p.index("Exchange hashpartitioning(dealer_key"):].split("\n")[0]
    assert p.count("lineitem.parquet") == 2  # the sightings and their count per dealer


def test_last_write_is_a_partial_aggregate_not_a_window(spark):
    p = _plan(E.queries()["dedup_vin"](spark, SF))
    assert "Window" not in p and "partial_max_by" in p


def test_merge_does_not_shuffle_the_stored_table(spark):
    p = _plan(E.queries()["upsert_vehicles"](spark, SF))
    assert any("SelectedBucketsCount" in ln for ln in p.split("\n"))
    assert p.count("Exchange hashpartitioning(vin") == 1  # the items, once
    # the stored side of the full outer join reads the bucketed table directly
    smj = p[p.index("SortMergeJoin"):]
    last_child = smj[smj.rindex("+-"):]
    assert "Exchange" not in last_child.split("FileScan")[0]


def test_normalisation_has_no_exchange_and_parses_once(spark):
    p = _plan(E.queries()["normalize_dealercom"](spark, SF))
    assert "Exchange" not in p
    assert p.count("parseJson(payload") == 1


def test_ingest_merges_into_the_stored_buckets(spark, tmp_path):
    from lotline import api
    from lotline.operators.upsert import merge
    from lotline.plans import inputs
    store = api.VehicleStore(spark, str(tmp_path / "v"))
    store.write(inputs.vehicles(spark, SF))
    items = inputs.vehicles(spark, SF).select("vin", "dealer", "title", "dealer_platform", "source_url", "price", "updated_at")
    table, _ = merge(store.read(), items, "2026-01-01 00:00:00", seq=["updated_at"])
    p = _plan(table)
    assert "SelectedBucketsCount" in p and p.count("Exchange hashpartitioning(vin") == 1


def test_generated_code_of_normalisation_compiles():
    """No stage of the normalisers is thrown away for the length of its code (Spark logs that, and goes on without)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = ("import sys; sys.path.insert(0, sys.argv[1])\nimport __spark_entry__ as E\n"
            "from lotline.session import get_spark\nspark = get_spark('local[2]', 4)\n"
            "for k in ('normalize_dealercom', 'normalize_roadster', 'ingest_all_platforms', 'rejects_by_reason', 'price_roadster'):\n"
            "    E.queries()[k](spark, sys.argv[2]).write.format('noop').mode('overwrite').save()\nprint('ran all')\n")
    out = subprocess.run([sys.executable, "-c", code, root, SF], capture_output=True, text=True, timeout=600)
    assert "ran all" in out.stdout, out.stderr[-2000:]
    assert "64 KB" not in out.stdout + out.stderr and "CodeGenerator" not in out.stderr
