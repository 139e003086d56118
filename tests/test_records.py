"""Stored records: shredded on disk, read key by key, split from their rejects in one pass."""

import json
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from lotline.operators import extract as X
from lotline.operators import normalize as N
from lotline.operators.platforms import DEALERCOM, PLATFORMS, ROADSTER

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def _captures(spark, records, platform="dealercom"):
    page = {"inventory": records} if platform == "dealercom" else {"vehicles": records}
    return spark.createDataFrame([("D", platform, 0, "https://d.example.com/new/", None, json.dumps(page))],
                                 "dealer string, platform string, page_no long, source_url string, captured_at string, payload string")


RECORDS = [{"vin": "A1", "price": "$1,500", "MSRP": 7, "msrp": None}, {"VIN": "B2", "price": None, "sellingPrice": 0},
           "text", None, 5, [1], {"price": 3}, {"vin": ["x"], "price": 1}, {}, {"vin": "C3", "Price": 9, "internetPrice": {"a": 1}}]


@pytest.mark.parametrize("spec", [DEALERCOM, ROADSTER])
def test_stored_records_give_the_items_of_the_pages(spark, tmp_path, spec):
    caps = _captures(spark, RECORDS * 3, spec.name)
    X.shredded_records(spec, caps, N.spec_keys(spec)).write.parquet(str(tmp_path / "r"))
    stored = spark.read.parquet(str(tmp_path / "r"))
    want = N.normalize_records(spec, X.extract(spec, caps, ("dealer", "page_no", "source_url", "captured_at")))
    got = N.normalize_records(spec, stored)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    # a key without a column of its own is looked up in the record
    less = stored.drop(X.key_column("price"), X.key_column("VIN"))
    assert sorted(map(str, N.normalize_records(spec, less).collect())) == sorted(map(str, want.collect()))
    one = N.normalize_records(spec, stored, ("msrp", "price"))
    assert sorted(map(str, one.select("pos", "price", "msrp", "reject_reason").collect())) == sorted(
        map(str, want.select("pos", "price", "msrp", "reject_reason").collect()))
    kinds = {r.pos: r.kind for r in stored.collect()}
    assert [kinds[i] for i in range(7)] == ["OBJECT", "OBJECT", "STRING", "VOID", "BIGINT", "ARRAY", "OBJECT"]


def _scan(df):
    return [ln for ln in df._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in ln]


def _read(df):
    """Columns that each scan of a plan reads."""
    leaves = df._jdf.queryExecution().sparkPlan().collectLeaves()
    return [{f["name"] for f in json.loads(leaves.apply(i).schema().json())["fields"]} for i in range(leaves.size())]


def test_a_price_query_reads_price_keys(spark):
    """Three price keys and two for the VIN, each a column of its own; no page is parsed."""
    df = E.queries()["price_dealercom"](spark, SF)
    assert "parse" not in df._jdf.queryExecution().executedPlan().toString().lower().replace("parquet", "")
    assert _read(df) == [{"dealer", "page_no", "pos", "kind", "platform", "k_price", "k_selling-price", "k_internet-price", "k_vin", "k_-v-i-n"}]
    # all fields: every key of each platform
    for spec, columns in zip((DEALERCOM, ROADSTER), _read(E.queries()["normalize_records"](spark, SF))):
        assert {c for c in columns if c.startswith("k_")} == {X.key_column(k) for k in N.spec_keys(spec)} and "rec" not in columns


def test_a_price_query_reads_fewer_bytes(spark):
    """Of the stored files the compressed columns of the price keys are a small part."""
    import pyarrow.parquet as pq
    from lotline.plans import inputs
    files = [f.replace("file://", "") for f in inputs.records(spark, SF).inputFiles() if "platform=dealercom" in f]
    sizes = {}
    for f in files:
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                col = meta.row_group(g).column(c)
                name = col.path_in_schema.split(".")[0]
                sizes[name] = sizes.get(name, 0) + col.total_compressed_size
    price = sum(sizes[c] for c in ("k_price", "k_selling-price", "k_internet-price", "k_vin", "k_-v-i-n", "pos", "dealer", "page_no", "kind"))
    assert price < 0.35 * (sum(sizes.values()) - sizes["rec"])
    assert "typed_value" in str(pq.ParquetFile(files[0]).schema)


def test_keys_that_differ_by_case():
    keys = {k for s in PLATFORMS.values() for k in N.spec_keys(s)}
    names = [X.key_column(k).lower() for k in keys]
    assert len(names) == len(set(names)) and X.key_column("VIN") != X.key_column("vin")


def test_split_is_one_pass_with_counts(spark, tmp_path):
    caps = _captures(spark, RECORDS)
    recs = X.shredded_records(DEALERCOM, caps, N.spec_keys(DEALERCOM)).withColumn("platform", F.lit("dealercom"))
    recs.write.partitionBy("platform").parquet(str(tmp_path / "r"))
    recs = spark.read.parquet(str(tmp_path / "r"))
    seen = N.split_items(PLATFORMS.values(), recs, str(tmp_path / "out"))
    assert seen == {"records": 10, "rejected": 7}
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.vin for r in out.where("reject_reason IS NULL").collect()) == ["A1", "B2", "C3"]
    counts = {r.reject_reason: r["count"] for r in out.where("reject_reason IS NOT NULL").groupBy("reject_reason").count().collect()}
    assert counts == {"not_object": 4, "no_vin": 2, "bad_vin": 1}
    # rejects alone do not read the accepted folder
    p = _scan(out.where("reject_reason = 'no_vin'"))[0]
    assert "PartitionFilters: [isnotnull(reject_reason" in p
