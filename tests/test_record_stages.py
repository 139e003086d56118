"""A record is read once, by code that the JVM compiles, and stored without a shredded copy."""

import json
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from lotline.functions import variant as V
from lotline.operators import extract as X
from lotline.operators import normalize as N
from lotline.operators.platforms import DEALERCOM, ROADSTER
from lotline.sources.custom_platform import CARLOT

VALUES = [None, "", "0", "false", " ", "x", 0, 5, -3, 2 ** 53, 0.0, -0.0, 1.5, 1e30, False, True, [], [None], [0], ["a", ""], {}, {"a": None}]


def _values(spark):
    rows = [(i, json.dumps(v)) for i, v in enumerate(VALUES)] + [(len(VALUES), None)]
    return spark.createDataFrame(rows, "i int, j string").select("i", F.parse_json("j").alias("v"))


def test_text_and_number_of_a_value_give_what_the_value_gives(spark):
    v = F.col("v")
    df = _values(spark).select("i", "v", F.schema_of_variant(v).alias("t"), V.json_string(v).alias("s"), V.number(v).alias("d"))
    t, s, d = F.when(F.col("s").isNull(), F.col("t")), F.col("s"), F.col("d")
    only = F.when(s.isNull(), v)
    out = df.select("i", "s", V.string(v).alias("want"),
                    *[F.struct(a.alias("want"), b.alias("got")).alias(n) for n, a, b in (
                        ("truthy", V.truthy(v), V.truthy(only, t, s, d)), ("text", V.as_text(v), V.as_text(only, t, s)),
                        ("double", V.to_double(v, "$,"), V.to_double(only, "$,", t, s, d)), ("long", V.to_long(v, ","), V.to_long(only, ",", t, s, d)),
                        ("price", V.polymorphic_price(v), V.polymorphic_price(only, t, s, d)), ("joined", V.text_or_joined(v), V.text_or_joined(only, t, s)))])
    for r in out.collect():
        assert r["s"] == r["want"] and all(r[n]["want"] == r[n]["got"] for n in ("truthy", "text", "double", "long", "price", "joined")), r


def test_keys_are_read_in_one_pass(spark):
    rows = ['{"vin":"a","VIN":1,"x y":null}', '{"VIN":[2]}', '"text"', "null", "[1]", None]
    df = spark.createDataFrame([(r,) for r in rows], "j string").select(F.parse_json("j").alias("rec"))
    keys = ["vin", "VIN", "x y"]
    got = df.select(V.fields(F.col("rec"), keys).alias("k")).select(
        F.col("k").isNotNull(), *[F.to_json(F.col(f"k._{i}")) for i in range(3)], V.present(F.col("k._2"))).collect()
    assert [tuple(r) for r in got] == [(True, '"a"', "1", "null", False), (True, None, "[2]", None, False)] + [(False, None, None, None, False)] * 4
    recs = df.select(F.lit("D").alias("dealer"), F.lit("u").alias("source_url"), "rec")
    for spec in (DEALERCOM, ROADSTER, CARLOT):
        plan = N.normalize_records(spec, recs)._jdf.queryExecution().analyzed().toString()
        assert plan.count("try_variant_get(rec#") == 1


def _longest_method(spark, df) -> int:
    debug = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$")
    stages = debug.codegenStringSeq(df._jdf.queryExecution().executedPlan())
    return max((stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())), default=0)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="driver test data not present")
def test_methods_are_short_enough_to_be_compiled(spark):
    """The JVM interprets a method of more than 8,000 bytes, for each record."""
    for name in ("normalize_records", "normalize_dealercom", "normalize_roadster", "title_dealercom", "first_truthy"):
        assert 0 < _longest_method(spark, E.queries()[name](spark, "/root/testdata/sf0.001")) <= 8000, name


def test_the_whole_record_is_not_shredded_again(spark, tmp_path):
    import pyarrow.parquet as pq
    page = json.dumps({"inventory": [{"vin": f"V{i}", "price": i} for i in range(50)] + ["broken"]})
    caps = spark.createDataFrame([("D", "dealercom", 0, "u", None, page)],
                                 "dealer string, platform string, page_no long, source_url string, captured_at string, payload string")
    X.shredded_records(DEALERCOM, caps, N.spec_keys(DEALERCOM)).coalesce(1).write.parquet(str(tmp_path / "r"))
    file, = (tmp_path / "r").glob("*.parquet")
    columns = [c.path for c in pq.ParquetFile(file).schema]
    assert any(c.startswith("k_vin.typed_value") for c in columns)
    assert any(c.startswith("rec.") for c in columns) and not any("typed_value" in c for c in columns if c.startswith("rec."))
    stored = spark.read.parquet(str(tmp_path / "r"))
    assert stored.where("rec IS NULL").count() == 1
    less = stored.drop(X.key_column("price"))
    assert N.normalize_records(DEALERCOM, less).agg(F.sum("price")).first()[0] == sum(range(50))
