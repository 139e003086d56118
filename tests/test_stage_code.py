"""What the stages over captures and records compute per row."""

import re

from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, VariantType

from lotline.functions import variant as V
from lotline.operators import normalize as N
from lotline.operators.platforms import DEALERCOM, ROADSTER
from lotline.sources import captures as C


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_generator_holds_the_reject_reason_only(spark):
    """All columns of a stage in one generator made a method too long for the JVM to compile."""
    rec = ('{"vin":"V1","year":2020,"model":"X5","trim":"","price":"$1,000","sellingPrice":5,"mileage":"7"}', '{"VIN":"","price":1}', '"broken"', '{"vin":["a"]}')
    recs = spark.createDataFrame([(r,) for r in rec], "j string").select(
        F.lit("D").alias("dealer"), F.lit("https://d.example.com/x").alias("source_url"), F.parse_json("j").alias("rec"))
    for spec in (DEALERCOM, ROADSTER):
        out = N.normalize_records(spec, recs).where("reject_reason IS NULL")
        generators = [x for x in _plan(out).splitlines() if "Generate inline" in x]
        assert len(generators) == 1 and "reject_reason" in generators[0]
        filters = [x for x in _plan(out).splitlines() if re.search(r"\bFilter\b", x)]
        assert len(filters) == 1 and "variant" not in filters[0]     # not pushed below the stages
    items = N.normalize_records(DEALERCOM, recs).collect()
    assert [r["reject_reason"] for r in items] == [None, "no_vin", "not_object", "bad_vin"]
    assert (items[0]["price"], items[0]["year"], items[0]["odometer"], items[0]["title"]) == (1000.0, 2020, 7, "2020 BMW X5 None")


def test_members_are_counted_whatever_they_are(spark):
    rows = ['[{"a":1,"b":[2]},"yes","x",1,1.5,true,null,[],{}]', "[]", '{"a":1}', '"t"', "null", None]
    df = spark.createDataFrame([(r,) for r in rows], "j string").select(F.parse_json("j").alias("v"))
    size = df.select(V.size_at(F.col("v"), "").alias("n"))
    assert [r["n"] for r in size.collect()] == [9, 0, None, None, None, None]
    assert "StructType" not in size._jdf.queryExecution().analyzed().toString()     # no member's fields are read


def test_text_keys_of_captured_records_are_plain_strings(spark):
    names = ("vin", "model", "trim", "title", "ext_color", "int_color", "options")
    row = spark.range(1).select(*[F.lit('["q"]' if c == "options" else 'a "b"\\é\n').alias(c) for c in names],
                                F.lit(5.5).alias("price"), F.lit(7.0).alias("msrp"), F.lit(3).alias("odometer"), F.lit(2020).alias("year"))
    for m in range(0, 60, 7):
        for record in (C._dealercom_record, C._roadster_record):
            rec = row.select(record(F.lit(m).cast("bigint")).alias("r"))
            kinds = {f.name: f.dataType.simpleString() for f in rec.schema["r"].dataType}
            assert {k for k, t in kinds.items() if t == "string"} >= {"vin", "VIN", "make", "trim", "series", "title"}
            # the text is what it is with variants in their place
            as_variants = rec.select(F.col("r").cast(StructType([StructField(k, VariantType()) for k in kinds])).alias("r"))
            for options in ({}, {"ignoreNullFields": "false"}):
                assert rec.select(F.to_json("r", options)).first() == as_variants.select(F.to_json("r", options)).first()
