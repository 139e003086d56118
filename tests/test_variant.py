"""Dynamic truthiness and number coercion over VARIANT values."""

import json

import pytest
from pyspark.sql import functions as F

from lotline.functions import variant as V

TRUTHY_CASES = [
    (None, False), ("", False), (0, False), (0.0, False), (-0.0, False), (False, False),
    ([], False), ({}, False), ("0", True), ("false", True), (" ", True), ([0], True),
    ({"a": None}, True), (1, True), ("x", True), (True, True),
]


def _eval(spark, values, fn):
    rows = [(i, json.dumps(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, j string").select("i", F.parse_json("j").alias("v"))
    out = df.select("i", fn(F.col("v")).alias("r")).orderBy("i").collect()
    return [r.r for r in out]


def test_truthy_matches_dynamic_semantics(spark):
    got = _eval(spark, [v for v, _ in TRUTHY_CASES], V.truthy)
    assert got == [t for _, t in TRUTHY_CASES]


def test_truthy_of_missing_value_is_false(spark):
    df = spark.createDataFrame([('{"a": 1}',)], "j string").select(F.parse_json("j").alias("v"))
    assert df.select(V.truthy(V.get(F.col("v"), "missing")).alias("t")).first().t is False


def test_first_truthy_returns_last_operand_when_all_falsy(spark):
    df = spark.createDataFrame([('{"a": "", "b": 0}',)], "j string").select(F.parse_json("j").alias("v"))
    r = df.select(V.as_text(V.first_truthy(V.get(F.col("v"), "a"), V.get(F.col("v"), "b"))).alias("r")).first().r
    assert r == "0"


@pytest.mark.parametrize("value,expected", [
    (50000, 50000.0), (50000.99, 50000.99), ("$45,999.00", 45999.0), ("62000", 62000.0), (None, None),
    ("N/A", None), ({"value": 75000}, None), ({"amount": 80000}, None), ({"invalid_key": 50000}, None),
    ("Call for price: $55,000", 55000.0), ("1.2.3", None), (".", None), ({"value": "$1,250"}, 1250.0),
    (True, 1.0),
])
def test_polymorphic_price(spark, value, expected):
    assert _eval(spark, [value], V.polymorphic_price) == [expected]


@pytest.mark.parametrize("value,expected", [
    ("12", 12.0), (" 12 ", 12.0), ("12d", None), ("1e3", 1000.0), ("abc", None), ({"a": 1}, None), (True, 1.0),
])
def test_to_double_is_strict(spark, value, expected):
    assert _eval(spark, [value], lambda v: V.to_double(v)) == [expected]


@pytest.mark.parametrize("value,expected", [
    (1234.7, 1234), (-3.5, -3), ("1234.5", None), ("12,345", None), ("7", 7), (False, 0),
])
def test_to_long_truncates_numbers_and_parses_integers(spark, value, expected):
    assert _eval(spark, [value], lambda v: V.to_long(v)) == [expected]


def test_join_truthy_members(spark):
    assert _eval(spark, [["X5", "", "M"]], V.text_or_joined) == ["X5 M"]
