"""Title parsing and URL builders."""

import pytest
from pyspark.sql import functions as F

from lotline.functions import urls as U
from lotline.functions.titles import parse_title

TITLES = [
    ("2019 BMW X2 sport20", 2019, "BMW", "X2", "sport20"),
    ("2026 BMW iX xDrive50", 2026, "BMW", "X3", "iX xDrive50"),
    ("2018 BMW M8 Night Wagon", 2018, "BMW", "M8", "Night Wagon"),
    ("2023 BMW 3 Series 330i", 2023, "BMW", "X3", "3 Series 330i"),
    ("2026 BMW iX M60", 2026, "BMW", "M60", "iX"),
    ("2024 BMW Sport X5", 2024, "BMW", "Sport X5", None),
    ("2024 bmw X1", 2024, "bmw", "X1", None),
    ("", None, "BMW", "X3", None),
    (None, None, "BMW", "X3", None),
    ("2023 Mercedes-Benz C300", 2023, "Mercedes-Benz", "Benz C300", "Mercedes-"),
]


def test_parse_title(spark):
    df = spark.createDataFrame([(i, t[0]) for i, t in enumerate(TITLES)], "i int, t string")
    out = df.select("i", parse_title(F.col("t")).alias("p")).orderBy("i").collect()
    got = [(r.p.year, r.p.make, r.p.model, r.p.trim) for r in out]
    # The trim rule removes only a 'BMW' word, so other makes stay in the trim.
    assert got == [t[1:] for t in TITLES]


URLS = [
    ("dealercom", "https://www.dealer-a.example.com/new-inventory/index.htm", "iX", "2026",
     "https://www.dealer-a.example.com/new-inventory/index.htm?year=2026&model=iX&status=1-1"),
    ("dealercom", "https://d.com/new-inventory/index.htm", "iX", None,
     "https://d.com/new-inventory/index.htm?year=2026&model=iX&status=1-1"),
    ("dealercom", "https://d.com/index.htm?old=1#frag", None, None, "https://d.com/index.htm?status=1-1#frag"),
    ("dealercom", "https://d.com/i.htm", None, "2024", "https://d.com/i.htm?status=1-1"),
    ("dealercom", "https://d.com/i.htm", "3 Series", None, "https://d.com/i.htm?year=2026&model=3+Series&status=1-1"),
    ("roadster", "https://express.dealer-b.example.com/inventory", "iX", "2026",
     "https://express.dealer-b.example.com/inventory?f=submodel%3AiX&f=year%3A2026"),
    ("roadster", "https://express.dealer-b.example.com/inventory?x=1", None, None, "https://express.dealer-b.example.com/inventory?x=1"),
]


def test_filtered_urls(spark):
    df = spark.createDataFrame([(i, *u[:4]) for i, u in enumerate(URLS)],
                               "i int, p string, base string, model string, year string")
    url = F.when(F.col("p") == "roadster", U.roadster_filtered_url(F.col("base"), F.col("model"), F.col("year"))) \
           .otherwise(U.dealercom_filtered_url(F.col("base"), F.col("model"), F.col("year")))
    got = [r.u for r in df.select("i", url.alias("u")).orderBy("i").collect()]
    assert got == [u[4] for u in URLS]


@pytest.mark.parametrize("url,domain", [
    ("https://www.dealer-a.example.com/new-inventory/index.htm", "dealer-a.example.com"),
    ("http://express.dealer-b.example.com/inventory", "express.dealer-b.example.com"), ("ftp://x.com", None),
])
def test_domain(spark, url, domain):
    assert spark.createDataFrame([(url,)], "u string").select(U.domain(F.col("u")).alias("d")).first().d == domain


@pytest.mark.parametrize("base,ref,want", [
    ("https://a.com/inv/list?p=1", "/v/1", "https://a.com/v/1"),
    ("https://a.com/inv/list?p=1", "v/1", "https://a.com/inv/v/1"),
    ("https://a.com/inv/list", "../v/1", "https://a.com/v/1"),
    ("https://a.com/inv/list", "//cdn.com/x", "https://cdn.com/x"),
    ("https://a.com/inv/list?p=1", "?p=2", "https://a.com/inv/list?p=2"),
    ("https://a.com/inv/list?p=1#x", "#y", "https://a.com/inv/list?p=1#y"),
])
def test_resolve_url(spark, base, ref, want):
    df = spark.createDataFrame([(base, ref)], "b string, r string")
    assert df.select(U.resolve_url(F.col("b"), F.col("r")).alias("u")).first().u == want
