"""Field normalisation per platform, on invented records that pin one rule each."""

import pytest

from lotline.operators.platforms import DEALERCOM, ROADSTER
from tests.conftest import normalize_one

PAGE = "https://express.dealer-t.example.com/inventory"

ROADSTER_COMPLETE = {
    "vin": "TESTVIN0000000001", "year": 2021, "make": "BMW", "model": "X6", "trim": "sport40",
    "title": "2021 BMW X6 sport40", "price": 41250, "calc_msrp": 43900,
    "exterior_color": {"id": "harbour-grey", "label": "Harbour Grey"},
    "interior_color": {"id": "felt", "label": "Dark Felt"},
    "mileage": 3077, "url": "/inventory/vehicle/TESTVIN0000000001", "options": ["P1", "P2"],
}


def test_roadster_complete(spark):
    r = normalize_one(spark, ROADSTER, ROADSTER_COMPLETE, source_url=PAGE)
    assert r["vin"] == "TESTVIN0000000001"
    assert r["price"] == 41250.0 and r["msrp"] == 43900.0
    assert r["ext_color"] == "Harbour Grey" and r["int_color"] == "Dark Felt"
    assert r["odometer"] == 3077 and r["dealer_platform"] == "Roadster"
    assert r["title"] == "2021 BMW X6 sport40"
    assert r["reject_reason"] is None


def test_roadster_minimal_builds_title(spark):
    r = normalize_one(spark, ROADSTER, {"vin": "V1", "year": 2024, "model": "X2"})
    assert r["title"] == "2024 BMW X2"
    assert r["price"] is None and r["ext_color"] is None and r["odometer"] is None


def test_roadster_string_colour_and_mileage(spark):
    r = normalize_one(spark, ROADSTER, {"vin": "V1", "exterior_color": "Lagoon Green", "mileage": "820 miles"})
    assert r["ext_color"] == "Lagoon Green" and r["odometer"] == 820


def test_roadster_colour_id_fallback_and_empty_object(spark):
    assert normalize_one(spark, ROADSTER, {"vin": "V", "exterior_color": {"id": "chalk"}})["ext_color"] \
        == "chalk"
    assert normalize_one(spark, ROADSTER, {"vin": "V", "exterior_color": {}})["ext_color"] is None


def test_roadster_zero_mileage_is_null(spark):
    assert normalize_one(spark, ROADSTER, {"vin": "V", "mileage": 0})["odometer"] is None


def test_roadster_urls(spark):
    page = "https://express.dealer-t.example.com/inventory"
    absolute = normalize_one(spark, ROADSTER, {"vin": "V", "url": "https://other.example.org/vehicle/UNIT42"},
                             source_url=page)
    assert absolute["source_url"] == page
    rel = normalize_one(spark, ROADSTER, {"vin": "V", "url": "/inventory/vehicle/UNIT42"}, source_url=page)
    assert rel["source_url"] == "https://express.dealer-t.example.com/inventory/vehicle/UNIT42"


def test_roadster_title_from_parts(spark):
    r = normalize_one(spark, ROADSTER, {"vin": "V", "year": 2024, "make": "BMW", "model": "X5", "trim": "night"})
    assert r["title"] == "2024 BMW X5 night"


def test_roadster_unicode_preserved(spark):
    r = normalize_one(spark, ROADSTER, {"vin": "V", "title": "2022 BMW X6 • Night",
                                        "exterior_color": {"label": "Açaí Purple"}})
    assert r["title"] == "2022 BMW X6 • Night" and r["ext_color"] == "Açaí Purple"


@pytest.mark.parametrize("rec,reason", [
    ({"year": 2024}, "no_vin"), ({"vin": ""}, "no_vin"), ({"vin": "V", "mileage": {"v": 1}}, "bad_odometer"),
])
def test_roadster_rejects(spark, rec, reason):
    assert normalize_one(spark, ROADSTER, rec)["reject_reason"] == reason


def test_roadster_options_json(spark):
    import json
    r = normalize_one(spark, ROADSTER, {"vin": "V", "options": ["P1", "P2"]})
    assert json.loads(r["options"]) == ["P1", "P2"]


DC_COMPLETE = {
    "vin": "TESTVIN0000000002", "year": 2020, "make": "BMW", "model": "X7", "trim": "night",
    "vehicleTitle": "2020 BMW X7 night", "price": 51300, "msrp": 55800, "extColor": "Slate",
    "intColor": "Sand", "odometer": 4410, "options": {"bundle": "Winter"},
}


def test_dealercom_complete(spark):
    r = normalize_one(spark, DEALERCOM, DC_COMPLETE)
    assert (r["price"], r["msrp"], r["odometer"], r["year"]) == (51300.0, 55800.0, 4410, 2020)
    assert r["dealer_platform"] == "Dealer.com" and r["title"] == "2020 BMW X7 night"


def test_dealercom_alternate_keys(spark):
    r = normalize_one(spark, DEALERCOM, {"VIN": "V", "Year": "2024", "Make": "BMW", "Model": "X3",
                                         "sellingPrice": "$48,250", "MSRP": "51,900"})
    assert (r["year"], r["price"], r["msrp"]) == (2024, 48250.0, 51900.0)


def test_dealercom_minimal_title_words(spark):
    r = normalize_one(spark, DEALERCOM, {"vin": "V", "year": "2024", "model": "730d", "internetPrice": 47500.0})
    assert r["price"] == 47500.0 and r["msrp"] is None and r["ext_color"] is None
    assert r["title"] == "2024 BMW 730d None"


@pytest.mark.parametrize("year,expected", [(2024, 2024), ("2024", 2024), ("unknown", None), (1979, None),
                                           (2031, None)])
def test_dealercom_year(spark, year, expected):
    assert normalize_one(spark, DEALERCOM, {"vin": "V", "year": year})["year"] == expected


@pytest.mark.parametrize("rec,expected", [
    ({"odometer": 6100}, 6100), ({"mileage": "23,456"}, 23456), ({"miles": 7200}, 7200),
    ({"odometer": "unknown"}, None), ({}, None), ({"odometer": "987.5"}, None), ({"odometer": 987.7}, 987),
])
def test_dealercom_odometer(spark, rec, expected):
    assert normalize_one(spark, DEALERCOM, {"vin": "V", **rec})["odometer"] == expected


def test_dealercom_zero_price_kept_and_next_key_on_failure(spark):
    assert normalize_one(spark, DEALERCOM, {"vin": "V", "price": 0})["price"] == 0.0
    assert normalize_one(spark, DEALERCOM, {"vin": "V", "price": "Call", "sellingPrice": "$9"})["price"] == 9.0


def test_dealercom_empty_strings(spark):
    r = normalize_one(spark, DEALERCOM, {"vin": "V", "model": "", "extColor": ""})
    assert r["model"] == "" and r["ext_color"] is None


def test_dealercom_list_valued_model_and_long_vin(spark):
    r = normalize_one(spark, DEALERCOM, {"vin": "LONGVIN00000000000000X", "model": ["X5", "", "M"]})
    assert r["model"] == "X5 M" and r["vin"] == "LONGVIN00000000000000X"


def test_dealercom_options_object_or_array(spark):
    import json
    for opts in ({"bundle": "Winter"}, ["P1", "P2"]):
        r = normalize_one(spark, DEALERCOM, {"vin": "V", "options": opts})
        assert json.loads(r["options"]) == opts


def test_dealercom_non_object_record_rejected(spark):
    assert normalize_one(spark, DEALERCOM, "just text")["reject_reason"] == "not_object"


def test_roadster_make_present_null_gives_no_title(spark):
    r = normalize_one(spark, ROADSTER, {"vin": "V", "year": 2024, "make": None, "model": "X5"})
    assert r["title"] is None


def test_roadster_dealer_starting_price_zero_is_last_operand(spark):
    assert normalize_one(spark, ROADSTER, {"vin": "V", "dealer_starting_price": 0})["price"] == 0.0
    assert normalize_one(spark, ROADSTER, {"vin": "V", "price": 0})["price"] is None
