"""Hand-derived cases of the scalar and extraction functions."""

import pytest
from pyspark.sql import functions as F

from leadweave.functions import extract as X
from leadweave.functions import payloads as P
from leadweave.functions import targeting as T
from leadweave.functions import text as S
from leadweave.functions import validation as V
from leadweave.schema import with_company_fields


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("make", "given", "wanted"),
    [
        (T.match_industry, "Valve Manufacturing", "Valve"),
        (T.match_industry, "Manufacturing", "Manufacturing"),
        (T.match_industry, "Manufacturer", None),
        (T.match_industry, None, None),
        (T.designation_exact, "Designation: CEO", "CEO"),
        (T.designation_exact, "Our CEO said", None),
        (T.designation_function, "our md", "C-Level"),
        (T.designation_function, "mdx", None),
        (T.canonical_city, "12 Main Rd, Bangalore", "Bengaluru"),
        (T.canonical_city, "Kovai and Chennai", "Coimbatore"),
        (T.canonical_city, "Saleman", None),
        (T.first_number, "1,200 staff", 1200.0),
        (T.first_number, "50-100", 50.0),
        (T.first_number, "many", None),
        (X.slab_label, "Slab: Rs. 5 Cr. to 25 Cr. FY 2024-2025", "Rs. 5 Cr. to 25 Cr."),
        (X.slab_label, "Not available", None),
        (X.email, "mail a.b@x.example.com.", "a.b@x.example.com."),
        (X.email, None, None),
        (X.phones, "call 4737097684299439 now", ["7684299439"]),
        (X.phones, None, []),
        (X.cin, "x u12345tn2001ptc123456 y", "U12345TN2001PTC123456"),
        (X.gstin, "29ABCDE1234F1ZX 29abcde1234f1zw", "29ABCDE1234F1ZW"),
        (X.gstin, "29ABCDE1234F1ZX", None),
        (X.address_block, "Plot 4, SIDCO Estate\nSome City\nTamil Nadu, 600001", "Plot 4, SIDCO Estate, Tamil Nadu, 600001"),
        (X.address_block, "no pin here", None),
        (X.address_block, "", None),
        (X.is_person_name, "Asha Rao", True),
        (X.is_person_name, "Asha", False),
        (X.is_person_name, "Contact Us", False),
        (S.placeholder_to_null, " N/A ", None),
        (S.placeholder_to_null, "Pump", "Pump"),
        (S.strip, "  x ", "x"),
        (S.word_signs, "Société & Co.", "SociétéCo"),
        (S.host, "www.Acme.example:8080/x", "acme.example:8080"),
        (S.last_ten_digits, "+91 98765-43210", "9876543210"),
        (S.last_ten_digits, "none", None),
    ],
)
def test_scalar(spark, make, given, wanted):
    assert value(spark, make(F.lit(given).cast("string"))) == wanted


@pytest.mark.parametrize("gst", ["29ABCDE1234F1ZW", "33ABCDE1234F1Z7", "27AAAAA0000A1Z2"])
def test_gstin_valid(spark, gst):
    assert value(spark, X.gstin_is_valid(F.lit(gst)))


@pytest.mark.parametrize(("given", "low", "high"), [("12.5 Cr", 12.5, 12.5), ("5 Cr to 25 Cr", 5, 25), ("Above 500 Cr", 500, None), ("Up to 5 Cr", 0, 5), ("n.a.", None, None), ("Rs. 0 to 40 lakhs", 0, 40), (None, None, None)])
def test_turnover_range(spark, given, low, high):
    assert tuple(value(spark, T.turnover_range(F.lit(given).cast("string")))) == (low, high)


@pytest.mark.parametrize(("crore", "band"), [(9.9, None), (10.0, "MSME"), (25.0, "Mid Market"), (100.0, "Enterprise"), (500.0, "MSME"), (None, None)])
def test_turnover_band(spark, crore, band):
    assert value(spark, T.turnover_band(F.lit(crore).cast("double"))) == band


def test_industry_queries(spark):
    assert value(spark, T.industry_queries(F.lit("Valve"))) == ["Valve"]
    assert value(spark, T.industry_queries(F.lit("Bakery"))) == ["Bakery"]
    assert len(value(spark, T.industry_queries(F.lit(None).cast("string")))) == 18


def test_city_filter(spark):
    def fits(city, address, asked):
        return value(spark, T.in_requested_city(F.lit(city).cast("string"), F.lit(address).cast("string"), F.lit(asked)))

    assert fits(None, "x, Hyderabad 500001", "Hyderabad")
    assert fits("Madras", None, "Chennai")
    assert not fits("Madras", None, "Salem")
    assert not fits("Madras", "x", "東京")


def test_company_keys(spark):
    row = spark.createDataFrame([("Acme & Co.", "https://www.Acme.example:8080/x", "+91 98765-43210", "12345"), ("X", "https://www.tradeindia.com/seller", None, None)], "company_name string, website string, phone string, phone_alt string")
    keys = [r["k"] for r in with_company_fields(row).select(V.company_keys().alias("k")).collect()]
    assert keys == [["website:acme.example:8080", "phone:9876543210", "name:acmeco"], ["name:x"]]


def test_validation_rules(spark):
    row = spark.createDataFrame([("Valve", "5 Cr", "50"), ("Pump", "12 Cr", "200"), (None, None, "")], "industry string, turnover string, employee_count string")
    rows = V.validated(row, "Pump").select("validation_status", "validation_notes").collect()
    assert [r[0] for r in rows] == ["rejected", "validated", "unverified"]
    assert [n.split(":")[0] for n in rows[0][1]] == ["rejected"] * 3 and len(rows[2][1]) == 3


@pytest.mark.parametrize(
    ("href", "wanted"),
    [
        ("../team", "https://a.example/x/team"),
        ("./team?q=../z", "https://a.example/x/y/team?q=../z"),
        ("../../../..", "https://a.example/"),
        ("/m/./n/../o", "https://a.example/m/o"),
        ("p/..", "https://a.example/x/y/"),
        (".hidden", "https://a.example/x/y/.hidden"),
        ("//b.example/c", "https://b.example/c"),
        ("?q=1", "https://a.example/x/y/z?q=1"),
    ],
)
def test_absolute_url(spark, href, wanted):
    assert value(spark, X.absolute_url(F.lit("https://a.example/x/y/z?k=v"), F.lit(href))) == wanted


def test_category_split(spark):
    got = value(spark, X.category_and_address(F.array(F.lit("Open · Closes 8 pm"), F.lit("Pump supplier ·  · 42 Main St"))))
    assert tuple(got) == ("Pump supplier", "42 Main St")


def test_nested_texts():
    nested = {"id": "x", "output": [{"choices": [{"message": {"content": [{"type": "text", "text": "inner"}]}}]}]}
    assert P.completion_text(nested) == "inner"
    assert P.completion_text({"status": "IN_QUEUE"}) is None
    assert P.best_jsonld_name(['[{"@type":"Organization","name":"Portal"},{"@type":"LocalBusiness","name":"Acme Pumps"}]']) == "Acme Pumps"
    assert P.contact_near_title("Asha Rao (Managing Director)") == ("Asha Rao", "Managing Director")
    assert P.contact_near_title("CEO - ravi kumar") == ("Ravi Kumar", "CEO")
    assert P.contact_near_title(None) == (None, None)
