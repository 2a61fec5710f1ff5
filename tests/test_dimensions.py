"""Dimensions held in tables: terms in texts, and values in bands, against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from leadweave.operators.bands import first_band, winners
from leadweave.operators.terms import first_card_of_companies, first_term, found_terms

TEXTS = ["a CEO of it", "ceo", "the c.e.o. (x)", "plant head, acme", "plant  head", "headplant", "é été", "", None, "x" * 5000 + " ceo", "a*b a\\Eb", "naïve c++ dev", "++"]
TERMS = ["ceo", "plant head", "head", "plant", "été", "é", "c.e.o", "x", "*", "a\\Eb", "c++", "++", "", None, "zzz", "ac", "ev"]


@pytest.mark.parametrize("whole", [True, False])
def test_found_terms(spark, whole):
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("ab c") for _ in range(rng.randrange(1, 14))) for _ in range(60)]
    terms = TERMS + ["".join(rng.choice("ab c") for _ in range(rng.randrange(1, 5))).strip() for _ in range(40)]
    found = found_terms(spark.createDataFrame([(t, "clash") for t in texts * 2], "text string, piece string"), spark.createDataFrame([(t,) for t in terms], "term string"), whole_words=whole)
    want = {(x, t) for x in texts if x is not None for t in terms if t and (re.search(rf"\b{re.escape(t)}\b", x) if whole else t in x)}
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)


def test_no_terms_and_no_texts(spark):
    texts, terms = spark.createDataFrame([("a",)], "text string"), spark.createDataFrame([], "term string")
    for whole in (True, False):
        assert found_terms(texts, terms, whole_words=whole).count() == 0
        assert found_terms(texts.limit(0), texts.withColumnRenamed("text", "term"), whole_words=whole).count() == 0


def test_first_term(spark):
    rows = spark.createDataFrame([(1, "Our CEO, plant head"), (2, "none"), (3, None), (1, "Our CEO, plant head")], "id long, text string")
    terms = spark.createDataFrame([(7, "ceo", "C"), (3, "Plant Head", "P"), (9, "none", "N"), (2, "ceo", "C2")], "ord long, term string, label string")
    assert sorted((r["id"], r["label"]) for r in first_term(rows, terms, "text", ["label"]).collect()) == [(1, "C2"), (1, "C2"), (2, "N"), (3, None)]


def test_cards_without_company_names(spark):
    companies = spark.createDataFrame([("Acme Pumps Pvt Ltd",), ("Zed Co",), ("A B",), (None,), ("Nobody Here",)], "company_name string")
    cards = spark.createDataFrame([(3, "at the PUMPShop"), (2, None), (5, "zed"), (4, "old acme")], "rank long, text string")
    assert {r["name"]: r["card"]["rank"] for r in first_card_of_companies(companies, cards).collect()} == {"Acme Pumps Pvt Ltd": 3, "Zed Co": 5, "A B": 3}
    assert first_card_of_companies(companies, cards.limit(0)).count() == 0


def test_first_band(spark):
    rng = random.Random(2)
    bands = [(i, f"b{i}", rng.choice([None, float(rng.randrange(50))]) if i % 9 == 0 else float(rng.randrange(90)), None if i % 13 == 0 else float(rng.randrange(100))) for i in range(1, 70)]
    values = [rng.choice([None, float("nan"), -5.0, 0.0, 99.5, 1e9, *(rng.randrange(1000) / 10 for _ in range(20))]) for _ in range(400)] + [42.0] * 300
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, x double")
    got = first_band(rows, spark.createDataFrame(bands, "ord long, band string, low double, high double"), "x").collect()

    def band(v):
        return next((b for _, b, low, high in bands if v is not None and v == v and (low is None or v >= low) and (high is None or v < high)), None)

    assert sorted((r["id"], r["band"] or "") for r in got) == [(i, band(v) or "") for i, v in enumerate(values)]


def test_nested_bands_stay_few(spark):
    """500 bands within one another: rows on the way are bands times the logarithm, not their square."""
    bands = spark.range(500).select(F.col("id").alias("ord"), F.concat(F.lit("b"), "id").alias("band"), (F.col("id") * 1.0).alias("low"), (2000.0 - F.col("id")).alias("high"))
    won = {r["edge"]: r["band"] for r in winners(bands).collect()}
    assert len(won) == 1000 and won[0.0] == won[499.0] == won[1501.0] == "b0" and won[2000.0] is None


def test_no_bands_or_values(spark):
    rows, bands = spark.createDataFrame([(1, 2.0)], "id long, x double"), spark.createDataFrame([], "ord long, band string, low double, high double")
    assert [r["band"] for r in first_band(rows, bands, "x").collect()] == [None]
    assert first_band(rows.limit(0), bands, "x").count() == 0
