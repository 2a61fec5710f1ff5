"""Filling company fields from lookup tables, each asked only for the rows that need it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.extract import is_person_name, matches_company_terms, person_name
from ..functions.targeting import address_components, designation_in_text
from ..functions.text import collapse, first_truthy, is_falsy, last_ten_digits, strip


def gated_lookup(df: DataFrame, lookup: DataFrame, key: Column, need: Column, fields: dict[str, str], lookup_key: str) -> DataFrame:
    """Left join on ``key`` where ``need`` holds: other rows get a null key and meet nothing.

    ``lookup`` gives the first row of each key (by its values), so rows never multiply. The join is by equality; Spark
    broadcasts the table only if it is small.
    """
    table = lookup.groupBy(F.col(lookup_key).alias("_key")).agg(F.min(F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(fields.values())])).alias("_hit"))
    joined = df.withColumn("_need", F.when(need, key)).join(table, F.col("_need") == F.col("_key"), "left")
    return joined.withColumns({name: F.col(f"_hit.v{i}") for i, name in enumerate(fields)}).drop("_need", "_key", "_hit")


def cin_key(c: str = "cin") -> Column:
    return F.upper(strip(c))


def address_key(c: str = "address") -> Column:
    return F.lower(collapse(c))


def merge_phones(primary: Column, alternate: Column, found: Column) -> Column:
    """struct(phone, phone_alt): found numbers that differ from those known fill the gaps, phone first."""
    start = F.struct(first_truthy(primary).alias("phone"), first_truthy(alternate).alias("phone_alt"))

    def take(state: Column, number: Column) -> Column:
        new = last_ten_digits(number).isNotNull() & ~F.coalesce(last_ten_digits(number) == last_ten_digits(state["phone"]), F.lit(False))
        fills_first = state["phone"].isNull() & new
        fills_second = state["phone"].isNotNull() & state["phone_alt"].isNull() & new
        return F.struct(F.when(fills_first, number).otherwise(state["phone"]).alias("phone"), F.when(fills_second, number).otherwise(state["phone_alt"]).alias("phone_alt"))

    return F.aggregate(F.coalesce(found, F.array().cast("array<string>")), start, take)


def enrich(companies: DataFrame, site: DataFrame, registry_by_name: DataFrame, registry_by_cin: DataFrame, gst_by_name: DataFrame, slab_by_gst: DataFrame, geo: DataFrame, people: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """Company fields merged from a website table and six lookups, in the reference's order of preference.

    site: company_name, email, address, contact_person, designation, linkedin_url, gst, cin, phones, official_name, url.
    strict: a row for which nothing but a phone or place was found stays as it was.
    """
    df = companies
    names = ["email", "address", "contact_person", "designation", "linkedin_url", "gst", "cin", "phones", "official_name", "url"]
    df = gated_lookup(df, site, F.col("company_name"), F.col("website").startswith("http"), {f"w_{n}": n for n in names}, "company_name")
    df = df.withColumn("x_cin", first_truthy("cin", "w_cin")).withColumn("x_gst", first_truthy("gst", "w_gst"))
    df = gated_lookup(df, gst_by_name, F.col("company_name"), is_falsy("x_gst"), {"g_gst": "gst"}, "name")
    df = df.withColumn("x_gst", first_truthy("x_gst", "g_gst"))
    df = gated_lookup(df, registry_by_name, F.col("company_name"), F.col("w_email").isNull() | F.col("w_address").isNull(), {"t_email": "email", "t_address": "address"}, "name")
    df = df.withColumn("x_email", first_truthy("w_email", "t_email")).withColumn("x_address", first_truthy("w_address", "t_address"))
    wanted = ~is_falsy("x_cin") & (is_falsy("x_address") | is_falsy("x_gst") | is_falsy("w_contact_person"))
    df = gated_lookup(df, registry_by_cin, cin_key("x_cin"), wanted, {"r_address": "address", "r_gst": "gst", "r_contact": "contact_person", "r_designation": "designation"}, "cin")
    df = df.withColumns({"x_address": first_truthy("x_address", "r_address"), "x_gst": first_truthy("x_gst", "r_gst"), "x_contact": first_truthy("w_contact_person", "r_contact"), "x_designation": first_truthy("w_designation", "r_designation"), "x_linkedin": F.col("w_linkedin_url")})
    if people is not None:
        df = gated_lookup(df, people, F.col("company_name"), is_falsy("x_contact"), {"p_contact": "contact_person", "p_designation": "designation", "p_linkedin": "linkedin_url"}, "name")
        df = df.withColumns({"x_contact": first_truthy("x_contact", "p_contact"), "x_designation": first_truthy("x_designation", "p_designation"), "x_linkedin": first_truthy("x_linkedin", "p_linkedin")})
    df = gated_lookup(df, slab_by_gst, F.upper(strip("x_gst")), ~is_falsy("x_gst") & is_falsy("turnover"), {"s_slab": "slab"}, "gst")
    df = df.withColumn("x_turnover", first_truthy("turnover", "s_slab"))
    df = df.withColumn("x_phones", merge_phones(F.col("phone"), F.col("phone_alt"), F.col("w_phones")))
    df = df.withColumn("_place", first_truthy("x_address", "address"))
    df = gated_lookup(df, geo, address_key("_place"), ~is_falsy("_place") & (is_falsy("city") | is_falsy("state") | is_falsy("region")), {"geo_city": "city", "geo_state": "state", "geo_region": "region"}, "address_key")
    parsed = address_components("_place")
    nothing = F.lit(False)
    if strict:
        nothing = F.lit(True)
        for c in ("x_email", "x_address", "x_contact", "x_designation", "x_linkedin", "x_gst", "x_cin", "x_turnover"):
            nothing = nothing & F.col(c).isNull()
        nothing = nothing & F.col("x_phones.phone_alt").isNull() & F.col("w_official_name").isNull()
    merged = {
        "company_name": first_truthy("w_official_name", "company_name"),
        "website": first_truthy("w_url", "website"),
        "email": first_truthy("x_email", "email"),
        "address": first_truthy("x_address", "address"),
        "contact_person": first_truthy("x_contact", "contact_person"),
        "designation": first_truthy("x_designation", "designation"),
        "linkedin_url": first_truthy("x_linkedin", "linkedin_url"),
        "gst": F.col("x_gst"),
        "cin": F.col("x_cin"),
        "turnover": F.col("x_turnover"),
        "phone": F.col("x_phones.phone"),
        "phone_alt": F.col("x_phones.phone_alt"),
        "city": first_truthy("geo_city", parsed["city"], "city"),
        "state": first_truthy("geo_state", parsed["state"], "state"),
        "region": first_truthy("geo_region", "region"),
    }
    return df.select([F.when(nothing, F.col(c)).otherwise(merged[c]).alias(c) if c in merged else F.col(c) for c in companies.columns])


def people_from_cards(cards: DataFrame, most_cards: int = 30) -> DataFrame:
    """(name, contact_person, designation, linkedin_url) from recorded people-search cards (name, rank, text, person, href).

    Of each company's first cards, the first that names the company, a target title and a person with a profile.
    """
    place = F.row_number().over(Window.partitionBy("name").orderBy("rank"))
    rows = cards.withColumn("_place", place).filter(F.col("_place") <= most_cards)
    person = F.element_at(F.split(strip("person"), "\n"), 1)
    rows = rows.withColumn("_title", designation_in_text("text")).filter(~is_falsy("text") & matches_company_terms(F.col("text"), F.col("name")) & F.col("_title").isNotNull() & F.contains(F.col("href"), F.lit("/in/")) & is_person_name(person))
    row = F.struct(person_name(person).alias("contact_person"), F.col("_title").alias("designation"), F.substring_index("href", "?", 1).alias("linkedin_url"))
    return rows.groupBy("name").agg(F.min_by(row, "_place").alias("_r")).select("name", "_r.*")


COVERED = ("email", "address", "contact_person", "phone_alt", "gst", "turnover", "city", "region")


def coverage(companies: DataFrame) -> DataFrame:
    """One row: how many companies there are, and how many have each field."""
    present = [F.count(F.when(~is_falsy(c), 1)).alias(f"with_{c}") for c in COVERED if c in companies.columns]
    return companies.agg(F.count(F.lit(1)).alias("total"), *present)
