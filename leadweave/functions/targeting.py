"""Matching to the target dimensions, compiled to ordered CASE expressions: no join, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import BROAD_INDUSTRY, CITY_ALIASES, DESIGNATIONS, INDUSTRIES, STATES, TURNOVER_BANDS
from .text import col, collapse, contains_word, first_match, is_falsy, let, plain_signs, strip

NUMBER = r"\d+(?:[,.]\d+)?"


def primary_term(c: Column | str) -> Column:
    """The text before a bracket."""
    return F.lower(strip(F.substring_index(col(c), "(", 1)))


def match_industry(c: Column | str) -> Column:
    """The first specific industry whose term the text contains; the broad one only if no other fits."""
    text = F.lower(col(c))
    ordered = sorted(INDUSTRIES, key=lambda entry: entry[0] == 1)
    return first_match([(F.contains(text, F.lit(name.split("(")[0].strip().lower())), name) for _, name in ordered])


def industry_queries(c: Column | str) -> Column:
    """The one industry to search for, or all specific ones for a broad or missing request."""
    matched = match_industry(F.coalesce(col(c), F.lit("")))
    specific = F.array(*[F.lit(name) for level, name in INDUSTRIES if level != 1])
    return F.when(matched.isNotNull() & (matched != BROAD_INDUSTRY), F.array(matched)).when(~is_falsy(c) & matched.isNull(), F.array(col(c))).otherwise(specific)


def designation_function(c: Column | str) -> Column:
    """The function of the first title that stands in the text as words."""
    every = [(t.split("(")[0].strip().lower(), function) for function, own in DESIGNATIONS for t in own]
    return let(F.lower(col(c)), lambda text: first_match([(contains_word(text, t), function) for t, function in every]))


def designation_exact(c: Column | str) -> Column:
    """The title that the text is, but for case, spacing and a leading label."""
    plain = F.regexp_replace(F.lower(collapse(c)), r"^(designation|title|role)\s*[:\-]\s*", "")
    return let(plain, lambda text: F.when(F.length(text) <= 80, first_match([(text == t.lower(), t) for _, own in DESIGNATIONS for t in own])))


def designation_in_text(c: Column | str) -> Column:
    """The longest title that stands in the text."""
    every = sorted((t for _, own in DESIGNATIONS for t in own), key=len, reverse=True)
    return let(F.lower(F.regexp_replace(col(c), r"(?U)\s+", " ")), lambda text: first_match([(contains_word(text, t.lower()), t) for t in every]))


def _numbers(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.replace(F.lower(c), F.lit(","), F.lit("")), F.lit(NUMBER), F.lit(0)), lambda n: n.try_cast("double"))


def turnover_range(c: Column | str) -> Column:
    """struct(min_cr, max_cr); units are not read."""
    text, n = F.lower(col(c)), _numbers(col(c))
    one, first = F.size(n) == 1, F.try_element_at(n, F.lit(1))
    none = F.lit(None).cast("double")
    upto = F.contains(text, F.lit("upto")) | F.contains(text, F.lit("up to")) | F.contains(text, F.lit("below"))

    def both(low: Column, high: Column) -> Column:
        return F.struct(low.alias("min_cr"), high.alias("max_cr"))

    return (
        F.when(is_falsy(c) | (F.size(n) == 0), both(none, none))
        .when(F.contains(text, F.lit("above")) & one, both(first, none))
        .when(upto & one, both(F.lit(0.0), first))
        .when(F.size(n) >= 2, both(first, F.try_element_at(n, F.lit(2))))
        .otherwise(both(first, first))
    )


def first_number(c: Column | str) -> Column:
    return F.regexp_substr(F.replace(col(c), F.lit(","), F.lit("")), F.lit(NUMBER)).try_cast("double")


def turnover_band(crore: Column | str) -> Column:
    x = col(crore)
    return first_match([((x >= low) if high is None else (x >= low) & (x < high), name) for name, low, high in TURNOVER_BANDS])


def canonical_city(c: Column | str) -> Column:
    """The city of the first alias, in table order, that stands in the text."""
    text = F.lower(col(c))
    return first_match([(contains_word(text, alias), city) for alias, city in CITY_ALIASES])


def state_of(c: Column | str) -> Column:
    text = F.lower(collapse(c))
    return first_match([(contains_word(text, s.lower()), s) for s in STATES])


def address_components(c: Column | str) -> Column:
    """struct(city, state, region); the region is never guessed."""
    return F.struct(canonical_city(collapse(c)).alias("city"), state_of(c).alias("state"), F.lit(None).cast("string").alias("region"))


def in_requested_city(city: Column | str, address: Column | str, requested: Column | str) -> Column:
    """Equal canonical cities; for a place without one, its name in the city or address."""
    wanted, actual = canonical_city(requested), F.coalesce(canonical_city(city), canonical_city(address))
    name = plain_signs(F.coalesce(col(requested), F.lit("")))
    named = F.contains(plain_signs(F.coalesce(col(city), F.lit(""))), name) | F.contains(plain_signs(F.coalesce(col(address), F.lit(""))), name)
    return F.when(wanted.isNotNull(), F.coalesce(actual == wanted, F.lit(False))).otherwise((name != "") & named)
