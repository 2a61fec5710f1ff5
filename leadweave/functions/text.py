"""Text expressions with the meaning of the reference implementation's string functions, all inside Catalyst."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_falsy(c: Column | str) -> Column:
    """Null or the empty string."""
    return F.coalesce(col(c), F.lit("")) == ""


def first_truthy(*cs: Column | str) -> Column:
    """The first that is neither null nor empty; null if there is none."""
    return F.coalesce(*[F.nullif(col(c), F.lit("")) for c in cs])


def strip(c: Column | str) -> Column:
    """Without white space, Unicode's included, at both ends."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def collapse(c: Column | str) -> Column:
    """Runs of white space become one space, none at the ends."""
    return strip(F.regexp_replace(col(c), r"(?U)\s+", " "))


def word_signs(c: Column | str) -> Column:
    """Letters, digits and underscores of any script."""
    return F.regexp_replace(col(c), r"[^\p{L}\p{N}_]+", "")


def plain_signs(c: Column | str) -> Column:
    """Lower-cased a-z and 0-9 only."""
    return F.regexp_replace(F.lower(col(c)), "[^a-z0-9]", "")


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once: CASE branches and lambdas would otherwise each compute it anew."""
    return F.element_at(F.transform(F.array(value), use), 1)


def contains_word(text: Column, phrase: str) -> Column:
    """Whether the phrase stands between word boundaries; the regular expression runs only where the phrase occurs at all."""
    return F.contains(text, F.lit(phrase)) & text.rlike(r"(?U)\b" + re.escape(phrase) + r"\b")


def first_match(pairs: list[tuple[Column, str]]) -> Column:
    """The value of the first condition that holds, else null."""
    found = F.lit(None).cast("string")
    for condition, value in reversed(pairs):
        found = F.when(condition, F.lit(value)).otherwise(found)
    return found


def host(url: Column | str) -> Column:
    """Network location in lower case, port and user kept, without one leading www."""
    u = col(url)
    absolute = F.when(F.contains(u, F.lit("://")), u).otherwise(F.concat(F.lit("https://"), u))
    return F.regexp_replace(F.lower(F.regexp_extract(absolute, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)), r"^www\.", "")


def digits(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"(?U)\D+", "")


def last_ten_digits(c: Column | str) -> Column:
    """All digits if fewer than ten; null if none."""
    return F.nullif(F.right(digits(c), F.lit(10)), F.lit(""))


def split_lines(c: Column | str) -> Column:
    """Stripped lines that are not empty, at all Unicode line ends."""
    lines = F.split(col(c), r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]")
    return F.filter(F.transform(lines, strip), lambda line: line != "")


def placeholder_to_null(c: Column | str) -> Column:
    """Null for words that stand for a missing value; else the stripped text."""
    text = strip(F.coalesce(col(c), F.lit("")))
    return F.when(~F.lower(text).isin("", "n/a", "na", "none", "null", "not available", "unknown"), text)


def query_string(industry: Column, location: Column, keywords: Column) -> Column:
    """The parts that are not empty, with single spaces between."""
    parts = F.concat(F.array(industry, location), F.coalesce(keywords, F.array().cast("array<string>")))
    return F.array_join(F.filter(parts, lambda p: ~is_falsy(p)), " ")


def mask_secret(name: Column, value: Column) -> Column:
    """Header values that hold secrets become stars."""
    secret = F.lower(name).isin("authorization", "x-api-key", "api-key", "token", "cookie") & (value != "")
    return F.when(secret, F.when(value.startswith("Bearer "), "Bearer ********").otherwise("********")).otherwise(value)
