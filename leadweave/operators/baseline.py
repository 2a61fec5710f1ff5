"""What is already known: reading baseline tables of any header, and leaving out companies found there."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..functions.validation import KEY_FIELDS, company_keys

#: Which normalised headers may give a field, in order.
HEADER_ALIASES = {
    "company_name": ("companyname", "company", "name"),
    "gst": ("gst", "gstin"),
    "city": ("city",),
    "website": ("websiteurl", "website", "domain"),
    "email": ("emailid", "email"),
    "phone": ("mobilenumber", "contactnumber", "phone", "mobile"),
    "phone_alt": ("alternatemobilenumber", "alternatephone", "altphone"),
}


def normalise_headers(df: DataFrame) -> DataFrame:
    """Company fields from the columns whose names, without signs and case, are an alias; of equal names the last counts."""
    spare = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    at = {re.sub(r"[^a-z0-9]", "", name.lower()): f"c{i}" for i, name in enumerate(df.columns)}

    def field(aliases: tuple[str, ...]) -> Column:
        found = [F.nullif(strip(F.col(at[a]).cast("string")), F.lit("")) for a in aliases if a in at]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    return spare.select([(F.coalesce(field(a), F.lit("")) if name == "company_name" else field(a)).alias(name) for name, a in HEADER_ALIASES.items()])


def key_set(companies: DataFrame) -> DataFrame:
    """The distinct keys of all companies."""
    fields = {f: F.col(f) if f in companies.columns else F.lit(None).cast("string") for f in KEY_FIELDS}
    return companies.select(F.explode(company_keys(fields)).alias("key")).distinct()


def without_known(companies: DataFrame, known: DataFrame, keys: str = "keys", seq: str = "seq") -> DataFrame:
    """Companies that share no key with ``known`` (a column ``key``): two joins by equality, whatever the sizes."""
    met = companies.select(seq, F.explode(keys).alias("key")).join(known, "key", "left_semi").select(seq).distinct()
    return companies.join(met, seq, "left_anti")
