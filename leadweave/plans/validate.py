"""The validation step as one plan: keys, greedy distinctness, baseline, city, profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.targeting import in_requested_city
from ..functions.text import strip
from ..functions.validation import company_keys, is_rejected, validated
from ..operators.baseline import without_known
from ..operators.dedup import greedy_distinct
from ..schema import with_company_fields


def validate(companies: DataFrame, known_keys: DataFrame | None = None, requested_location: str | None = None, requested_industry: str | None = None) -> DataFrame:
    """Companies that stay, with status, notes and remarks.

    The order matters: rows that the baseline, the city or the profile reject still block later duplicates, so
    distinctness comes first and none of the other tests may be moved before it.
    """
    rows = with_company_fields(companies).withColumn("keys", company_keys()).filter(F.size("keys") > 0)
    rows = greedy_distinct(rows)
    if known_keys is not None:
        rows = without_known(rows, known_keys)
    if requested_location and requested_location.strip():
        rows = rows.filter(in_requested_city("city", "address", strip(F.lit(requested_location))))
    return validated(rows, requested_industry).filter(~is_rejected(F.col("validation_notes"))).drop("keys")
