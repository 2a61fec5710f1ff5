"""Reading leads: filters, pages and single rows by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_falsy


def lead_rows(companies: DataFrame, job_id: str, seq: str = "seq") -> DataFrame:
    """Companies with an id that names job and position; the position is that before any filter."""
    return companies.withColumn("id", F.concat_ws(":", F.lit(job_id), F.col(seq)))


def filtered(leads: DataFrame, status: str | None = None, missing_gst: bool = False, missing_contact: bool = False) -> DataFrame:
    if status:
        leads = leads.filter(F.col("validation_status") == status)
    if missing_gst:
        leads = leads.filter(is_falsy("gst"))
    if missing_contact:
        leads = leads.filter(is_falsy("contact_person") | is_falsy("designation"))
    return leads


def page(leads: DataFrame, offset: int = 0, limit: int = 100, seq: str = "seq") -> DataFrame:
    """One page in order, each row with the total before paging."""
    if offset < 0 or not 1 <= limit <= 500:
        raise ValueError("offset must be 0 or more, limit from 1 to 500")
    total = leads.agg(F.count(F.lit(1)).alias("total"))
    rows = leads.orderBy(seq).offset(offset).limit(limit)
    return rows.join(F.broadcast(total))  # total is one row


def lead_by_position(leads: DataFrame, position: int, seq: str = "seq") -> DataFrame:
    return leads.filter(F.col(seq) == position)
