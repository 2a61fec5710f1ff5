"""Company keys, validation notes and status as expressions over company columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import BROAD_INDUSTRY, MIN_EMPLOYEES, MIN_TURNOVER_CR
from .targeting import first_number, match_industry, turnover_range
from .text import digits, first_truthy, host, is_falsy, let, strip, word_signs

KEY_FIELDS = ("gst", "website", "email", "phone", "phone_alt", "company_name")


def company_keys(fields: dict[str, Column] | None = None) -> Column:
    """The distinct keys by which two companies count as the same."""
    c = {name: F.col(name) for name in KEY_FIELDS} | (fields or {})
    site = host(c["website"])

    def phone(x: Column) -> Column:
        return F.when(F.length(digits(x)) >= 7, F.concat(F.lit("phone:"), F.right(digits(x), F.lit(10))))

    name = F.lower(word_signs(c["company_name"]))
    keys = F.array(
        F.when(~is_falsy(c["gst"]), F.concat(F.lit("gst:"), F.upper(word_signs(c["gst"])))),
        F.when(~is_falsy(c["website"]) & (site != "") & ~F.contains(site, F.lit("tradeindia.com")), F.concat(F.lit("website:"), site)),
        F.when(~is_falsy(c["email"]), F.concat(F.lit("email:"), F.lower(strip(c["email"])))),
        phone(c["phone"]),
        phone(c["phone_alt"]),
        F.when(name != "", F.concat(F.lit("name:"), name)),
    )
    return F.array_distinct(F.filter(keys, lambda k: k.isNotNull()))


def validation_notes(requested_industry: str | None = None) -> Column:
    """What speaks against a company, in the order industry, turnover, employees."""
    def industry(read: Column) -> Column:
        matched, wanted = read["matched"], read["wanted"]
        return (
            F.when(is_falsy("industry"), "unverified: industry not supplied")
            .when(matched.isNull(), "unverified: declared industry could not be matched to a target segment")
            .when(wanted.isNotNull() & (wanted != BROAD_INDUSTRY) & (matched != wanted), F.concat(F.lit("rejected: declared industry '"), matched, F.lit("' does not match requested '"), wanted, F.lit("'")))
        )

    def turnover(slab: Column) -> Column:
        return (
            F.when(is_falsy("turnover"), "unverified: turnover unavailable")
            .when(slab["min_cr"].isNull(), "unverified: turnover could not be parsed")
            .when(slab["max_cr"] < MIN_TURNOVER_CR, f"rejected: turnover below {MIN_TURNOVER_CR} Cr")
            .when(slab["min_cr"] < MIN_TURNOVER_CR, F.concat(F.lit("unverified: turnover slab '"), F.col("turnover"), F.lit(f"' straddles {MIN_TURNOVER_CR} Cr threshold - needs manual review")))
        )

    def employees(staff: Column) -> Column:
        return (
            F.when(is_falsy("employee_count"), "unverified: employee count unavailable")
            .when(staff.isNull(), "unverified: employee count could not be parsed")
            .when(staff < MIN_EMPLOYEES, f"rejected: employee count below {MIN_EMPLOYEES}")
        )

    both = F.struct(match_industry("industry").alias("matched"), match_industry(F.lit(requested_industry)).alias("wanted"))
    every = F.array(let(both, industry), let(turnover_range("turnover"), turnover), let(first_number("employee_count"), employees))
    return F.filter(every, lambda n: n.isNotNull())


def is_rejected(notes: Column) -> Column:
    return F.exists(notes, lambda n: n.startswith("rejected:"))


def validation_status(notes: Column) -> Column:
    return let(notes, lambda n: F.when(is_rejected(n), "rejected").when(F.size(n) == 0, "validated").otherwise("unverified"))


def validated(df, requested_industry: str | None = None):
    """``df`` with notes, status and remarks."""
    df = df.withColumn("validation_notes", validation_notes(requested_industry))
    notes = F.col("validation_notes")
    remarks = F.col("remarks") if "remarks" in df.columns else F.lit(None).cast("string")
    return df.withColumns({"validation_status": validation_status(notes), "remarks": F.coalesce(first_truthy(remarks), F.array_join(notes, "; "))})
