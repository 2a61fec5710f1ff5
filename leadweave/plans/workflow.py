"""The steps of the lead workflow over tables, ready for ``run_workflow``."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.dedup import numbered
from ..operators.enrich import enrich
from ..operators.export import append_export
from ..operators.search import search
from ..schema import with_company_fields
from .understanding import Context, Step
from .validate import validate

#: Lookups that enrichment needs, in the order of its arguments.
LOOKUPS = {
    "site": "company_name string, email string, address string, contact_person string, designation string, linkedin_url string, gst string, cin string, phones array<string>, official_name string, url string",
    "registry_by_name": "name string, address string, email string",
    "registry_by_cin": "cin string, address string, gst string, contact_person string, designation string",
    "gst_by_name": "name string, gst string",
    "slab_by_gst": "gst string, slab string",
    "geo": "address_key string, city string, state string, region string",
}


def run_search(companies: DataFrame, context: Context) -> DataFrame:
    """The first rows of what the providers (tables whose names start with ``found``) give; without any, the rows as they are."""
    results = [context.tables[name] for name in sorted(context.tables) if name.startswith("found")]
    if not results:
        return companies
    found = search(results, context.plan.get("max_results", 100), context.plan.get("branches", 1)).drop("seq")
    return numbered(found, "industry_ord", "provider_ord", "rank")


def run_enrichment(companies: DataFrame, context: Context) -> DataFrame:
    """Contacts come with it; a lookup that is not there finds nothing."""
    spark = companies.sparkSession
    lookups = [context.tables[name] if name in context.tables else spark.createDataFrame([], shape) for name, shape in LOOKUPS.items()]
    return enrich(with_company_fields(companies), *lookups, people=context.tables.get("people"))


def run_validation(companies: DataFrame, context: Context) -> DataFrame:
    return validate(companies, context.tables.get("known_keys"), context.plan.get("location"), context.plan.get("industry"))


def run_export(companies: DataFrame, context: Context) -> DataFrame:
    """Appends to the plan's export table, if it names one; the companies go on."""
    if path := context.plan.get("export_path"):
        append_export(companies, path, context.plan.get("job_id", "job"))
    return companies


STEPS: dict[str, Step] = {"search": run_search, "enrichment": run_enrichment, "validation": run_validation, "export": run_export}
