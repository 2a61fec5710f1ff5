"""From the recorded pages of companies' websites to one row of found fields for each company."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.extract import address_block, cin, email, gstin, gstin_of_site, links, official_name, phones, profile_url
from ..functions.markup import visible_text_column
from ..functions.payloads import best_jsonld_name_column, contact_near_title_column

#: Pages read of a company: its own and two that it links to.
MOST_PAGES = 3
FIELDS = {"email": "string", "address": "string", "contact_person": "string", "designation": "string", "linkedin_url": "string", "gst": "string", "pdf_gst": "string", "cin": "string"}
_STATE = "struct<" + ", ".join(f"{n}: {t}" for n, t in FIELDS.items()) + ", phones: array<string>, done: boolean>"


def jsonld_documents(html: Column | str) -> Column:
    """The texts of a page's ld+json scripts."""
    c = F.col(html) if isinstance(html, str) else html
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"""(?is)<script[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))
    return found


def named_page(html: Column | str) -> Column:
    """A page's company name: from its JSON-LD, else from what the page says of itself."""
    return F.coalesce(best_jsonld_name_column(jsonld_documents(html)), official_name(html))


def page_finds(pages: DataFrame) -> DataFrame:
    """(company_name, place, url, official_name, finds): what each page holds.

    ``text`` is what a page shows; where the column is missing, it is read from the markup. pdf_texts: texts of documents
    that a page links to.
    """
    if "text" not in pages.columns:
        pages = pages.withColumn("text", visible_text_column.asNondeterministic()(F.col("html")))  # once a page
    contact = contact_near_title_column(F.col("text"))
    rows = pages.withColumn("_contact", contact).withColumn("_name", F.when(F.col("place") == 0, named_page("html")))
    pdf = F.when(gstin("html").isNull(), gstin_of_site(F.lit(""), F.col("pdf_texts"))) if "pdf_texts" in pages.columns else F.lit(None)
    finds = {
        "email": email("text", "html"),
        "address": address_block("text"),
        "contact_person": F.col("_contact.name"),
        "designation": F.col("_contact.title"),
        "linkedin_url": F.when(F.col("_contact.name").isNotNull(), profile_url(links("html")["href"])),
        "gst": F.coalesce(gstin("html"), gstin("text")),
        "pdf_gst": pdf.cast("string"),
        "cin": F.coalesce(cin("html"), cin("text")),
    }
    return rows.select("company_name", "place", "url", F.col("_name").alias("official_name"), F.struct(*[c.alias(n) for n, c in finds.items()], phones("text", "html").alias("phones")).alias("finds"))


def site_table(pages: DataFrame) -> DataFrame:
    """One row a company from pages (company_name, place, url, html[, text, pdf_texts]): place 0 is its site, 1 and 2 the pages read next.

    Later pages fill what is missing, a person and their title together, numbers while fewer than two are known; a page
    after one that completed address, email and two numbers is not looked at. Companies without a first page give no row.
    """
    own = page_finds(pages.filter(F.col("place").between(0, MOST_PAGES - 1)))
    row = F.struct("place", "url", "official_name", "finds")
    held = own.groupBy("company_name").agg(F.array_sort(F.collect_list(row)).alias("read"))  # three small rows a company
    first = F.element_at("read", 1)
    empty = F.struct(*[F.lit(None).cast(t).alias(n) for n, t in FIELDS.items()], F.array().cast("array<string>").alias("phones"), F.lit(False).alias("done")).cast(_STATE)

    def more(state: Column, page: Column) -> Column:
        f = page["finds"]
        known = state["contact_person"].isNotNull()
        person = {n: F.when(known, state[n]).otherwise(f[n]) for n in ("contact_person", "designation", "linkedin_url")}
        other = {n: F.coalesce(state[n], f[n]) for n in ("email", "address", "gst", "pdf_gst", "cin")}
        numbers = F.when(F.size(state["phones"]) < 2, F.array_distinct(F.concat(state["phones"], f["phones"]))).otherwise(state["phones"])
        # the first page never ends the visit
        done = other["email"].isNotNull() & other["address"].isNotNull() & (F.size(numbers) >= 2) & (page["place"] > 0)
        new = F.struct(*[(person | other)[n].alias(n) for n in FIELDS], numbers.alias("phones"), done.alias("done"))
        return F.when(state["done"], state).otherwise(new)

    found = held.filter(first["place"] == 0).select("company_name", first["url"].alias("url"), first["official_name"].alias("official_name"), F.aggregate("read", empty, more).alias("s"))
    fields = [F.coalesce("s.gst", "s.pdf_gst").alias("gst") if n == "gst" else F.col(f"s.{n}").alias(n) for n in FIELDS if n != "pdf_gst"]
    return found.select("company_name", *fields, F.col("s.phones").alias("phones"), "official_name", "url")
