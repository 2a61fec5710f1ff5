"""Search fan-out: one branch for each industry and provider, capped, united in order, and capped again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.extract import is_organic
from .dedup import first_by_name_and_website


def branch_cap(max_results: int, branches: int) -> int:
    return max(1, -(-max_results // max(1, branches)))


def union_in_order(results: list[DataFrame], cap: int) -> DataFrame:
    """Each provider's first ``cap`` rows of each industry (by ``rank``), with ``seq`` telling industry, provider, rank."""
    tagged = [df.withColumn("provider_ord", F.lit(i)) for i, df in enumerate(results)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    place = F.row_number().over(Window.partitionBy("industry_ord", "provider_ord").orderBy("rank"))
    rows = rows.withColumn("_place", place).filter(F.col("_place") <= cap).drop("_place")
    return rows.withColumn("seq", F.struct("industry_ord", "provider_ord", "rank"))


def search(results: list[DataFrame], max_results: int, branches: int) -> DataFrame:
    """The first rows by name and website of all branches, up to ``max_results``."""
    rows = first_by_name_and_website(union_in_order(results, branch_cap(max_results, branches)))
    return rows.orderBy("seq").limit(max_results)


def organic_urls(results: DataFrame, limit: int, query: str = "query", url: str = "url", rank: str = "rank") -> DataFrame:
    """(query, url, place): distinct organic addresses among each query's first 2 * limit, the first ``limit`` of them."""
    read = F.row_number().over(Window.partitionBy(query).orderBy(rank))
    seen = results.withColumn("_read", read).filter(F.col("_read") <= 2 * limit).filter(is_organic(F.col(url)))
    first = seen.groupBy(query, url).agg(F.min(rank).alias("_first"))
    place = F.row_number().over(Window.partitionBy(query).orderBy("_first"))
    return first.withColumn("place", place).filter(F.col("place") <= limit).select(query, url, "place")


def supplemental_links(pages: DataFrame, k: int = 2, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, link, place): each page's first ``k`` same-site links that look like legal or contact pages."""
    from ..functions.extract import CONTACT_LINK_WORDS, FIRST_LINK_WORDS, absolute_url, is_same_site, links

    rows = pages.select(key, F.col(url).alias("_base"), F.explode(links(html)).alias("_link")).select(key, "_base", F.lower("_link.label").alias("_label"), absolute_url(F.col("_base"), F.col("_link.href")).alias("link"))
    path = F.lower(F.regexp_extract("link", r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1))
    rows = rows.filter(is_same_site(F.col("_base"), F.col("link"))).withColumn("_hay", F.concat_ws(" ", "_label", path))
    rows = rows.filter(F.exists(F.array(*map(F.lit, CONTACT_LINK_WORDS)), lambda w: F.contains(F.col("_hay"), w)))
    first = F.exists(F.array(*map(F.lit, FIRST_LINK_WORDS)), lambda w: F.contains(F.col("_hay"), w))
    rows = rows.groupBy(key, "link").agg(F.min(F.when(first, 0).otherwise(1)).alias("_priority"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("_priority", "link"))
    return rows.withColumn("place", place).filter(F.col("place") <= k).select(key, "link", "place")


def pages_until_complete(pages: DataFrame, complete: str, key: str = "company", place: str = "place") -> DataFrame:
    """Each company's pages up to and including the first after which what was found so far is complete."""
    before = Window.partitionBy(key).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("_done", F.coalesce(F.bool_or(F.col(complete)).over(before), F.lit(False))).filter("NOT _done").drop("_done")
