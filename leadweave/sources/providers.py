"""Search providers over recorded result pages, and a Python data source that serves any provider by name.

A provider turns recorded pages (query, place, html) into company rows with a rank. Nothing here goes to the network.
"""

from __future__ import annotations

import io
import json
from collections.abc import Callable
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions.extract import category_and_address, website_of_listing
from ..functions.markup import Element, cards
from ..functions.text import query_string, strip
from ..operators.dedup import best_by_name

Provider = Callable[[DataFrame], DataFrame]


def _text(element: Element | None) -> str | None:
    return "".join(element.text).strip() or None if element else None


def _parsed(pages: DataFrame, rows_of: Callable[[str | None], list[tuple]], schema: str) -> DataFrame:
    """Rows of all pages with the page's query and place, and the row's rank there."""
    names = [f.split()[0] for f in schema.split(", ")]
    kind = pages.schema["query"].dataType.simpleString()

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = [(q, p, i, *row) for q, p, html in zip(pdf["query"], pdf["place"], pdf["html"], strict=True) for i, row in enumerate(rows_of(html))]
            yield pd.DataFrame(out, columns=["query", "place", "at", *names])

    return pages.select("query", F.col("place").cast("long"), "html").mapInPandas(run, f"query {kind}, place long, at long, {schema}")


def web_search(pages: DataFrame) -> DataFrame:
    """Organic results: a heading and a link make a company and its website."""

    def rows_of(html):
        out = []
        for card in cards(html, lambda tag, kinds: tag == "div" and "g" in kinds):
            title, link = next((n for n in card if n.tag == "h3"), None), next((n for n in card if n.tag == "a" and n.attrs.get("href")), None)
            if _text(title) and link:
                out.append((_text(title), link.attrs["href"]))
        return out

    return _parsed(pages, rows_of, "company_name string, website string").withColumn("rank", F.col("place") * 1_000_000 + F.col("at")).drop("place", "at")


def map_listing(pages: DataFrame) -> DataFrame:
    """Cards of a map's result list; of cards with the same name the first with a website."""

    def rows_of(html):
        out = []
        for card in cards(html, lambda tag, kinds: tag == "div" and "Nv2PK" in kinds):
            def first(kind, card=card):
                return next((n for n in card if kind in n.kinds), None)

            website = next((n.attrs.get("href") for n in card if n.tag == "a" and n.attrs.get("href") and "hfpxzc" not in n.kinds), None)
            name = _text(first("qBF1Pd"))
            if name:
                out.append((name, website, _text(first("UsdlK")), ["".join(n.text) for n in card if "W4Efsd" in n.kinds]))
        return out

    rows = _parsed(pages, rows_of, "company_name string, href string, phone string, lines array<string>")
    place = category_and_address(F.col("lines"))
    rows = rows.select("query", (F.col("place") * 1_000_000 + F.col("at")).alias("rank"), "company_name", website_of_listing("href").alias("website"), strip("phone").alias("phone"), place["category"].alias("industry"), place["address"].alias("address"))
    named = rows.withColumn("_name", F.concat_ws("\0", "query", "company_name"))
    return best_by_name(named, "_name", "website", "rank").drop("_name")


def directory_listing(pages: DataFrame, card_class: str = "card") -> DataFrame:
    """Cards of a directory: name, profile address, city; the first of each name."""

    def rows_of(html):
        out = []
        for card in cards(html, lambda tag, kinds: card_class in kinds):
            link = next((n for n in card if n.tag == "a" and n.attrs.get("href")), None)
            city = next((n for n in card if "city" in n.kinds), None)
            if link and _text(link):
                out.append((_text(link), link.attrs["href"], _text(city)))
        return out

    rows = _parsed(pages, rows_of, "company_name string, website string, city string").withColumn("rank", F.col("place") * 1_000_000 + F.col("at")).drop("place", "at")
    key = F.struct("query", F.lower(strip("company_name")))
    row = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(key.alias("_k")).agg(F.min_by(row, F.col("rank")).alias("_r")).select("_r.*")


def embedded_results(pages: DataFrame) -> DataFrame:
    """(query, results): the search response inside a page's embedded JSON; its rows are not mapped to companies."""
    script = F.regexp_extract("html", r"""(?is)<script[^>]*id\s*=\s*["']__NEXT_DATA__["'][^>]*>(.*?)</script>""", 1)
    return pages.select("query", F.get_json_object(script, "$.props.pageProps.searchResponse").alias("results"))


def composite_directory(first: DataFrame, second: DataFrame) -> DataFrame:
    """All of the first directory, then all of the second."""
    return first.withColumn("provider_ord", F.lit(0)).unionByName(second.withColumn("provider_ord", F.lit(1)), allowMissingColumns=True)


def request_query(requests: DataFrame) -> DataFrame:
    """Each request's query text and its form in an address."""
    text = query_string(F.col("industry"), F.col("location"), F.col("keywords"))
    return requests.withColumn("query", text).withColumn("query_encoded", F.url_encode("query"))


class RecordedPages(DataSource):
    """``spark.read`` or ``spark.readStream.format("recorded_pages").option("path", folder)``: pages (query, place, html).

    Pages lie in JSON-lines files below the folder, in ``query=...`` folders or with the query in each line. The
    option ``queries``, a JSON list, skips the folders of other queries, and their lines. (Conditions are not pushed down: Spark
    4.1 keeps those of one query for the next over the same DataFrame, which then lacks rows.) Files are read by URI through Arrow's file systems, on the executors.
    As a stream, files count in the order of their times and names, and must arrive whole.
    """

    @classmethod
    def name(cls) -> str:
        return "recorded_pages"

    def schema(self) -> str:
        return "query string, place long, html string"

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(self.options["path"], self.options.get("queries"))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802 (Spark's name)
        return _PageStream(self.options["path"], self.options.get("queries"))


def _file_system(uri: str):
    """Arrow's file system for a path or URI, and the path in it."""
    if "://" not in uri and uri.startswith("file:/"):
        uri = uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def _page_files(uri: str) -> list[tuple[int, str]]:
    """(time, path) of the page files below a folder, in order; hidden and unfinished ones left out."""
    system, root = _file_system(uri)
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    own = [(f.mtime_ns or 0, f.path) for f in found if f.is_file and f.path.endswith((".json", ".jsonl"))]
    return sorted(f for f in own if not any(part.startswith(("_", ".")) for part in f[1][len(root) :].split("/")))


def _query_of(path: str) -> str | None:
    """The query that a file's folder names."""
    named = [p for p in path.split("/") if p.startswith("query=")]
    return unquote(named[-1].removeprefix("query=")) if named else None


class _Wanted:
    """A folder, and the queries that are wanted of it: all, if none are named."""

    def __init__(self, path: str, queries: str | None):
        self.path, self.queries = path, None if queries is None else frozenset(map(str, json.loads(queries)))

    def fits(self, query: str | None) -> bool:
        return self.queries is None or query in self.queries

    def files(self) -> list[tuple[int, str]]:
        return [(time, path) for time, path in _page_files(self.path) if _query_of(path) is None or self.fits(_query_of(path))]

    def read(self, partition):
        if partition.value is not None:
            yield from _pages(self.path, partition.value, self.fits)


class _PageReader(_Wanted, DataSourceReader):
    def partitions(self):
        return [InputPartition(path) for _, path in self.files()] or [InputPartition(None)]


def _pages(uri: str, path: str, fits, rows: int = 512):
    """Arrow batches of a file's pages."""
    system, _ = _file_system(uri)
    query = _query_of(path)
    held: list[tuple] = []

    def batch():
        columns = zip(*held, strict=True) if held else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string()), strict=True)], names=["query", "place", "html"])

    with system.open_input_stream(path) as body, io.TextIOWrapper(body, encoding="utf-8") as lines:
        for line in lines:
            page = json.loads(line) if line.strip() else {}
            own = page.get("query", query)
            own = None if own is None else str(own)
            if page and fits(own):
                held.append((own, page.get("place"), page.get("html")))
                if len(held) == rows:
                    yield batch()
                    held.clear()
    yield batch()


class _PageStream(_Wanted, DataSourceStreamReader):
    """Offsets are the time and name of the last file that has been read."""

    def initialOffset(self) -> dict:  # noqa: N802 (Spark's name)
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802 (Spark's name)
        files = _page_files(self.path)
        return {"time": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict):
        after, last = (start["time"], start["path"]), (end["time"], end["path"])
        return [InputPartition(path) for time, path in self.files() if after < (time, path) <= last] or [InputPartition(None)]

    def commit(self, end: dict) -> None:
        pass
