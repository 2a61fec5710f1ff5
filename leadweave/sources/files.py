"""Files: baseline tables of any header in CSV and XLSX, and a folder's catalogue."""

from __future__ import annotations

import csv
import io
import os
import re
import tempfile
import zipfile
from functools import reduce
from pathlib import Path
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.baseline import HEADER_ALIASES, normalise_headers
from ..operators.lineage import folder_exists

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def csv_encoding(head: bytes) -> str:
    """utf-8, cp1252 or latin-1, whichever first decodes the bytes."""
    for name in ("utf-8", "cp1252"):
        try:
            head.decode(name)
            return name
        except UnicodeDecodeError:
            continue
    return "ISO-8859-1"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Company fields of a CSV file with a header row, its encoding told from its bytes on the executors.

    Spark's reader takes UTF-8 and Latin-1; a file in cp1252 is parsed whole where it is scheduled.
    """
    tell = F.udf(lambda b: csv_encoding(bytes(b)), "string")
    encodings = [r["e"] for r in spark.read.format("binaryFile").load(path).select(tell("content").alias("e")).distinct().limit(2).collect()]
    if encodings not in (["utf-8"], ["ISO-8859-1"]):  # cp1252, or files that differ
        return _parsed_files(spark, path, csv_rows)
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding=encodings[0])
    return normalise_headers(df.toDF(*[c.removeprefix("\ufeff") for c in df.columns]))


def csv_rows(content: bytes) -> list[list[str]]:
    """The rows of a CSV file in whatever encoding decodes it."""
    return list(csv.reader(io.StringIO(content.decode(csv_encoding(content)).removeprefix("\ufeff"), newline="")))


def _parsed_files(spark: SparkSession, path: str, rows_of, kind: str = "*") -> DataFrame:
    """Company fields from files that ``rows_of`` turns into rows of text, the first the headers."""
    fields = list(HEADER_ALIASES)

    def parse(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for content in pdf["content"]:
                header, *rows = rows_of(bytes(content)) or [[]]
                for row in rows:
                    values = {re.sub(r"[^a-z0-9]", "", h.lower()): v.strip() for h, v in zip(header, row, strict=False)}
                    out.append([next((values[a] for a in HEADER_ALIASES[f] if values.get(a)), "" if f == "company_name" else None) for f in fields])
            yield pd.DataFrame(out, columns=fields)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", kind).load(path)
    return files.select("content").mapInPandas(parse, ", ".join(f"{f} string" for f in fields))


def xlsx_rows(content: bytes) -> list[list[str]]:
    """The values of the first worksheet that the workbook shows, as text, row by row."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        view = book.find(f"{_NS}bookViews/{_NS}workbookView")
        active = int(view.get("activeTab", 0)) if view is not None else 0
        link = book.findall(f"{_NS}sheets/{_NS}sheet")[active].get(f"{_REL}id")
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheet = ElementTree.fromstring(z.read("xl/" + targets[link].removeprefix("/xl/")))
    rows = []
    for row in sheet.iter(f"{_NS}row"):
        cells: list[str] = []
        for c in row.iter(f"{_NS}c"):
            letters = re.match("[A-Z]+", c.get("r", "")) if c.get("r") else None
            at = reduce(lambda n, ch: n * 26 + ord(ch) - 64, letters.group(), 0) - 1 if letters else len(cells)
            cells += [""] * (at - len(cells))
            value = c.find(f"{_NS}v")
            text = "".join(t.text or "" for t in c.iter(f"{_NS}t")) if c.get("t") == "inlineStr" else (value.text or "") if value is not None else ""
            cells.append(shared[int(text)] if c.get("t") == "s" and text else text)
        rows.append(cells)
    return rows


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """Company fields of one or more workbooks (row 1 holds the headers)."""
    return _parsed_files(spark, path, xlsx_rows)


def catalogue(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """(name, path, size_bytes, modified) of the CSV and XLSX files of a folder, by name whatever the case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).drop("content")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("name"), "path", F.col("length").alias("size_bytes"), F.unix_timestamp("modificationTime").alias("modified")).filter(F.lower("name").rlike(r"\.(csv|xlsx)$")).orderBy(F.lower("name"))


def baseline(spark: SparkSession, folder: str) -> DataFrame:
    """Company fields of all CSV files below a folder, then all workbooks; none where there is no such path."""
    if not folder_exists(spark, folder):
        return spark.createDataFrame([], ", ".join(f"{f} string" for f in HEADER_ALIASES))
    return _parsed_files(spark, folder, csv_rows, "*.[cC][sS][vV]").unionByName(_parsed_files(spark, folder, xlsx_rows, "*.[xX][lL][sS][xX]"))


def is_plain_file_name(name: str) -> bool:
    """A bare CSV or XLSX name, without any folder."""
    return name == name.replace("\\", "/").rsplit("/", 1)[-1] and name.lower().endswith((".csv", ".xlsx")) and not name.startswith(".")


MAX_UPLOAD_BYTES = 25 << 20


def store_upload(folder: str, name: str, content: bytes) -> str:
    """Put a baseline file into a folder: whole or not at all, never over another."""
    if not is_plain_file_name(name):
        raise ValueError("a .csv or .xlsx file with a simple name is needed")
    if len(content) > MAX_UPLOAD_BYTES:
        raise ValueError("a file may have 25 MB")
    target = Path(folder, name)
    target.parent.mkdir(parents=True, exist_ok=True)
    if target.exists():
        raise FileExistsError(name)
    with tempfile.NamedTemporaryFile(dir=folder, prefix=".", delete=False) as part:
        part.write(content)
    os.replace(part.name, target)
    return str(target)


def remove_upload(folder: str, name: str) -> None:
    if not is_plain_file_name(name):
        raise ValueError("a .csv or .xlsx file with a simple name is needed")
    Path(folder, name).unlink()


def read_prompt(folder: str, name: str) -> str:
    """The text of a prompt, kept as a Markdown file."""
    return Path(folder, f"{name}.md").read_text(encoding="utf-8")


def xlsx_bytes(headers: list[str], rows: list[list[str]], sheet: str = "Leads") -> bytes:
    """A small workbook: bold frozen header row with a filter, text cells."""
    from xml.sax.saxutils import escape

    def letter(i: int) -> str:
        return (letter(i // 26 - 1) if i >= 26 else "") + chr(65 + i % 26)

    def line(r: int, cells: list[str], style: str) -> str:
        return f'<row r="{r}">' + "".join(f'<c r="{letter(i)}{r}" t="inlineStr"{style}><is><t xml:space="preserve">{escape(str(v))}</t></is></c>' for i, v in enumerate(cells)) + "</row>"

    widths = [min(max([len(h), *(len(str(r[i])) for r in rows)]) + 2, 50) for i, h in enumerate(headers)]
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    package = "http://schemas.openxmlformats.org/package/2006"
    kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kinds}.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="{kinds}.styles+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook {main} {rel}><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{office}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet {main}><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet {main}><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews><cols>'
        + "".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, w in enumerate(widths, 1))
        + "</cols><sheetData>"
        + line(1, headers, ' s="1"')
        + "".join(line(i, [str(v) for v in r], "") for i, r in enumerate(rows, 2))
        + f'</sheetData><autoFilter ref="A1:{letter(len(headers) - 1)}{len(rows) + 1}"/></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + body)
    return out.getvalue()
