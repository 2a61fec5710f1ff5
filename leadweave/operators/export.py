"""The accumulated export table: fixed headers, appended by each run."""

from __future__ import annotations

import time
import uuid
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..schema import EXPORT_COLUMNS, LEGACY_EXPORT_HEADERS

HEADERS = [header for header, _ in EXPORT_COLUMNS]


def export_rows(companies: DataFrame) -> DataFrame:
    """Companies under the export's headers; lists joined, nulls empty."""
    kinds = dict(companies.dtypes)

    def cell(field: str) -> Column:
        if field not in kinds:
            return F.lit("")
        value = F.array_join(F.col(field), "; ") if kinds[field].startswith("array") else F.col(field).cast("string")
        return F.coalesce(value, F.lit(""))

    return companies.select([cell(field).alias(header) for header, field in EXPORT_COLUMNS])


def checked_export(existing: DataFrame) -> DataFrame:
    """An earlier export with today's headers: without legacy columns, or refused."""
    current = existing.drop(*LEGACY_EXPORT_HEADERS)
    if existing.columns != HEADERS and current.columns != HEADERS:
        raise ValueError(f"the export has unexpected headers: {existing.columns}")
    return current


#: One row for each finished write of a job.
COMMITS = "job string, attempt string, at long, headers array<string>"


def append_export(companies: DataFrame, path: str, job_id: str) -> str:
    """Writes a job's rows, and then says that they are there; a job that runs again takes the place of what it wrote before.

    Rows go to a folder of this attempt alone, so that jobs, and attempts of one job, may run at once. One row in the log of
    commits makes them part of the export; an attempt that breaks off leaves no such row and is never read.
    """
    rows, attempt = export_rows(companies), uuid.uuid4().hex
    rows.write.parquet(f"{path}/rows/job={quote(job_id, safe='')}/attempt={attempt}")
    commit = (job_id, attempt, time.time_ns(), rows.columns)
    companies.sparkSession.createDataFrame([commit], COMMITS).coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return attempt


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """The rows of each job's last commit under today's headers, with ``job``.

    Every commit that counts must have today's headers, or these and legacy columns, which are left out; else the export is
    refused. Folders are picked by their commits, so that those of other attempts are not read.
    """
    commits = spark.read.schema(COMMITS).parquet(f"{path}/commits")
    last = commits.groupBy("job").agg(F.max_by(F.struct("attempt", "headers"), F.struct("at", "attempt")).alias("c")).select("job", "c.*")
    for found in last.select("headers").distinct().collect():  # as many as there have been formats
        if [h for h in found["headers"] if h not in LEGACY_EXPORT_HEADERS] != HEADERS:
            raise ValueError(f"the export has unexpected headers: {found['headers']}")
    shape = StructType([StructField(h, StringType()) for h in (*HEADERS, "job", "attempt")])
    rows = spark.read.schema(shape).parquet(f"{path}/rows")
    return rows.join(last.select("job", "attempt"), ["job", "attempt"], "left_semi").drop("attempt")


def column_widths(rows: DataFrame) -> DataFrame:
    """(header, width): the longest cell or the header, and some air, 50 at most."""
    longest = rows.agg(*[F.max(F.length(F.col(f"`{h}`"))).alias(h) for h in rows.columns])
    wide = [F.struct(F.lit(h).alias("header"), F.least(F.greatest(F.coalesce(F.col(f"`{h}`"), F.lit(0)), F.lit(len(h))) + 2, F.lit(50)).alias("width")) for h in rows.columns]
    return longest.select(F.explode(F.array(*wide)).alias("w")).select("w.header", "w.width")
