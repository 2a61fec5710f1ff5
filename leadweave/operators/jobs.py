"""Jobs as an append-only event log, folded to their latest state."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import JOB_EVENT
from .lineage import folder_exists, remove

FINAL = ("completed", "failed")


def new_job_id() -> str:
    return uuid.uuid4().hex


def log_event(spark: SparkSession, path: str, number: int, job_id: str, step: str, status: str, message: str = "") -> None:
    """Append one event; the log is never rewritten. ``number`` orders a job's events."""
    row = (number, job_id, datetime.now(UTC).isoformat(), step, status, message)
    spark.createDataFrame([row], JOB_EVENT).write.mode("append").parquet(path)


#: One row for each folding of a log: its number, and the names of the event files that are in it.
FOLDS = "fold long, files array<string>"


def _folds(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.schema(FOLDS).parquet(f"{path}.folds") if folder_exists(spark, f"{path}.folds") else None


def _last_fold(folds: DataFrame | None) -> tuple[int | None, DataFrame | None]:
    """Its number, and the names of the files in it."""
    last = folds.agg(F.max("fold")).first()[0] if folds is not None else None
    return last, None if last is None else folds.filter(F.col("fold") == last).select(F.explode("files").alias("_file"))


def _all_events(spark: SparkSession, path: str, listed: DataFrame) -> DataFrame:
    """What the last fold holds, and the listed files that it does not stand for."""
    fold, files = _last_fold(_folds(spark, path))
    if fold is None:
        return listed
    since = listed.withColumn("_file", F.col("_metadata.file_name")).join(files, "_file", "left_anti").drop("_file")
    return spark.read.schema(JOB_EVENT).parquet(f"{path}.folded/fold={fold}").unionByName(since)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All events: those folded so far from their one table, and those in files that have come since. Each counts once."""
    return _all_events(spark, path, spark.read.schema(JOB_EVENT).parquet(path))


def fold_log(spark: SparkSession, path: str) -> int:
    """Writes all events to few files, and then says which event files these stand for; -> the fold's number.

    Until that one row is written, readers see the files as before; after it they see the fold and later files. One fold
    runs at a time; events may come meanwhile.
    """
    fold, _ = _last_fold(_folds(spark, path))
    number = 0 if fold is None else fold + 1
    listed = spark.read.schema(JOB_EVENT).parquet(path)  # lists the files once
    events = _all_events(spark, path, listed)
    events.repartition("job_id").sortWithinPartitions("job_id", "id").write.mode("overwrite").parquet(f"{path}.folded/fold={number}")
    names = sorted(unquote(f.rsplit("/", 1)[-1]) for f in listed.inputFiles())
    spark.createDataFrame([(number, names)], FOLDS).coalesce(1).write.mode("append").parquet(f"{path}.folds")
    return number


def drop_folded(spark: SparkSession, path: str) -> int:
    """Deletes the event files that the last fold stands for, and earlier folds; to be run when no reader is at work. -> files deleted."""
    fold, files = _last_fold(_folds(spark, path))
    if fold is None:
        return 0
    names = {r["_file"] for r in files.collect()}
    there = [f for f in spark.read.schema(JOB_EVENT).parquet(path).inputFiles() if unquote(f.rsplit("/", 1)[-1]) in names]
    for target in [*there, *(f"{path}.folded/fold={n}" for n in range(fold))]:
        remove(spark, target)
    return len(there)


def state_of_event(status: str = "status") -> Column:
    """An event's effect on its job: progress of any kind means running."""
    s = F.col(status)
    return F.when(s.isin("queued", *FINAL), s).otherwise("running")


def latest_states(events: DataFrame) -> DataFrame:
    """(job_id, status, current_step, created_at, last_event): one row a job. Partial aggregates meet, so a job with most events is no hot task."""
    order = F.col("id")
    step = F.when(F.col("status") == "completed", "export").otherwise(F.col("step"))
    return events.groupBy("job_id").agg(F.max_by(state_of_event(), order).alias("status"), F.max_by(step, order).alias("current_step"), F.min("created_at").alias("created_at"), F.max("id").alias("last_event"))


def events_of(events: DataFrame, job_id: str) -> DataFrame:
    return events.filter(F.col("job_id") == job_id).orderBy("id")


def recent(jobs: DataFrame, limit: int = 50) -> DataFrame:
    if not 1 <= limit <= 200:
        raise ValueError("limit must be from 1 to 200")
    return jobs.orderBy(F.desc("created_at"), "job_id").limit(limit)


def dashboard(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count(F.lit(1)).alias("jobs"), F.count(F.when(F.col("status") == "completed", 1)).alias("completed"), F.count(F.when(F.col("status") == "running", 1)).alias("running"), F.coalesce(F.sum("lead_count"), F.lit(0)).alias("leads"))


def with_lead_count(jobs: DataFrame, result: str = "result_json") -> DataFrame:
    """lead_count from a result document's list of companies; 0 where there is none."""
    shape = "struct<companies:array<struct<company_name:string>>>"
    return jobs.withColumn("lead_count", F.coalesce(F.nullif(F.size(F.from_json(F.col(result), shape)["companies"]), F.lit(-1)), F.lit(0)))
