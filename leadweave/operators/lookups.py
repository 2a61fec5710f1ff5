"""Lookups with a memory: a key is asked for once, whatever the answer, and never again by a later run.

The memory is a table of (key, answer, run), appended to by runs; an answer may be null, which says that the source has
none. A run asks for the keys that it needs and the memory lacks, each once however many rows need it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.extract import first_director, gstin, slab_label
from ..functions.text import strip
from ..plans.settings import Settings, throttled
from .lineage import cut_lineage, folder_exists

Ask = Callable[[DataFrame], DataFrame]


def ask_recorded(table: DataFrame, key: str) -> Ask:
    """Answers from a recorded table: the first row, by its values, of each key."""
    names = [c for c in table.columns if c != key]
    first = table.groupBy(F.col(key).alias("key")).agg(F.min(F.struct(*names)).alias("answer"))
    return lambda keys: keys.join(first, "key")


def ask_live(answer: Callable[[str], dict | None], shape: str, settings: Settings | None = None) -> Ask:
    """Answers from a function called for one key after another, in each partition at the pace of the settings.

    Rows are dealt to as many partitions as may ask at once; the function runs on the executors.
    """
    pause = (settings or Settings()).lookup_pause

    def run(batches: Iterable[pd.DataFrame]):
        def keys():
            for frame in batches:
                yield from frame["key"]

        for key in throttled(keys(), pause):
            found = answer(key)
            if found is not None:
                yield pd.DataFrame({"key": [key], "answer": [found]})

    return lambda keys: keys.mapInPandas(run, StructType().add("key", "string").add("answer", StructType.fromDDL(shape)))


def remembered(memory_of: DataFrame, memory: str, shape: str) -> DataFrame:
    """(key, answer, run) of all that has been asked; of an answer that two runs have written at once, the earlier one."""
    spark = memory_of.sparkSession
    kind = StructType().add("key", "string").add("answer", StructType.fromDDL(shape)).add("run", "long")
    if not folder_exists(spark, memory):
        return spark.createDataFrame([], kind)
    rows = spark.read.schema(kind).parquet(memory)
    return rows.groupBy("key").agg(F.min_by(F.struct("answer", "run"), "run").alias("_r")).select("key", "_r.*")


def look_up(keys: DataFrame, memory: str, ask: Ask, shape: str, run: int) -> DataFrame:
    """(key, answer, run) for each distinct key of ``keys``; only keys that the memory lacks are asked for, and then remembered."""
    wanted = cut_lineage(keys.select(F.col("key").cast("string").alias("key")).filter("key <> ''").distinct())
    known = remembered(keys, memory, shape)
    unknown = cut_lineage(wanted.join(known, "key", "left_anti"))
    if not unknown.isEmpty():
        answers = ask(unknown).select("key", "answer")
        new = unknown.join(answers, "key", "left").select("key", F.col("answer").cast(StructType.fromDDL(shape)).alias("answer"), F.lit(run).cast("long").alias("run"))
        new.write.mode("append").parquet(memory)
    return wanted.join(remembered(keys, memory, shape), "key", "left")


def answered(found: DataFrame, key: str) -> DataFrame:
    """The answers that there are, as a lookup table of enrich()."""
    return found.filter("answer IS NOT NULL").select(F.col("key").alias(key), "answer.*")


def registry_rows(documents: DataFrame, cin: str = "cin", document: str = "document") -> DataFrame:
    """(cin, address, gst, contact_person, designation) from recorded registry documents: JSON with an address, a number and directors."""
    director = first_director(F.get_json_object(document, "$.directors"))

    def text(path: str) -> Column:
        return F.nullif(strip(F.get_json_object(document, path)), F.lit(""))

    return documents.select(F.upper(strip(cin)).alias("cin"), text("$.address").alias("address"), gstin(text("$.gst")).alias("gst"), director["name"].alias("contact_person"), director["designation"].alias("designation"))


def gst_rows(found_text: DataFrame, name: str = "name", text: str = "text") -> DataFrame:
    """(name, gst): the first number with a right check sign in the texts found for a name; names without one are left out."""
    return found_text.select(F.col(name).alias("name"), gstin(text).alias("gst")).filter("gst IS NOT NULL")


def slab_rows(pages: DataFrame, gst: str = "gst", text: str = "text") -> DataFrame:
    """(gst, slab): the turnover slab that a page about a number names."""
    return pages.select(F.upper(strip(gst)).alias("gst"), slab_label(text).alias("slab")).filter("slab IS NOT NULL")
