"""Values to the first band that holds them, for any number of bands, which may overlap.

The bands' ends cut the line into intervals, numbered in order. A band is the sum of few runs of intervals, each as long as a
power of two and beginning at a multiple of it, so that the band that wins an interval is the least of those filed under the
runs around it: joins by equality, and as many rows as bands times the logarithm of their number, however much they overlap.
Values then take the last end at or before them: values and ends are ranged together, ends first, and filled forward in each
partition; what the partitions before hand on is one row each. Equal values may go to different partitions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dedup import numbered
from .lineage import cut_lineage


def _levels(most: int) -> int:
    return max(1, most).bit_length()


def winners(bands: DataFrame) -> DataFrame:
    """(band, ord, low, high) -> (edge, band): the band of least order from each end up to the next; null where there is none.

    low is in, high is not; null ends are open. Bands that hold nothing count for nothing.
    """
    sides = bands.select("band", "ord", F.coalesce(F.col("low").cast("double"), F.lit(float("-inf"))).alias("low"), F.coalesce(F.col("high").cast("double"), F.lit(float("inf"))).alias("high")).filter("low < high AND NOT isnan(low) AND NOT isnan(high)")
    ends = sides.select(F.col("low").alias("edge")).union(sides.select("high")).distinct()
    ends = cut_lineage(numbered(ends, "edge", seq="at"))
    levels = _levels(ends.count())
    placed = sides.join(ends.select(F.col("edge").alias("low"), F.col("at").alias("a")), "low").join(ends.select(F.col("edge").alias("high"), F.col("at").alias("b")), "high")

    def shift(name, c, k):
        return F.call_function(name, c, k)

    def runs(k):
        one = shift("shiftleft", F.lit(1).cast("long"), k)
        first, end = shift("shiftright", F.col("a") + one - 1, k), shift("shiftright", F.col("b"), k)
        left = F.when((first < end) & (first % 2 == 1), F.struct(k.alias("level"), first.alias("run")))
        right = F.when((first < end) & (end % 2 == 1), F.struct(k.alias("level"), (end - 1).alias("run")))
        return F.array(left, right)

    steps = F.sequence(F.lit(0), F.lit(levels))
    every = F.filter(F.flatten(F.transform(steps, runs)), lambda r: r.isNotNull())
    filed = placed.select("band", "ord", F.explode(F.array_distinct(every)).alias("r")).groupBy("r.level", "r.run").agg(F.min(F.struct("ord", "band")).alias("best"))
    around = ends.select("edge", F.explode(F.transform(steps, lambda k: F.struct(k.alias("level"), shift("shiftright", F.col("at"), k).alias("run")))).alias("r")).select("edge", "r.*")
    best = around.join(filed, ["level", "run"], "left").groupBy("edge").agg(F.min("best").alias("best"))
    return best.select("edge", F.col("best.band").alias("band"))


def last_before(rows: DataFrame, marks: DataFrame, value: str, mark: str, payload: str) -> DataFrame:
    """``rows`` with the ``payload`` (text) of the greatest mark at or before their value; null before the first, and for null and NaN."""
    v = F.col(value).cast("double")
    left = rows.select(F.struct("*").alias("_row"), F.when(~F.isnan(v), v).alias("_v"), F.lit(1).alias("_kind"), F.lit(None).cast("string").alias("_p"))
    right = marks.select(F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), F.col(mark).cast("double").alias("_v"), F.lit(0).alias("_kind"), F.col(payload).alias("_p"))
    # Rows of one value are spread by their contents; marks come before them.
    order = ["_v", "_kind", "_spread"]
    both = cut_lineage(left.withColumn("_spread", F.xxhash64(F.to_json("_row"), F.monotonically_increasing_id())).unionByName(right.withColumn("_spread", F.lit(0).cast("long"))))
    ranged = both.repartitionByRange(*order).sortWithinPartitions(*order)

    def fill(batches):
        part, last, known, row = TaskContext.get().partitionId(), None, False, None
        for batch in batches:
            marked = batch.column("_kind").to_numpy() == 0
            at = np.maximum.accumulate(np.where(marked, np.arange(len(marked)), -1))
            column = pa.concat_arrays([pa.array([last], pa.string()), batch.column("_p").cast(pa.string())]).take(pa.array(at + 1))
            have = (at >= 0) | known
            if len(have):
                last, known, row = column[-1].as_py(), bool(have[-1]), batch.column("_row").slice(0, 1)
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("_kind"), column, pa.array(have), pa.array(np.full(len(at), part), pa.int32())], names=names)
        if known:
            yield pa.RecordBatch.from_arrays([row, pa.array([2], pa.int32()), pa.array([last], pa.string()), pa.array([True]), pa.array([part], pa.int32())], names=names)

    names = ["_row", "_kind", "_p", "_have", "_part"]
    kind = left.schema["_row"].dataType.simpleString()
    filled = cut_lineage(ranged.select("_row", "_kind", "_p").mapInArrow(fill, f"_row {kind}, _kind int, _p string, _have boolean, _part int"))
    # What each partition ends with, one row each; a partition opens with the end of the last one before it that has marks.
    ends = {r["_part"]: r["_p"] for r in filled.filter("_kind = 2").select("_part", "_p").collect()}
    last_part = filled.agg(F.max("_part")).first()[0]
    opening, now = [], None
    for part in range(0 if last_part is None else last_part + 1):
        opening.append((part, now))
        now = ends.get(part, now)
    parts = rows.sparkSession.createDataFrame(opening, "_part int, _open string")
    found = F.when(F.col("_have"), F.col("_p")).otherwise(F.col("_open"))
    return filled.filter("_kind = 1").join(F.broadcast(parts), "_part", "left").select("_row.*", found.alias(payload))


def first_band(rows: DataFrame, bands: DataFrame, value: str) -> DataFrame:
    """``rows`` with ``band``: of the bands (band, ord, low, high) that hold the value the one of least order."""
    return last_before(rows, winners(bands), value, "edge", "band")
