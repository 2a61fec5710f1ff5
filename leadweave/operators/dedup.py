"""Removing duplicates where the order of rows decides: ``seq`` is that order."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from .greedy import greedy_distinct
from .lineage import cut_lineage

__all__ = ["batches", "best_by_name", "components", "first_by", "first_by_name", "first_by_name_and_website", "greedy_distinct", "numbered"]


def _field(c: str) -> Column:
    return F.lower(strip(F.coalesce(F.col(c), F.lit(""))))


def first_by(df: DataFrame, keys: list[Column], seq: str = "seq") -> DataFrame:
    """The first row of each key. A grouped minimum over whole rows: equal keys meet after a partial aggregation, so a hot key is no hot task."""
    row = F.struct(F.col(seq), *[F.col(c) for c in df.columns if c != seq])
    picked = df.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min_by(row, F.col(seq)).alias("_row"))
    return picked.select([F.col(f"_row.{c}").alias(c) for c in df.columns])


def first_by_name_and_website(df: DataFrame, name: str = "company_name", website: str = "website", seq: str = "seq") -> DataFrame:
    return first_by(df, [_field(name), _field(website)], seq)


def first_by_name(df: DataFrame, name: str = "company_name", seq: str = "seq") -> DataFrame:
    return first_by(df, [_field(name)], seq)


def best_by_name(df: DataFrame, name: str = "company_name", website: str = "website", seq: str = "seq") -> DataFrame:
    """The first row with a website, else the first row, of each name, at the place where the name is first seen."""
    row = F.struct(*[F.col(c) for c in df.columns])
    best = df.groupBy(F.col(name).alias("_name")).agg(F.min_by(row, F.struct(F.col(website).isNull(), F.col(seq))).alias("_row"), F.min(seq).alias("_first"))
    return best.select([F.col("_first").alias(c) if c == seq else F.col(f"_row.{c}").alias(c) for c in df.columns])


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) of long nodes -> (node, root): root is the least node of the connected component.

    Alternates the large-star and small-star steps, whose number grows with the logarithm of the nodes. Each is a
    grouped minimum and a join on the same key; the edges never grow in number by more than a constant factor.
    """
    edges = cut_lineage(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut_lineage(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = state(edges)
        if now == before:
            break
        before = now
    rooted = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return rooted.unionByName(rooted.select(F.col("root").alias("node"), "root").distinct())


def numbered(df: DataFrame, *order: str, seq: str = "seq") -> DataFrame:
    """``seq`` from 0 in the given order, without moving all rows to one task.

    Rows are ranged into partitions by the order, counted there, and numbered from the sum of the counts before.
    """
    ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    ranged = cut_lineage(ranged.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1))
    counts = {r["_part"]: r["n"] for r in ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, total = [], 0
    for part in sorted(counts):
        starts.append((part, total))
        total += counts[part]
    offsets = df.sparkSession.createDataFrame(starts, "_part int, _start long")
    return ranged.join(F.broadcast(offsets), "_part").withColumn(seq, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def batches(df: DataFrame, n: int) -> Iterator[DataFrame]:
    """Round-robin parts by ``seq``; ordering their union by it restores the order."""
    for i in range(n):
        yield df.filter(F.pmod("seq", F.lit(n)) == i)
