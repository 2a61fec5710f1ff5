"""Greedy distinctness: in order of ``seq``, a row is kept if it shares no key with a row kept before.

Four ways, each for what the one before is slow at:

- *Firsts.* Rows that come first in all of their keys are kept, and what shares a key with them goes. Grouped minima and
  joins by key; where the order of rows is no long chain, this settles most rows in every round.
- *Conditions.* Ranges of ``seq`` are read at once, each by one task that does not know what the ranges before it take. Rows whose
  answer hangs on one such unknown follow it or its opposite; a row that both a thing and its opposite block is dropped. What a
  range says about its keys at its end defines the unknowns of later ranges. If there are few of these, one task solves them
  in order, and all rows have their answers: two passes, whatever the length of chains. Rows move once, into their ranges; the
  keys that several ranges hold come to them.
- *Chains.* Where rows of far ranges hang together, a row whose only undecided forerunner is one row is kept if and only if that one is not. Such rows point to their
  forerunners; pointers that double their reach, and carry whether they have turned the answer an odd number of times,
  settle a chain of any length in a number of rounds that grows with its logarithm.
- *Sweep.* What is left depends on several forerunners at every step, so that nothing but order decides it. Rows are cut
  into ranges of ``seq``; the ranges are settled one after another, and each hands on, to the later ranges that hold them, the
  keys it has taken. A task holds the keys of one range, never those of a connected part. Ranges and keys lie in written
  tables, so that a lost executor repeats one range.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut_lineage, fresh_folder

#: Rounds of firsts or chains, the share of rows that a round must settle to be worth another of its kind, and the keys of a range.
ROUNDS, WORTH, RANGE_KEYS = 24, 0.25, 250_000
#: Firsts for each key below which conditions are tried at once.
FEW = 0.01


def greedy_distinct(df: DataFrame, keys: str = "keys", seq: str = "seq", rounds: int = ROUNDS, range_keys: int = RANGE_KEYS) -> DataFrame:
    """Rows in order of ``seq`` that share no key with a row kept before; a row that is dropped blocks nothing. Null keys are ignored; rows without keys are dropped."""
    left = cut_lineage(df.select(F.col(seq).alias("seq"), F.explode(keys).alias("key")).filter("key IS NOT NULL").distinct())
    size, kept, slow, tried = left.count(), [], False, False
    for _ in range(rounds):
        if not size:
            break
        found = None if slow and not tried else cut_lineage(chained(left) if slow else firsts(left))
        # Firsts that are this few hardly settle anything: what they block is not worth looking for before the conditions are tried.
        if not tried and (found is None or found.count() < FEW * size):
            tried, all_kept = True, conditional(left, math.ceil(size / range_keys), range_keys)
            if all_kept is not None:
                kept.append(all_kept)
                size = 0
                break
        if found is None:
            found = cut_lineage(chained(left))
        kept.append(found)
        left = cut_lineage(without_blocked(left, found))
        before, size = size, left.count()
        if size > (1 - WORTH) * before:
            if slow:
                break
            slow = True
        else:
            slow = False
    if size:
        kept.append(swept(left, math.ceil(size / range_keys)))
    if not kept:
        return df.limit(0)
    chosen = kept[0]
    for part in kept[1:]:
        chosen = chosen.unionByName(part)
    return df.join(chosen.withColumnRenamed("seq", seq), seq, "left_semi")


def firsts(left: DataFrame) -> DataFrame:
    """(seq) of the rows that come first in all of their keys."""
    least = left.groupBy("key").agg(F.min("seq").alias("least"))
    return left.join(least, "key").groupBy("seq").agg(F.bool_and(F.col("seq") == F.col("least")).alias("first")).filter("first").select("seq")


def without_blocked(left: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows that share no key with a kept row; kept rows go, too."""
    taken = left.join(kept, "seq", "left_semi").select("key").distinct()
    gone = left.join(taken, "key", "left_semi").select("seq").distinct()
    return left.join(gone, "seq", "left_anti")


#: What a range says: rows that are kept (no node), rows that follow a node or its opposite, and the nodes' definitions.
SAID = "block int, place long, seq long, node string, odd boolean, op string, blockers array<string>"
#: Conditions of a key beyond which they become a node of their own.
CONDITIONS = 4


def conditional(left: DataFrame, ranges: int, most: int) -> DataFrame | None:
    """(seq) of the rows kept; None if the ranges hang together by more than ``most`` definitions."""
    rows = cut_lineage(left.repartitionByRange(ranges, "seq").sortWithinPartitions("seq").withColumn("block", F.spark_partition_id()))
    spread = cut_lineage(rows.groupBy("key").agg(F.min("block").alias("a"), F.max("block").alias("b")).filter("a < b").select("key"))
    # Each key of several ranges is defined by all of them but the last, so that what is broadcast here is bounded by ``most``.
    if spread.count() > most:
        return None
    held = rows.join(F.broadcast(spread), "key", "left_semi").select("key", "block").distinct()
    around = Window.partitionBy("key").orderBy("block")
    held = cut_lineage(held.select("key", "block", F.lag("block").over(around).alias("before"), F.lead("block").over(around).isNotNull().alias("later")))
    if held.filter("later").count() > most:
        return None
    # Rows stay where they are: a range is a partition, in order of seq.
    marked = rows.join(F.broadcast(held), ["key", "block"], "left").select("block", "seq", "key", "before", F.coalesce("later", F.lit(False)).alias("later"))
    said = cut_lineage(marked.mapInArrow(_under_conditions, SAID))
    definitions = said.filter("op IS NOT NULL").select("block", "place", "node", "op", "blockers")
    if definitions.count() > most:
        return None
    solved = cut_lineage(definitions.repartition(1).sortWithinPartitions("block", "place").mapInArrow(_solved, "node string, holds boolean"))
    rows = said.filter("seq IS NOT NULL")
    hang = rows.filter("node IS NOT NULL").join(F.broadcast(solved), "node").filter("holds <> odd").select("seq")
    return rows.filter("node IS NULL").select("seq").unionByName(hang)


class _Range:
    """The rows of one range in order. A condition is a node with a sign: ``+`` as it is, ``-`` its opposite; a key that is taken for sure has None."""

    def __init__(self, block: int):
        self.block, self.keys, self.later, self.out = block, {}, set(), []

    def define(self, node: str, op: str, blockers: list[str]) -> None:
        self.out.append((self.block, len(self.out), None, node, None, op, blockers))

    def follow(self, seq: int, node: str | None, odd: bool) -> None:
        self.out.append((self.block, len(self.out), seq, node, odd, None, None))

    def row(self, seq: int, held: list[tuple[str, int | None, bool]]) -> None:
        blockers: set[str] | None = set()
        for key, before, later in held:
            if later:
                self.later.add(key)
            if key not in self.keys:
                self.keys[key] = frozenset() if before is None else frozenset([f"+{before}:{key}"])
            known = self.keys[key]
            blockers = None if known is None or blockers is None else blockers | known
        if blockers is None or self.always(blockers):
            return self.taken([k for k, _, _ in held], frozenset())
        if not blockers:
            self.follow(seq, None, False)
            for key, _, _ in held:
                self.keys[key] = None
            return None
        if len(blockers) == 1:
            (one,) = blockers
            self.follow(seq, one[1:], one[0] == "+")
            return self.taken([k for k, _, _ in held], frozenset([("-" if one[0] == "+" else "+") + one[1:]]))
        self.define(f"row {seq}", "none", sorted(blockers))
        self.follow(seq, f"row {seq}", False)
        return self.taken([k for k, _, _ in held], frozenset([f"+row {seq}"]))

    def taken(self, keys: list[str], by: frozenset[str]) -> None:
        """The keys are taken if they were, or under this condition."""
        for key in keys:
            known = self.keys[key]
            if known is None or not by:
                continue
            known = known | by
            if self.always(known):
                known = None
            elif len(known) > CONDITIONS:
                node = f"some {self.block}:{len(self.out)}"
                self.define(node, "some", sorted(known))
                known = frozenset([f"+{node}"])
            self.keys[key] = known

    @staticmethod
    def always(conditions) -> bool:
        return len(conditions) > 1 and any(c[0] == "+" and "-" + c[1:] in conditions for c in conditions)

    def told(self) -> list[tuple]:
        for key in sorted(self.later):
            known = self.keys[key]
            self.define(f"{self.block}:{key}", "sure" if known is None else "some", sorted(known or ()))
        return self.out


def _under_conditions(batches):
    """Reads ranges, which come sorted by block and seq. -> what they say."""
    here, row, held = None, None, []
    for batch in batches:
        for block, seq, key, before, later in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if here is None or seq != row or block != here.block:
                if held:
                    here.row(row, held)
                row, held = seq, []
            if here is None or block != here.block:
                if here is not None:
                    yield _said(here.told())
                here = _Range(block)
            held.append((key, before, later))
    if here is not None:
        here.row(row, held)
        yield _said(here.told())


def _said(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.list_(pa.string())]
    columns = zip(*out, strict=True) if out else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["block", "place", "seq", "node", "odd", "op", "blockers"])


def _solved(batches):
    """The value of each node, in order: a node's definition names only nodes before it."""
    holds: dict[str, bool] = {}
    for batch in batches:
        nodes = batch.column(2).to_pylist()
        for node, op, blockers in zip(nodes, batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
            some = op == "sure" or any(holds[b[1:]] == (b[0] == "+") for b in blockers)
            holds[node] = some != (op == "none")
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.string()), pa.array([holds[n] for n in nodes], pa.bool_())], names=["node", "holds"])


def forerunners(left: DataFrame) -> DataFrame:
    """(seq, free, to): free rows have no forerunner; ``to`` is the only forerunner of a row that has just one."""
    ranked = left.join(left.groupBy("key").agg(F.min("seq").alias("least")), "key")
    second = ranked.filter("seq > least").groupBy("key").agg(F.min("seq").alias("second"))
    ranked = ranked.join(second, "key", "left")
    first = F.col("seq") == F.col("least")
    rows = ranked.groupBy("seq").agg(
        F.bool_and(first).alias("free"),
        F.bool_or(F.col("seq") > F.col("second")).alias("later"),
        F.min(F.when(~first, F.col("least"))).alias("low"),
        F.max(F.when(~first, F.col("least"))).alias("high"),
    )
    one: Column = F.when(~F.coalesce("later", F.lit(False)) & (F.col("low") == F.col("high")), F.col("low"))
    return rows.select("seq", "free", one.alias("to"))


def chained(left: DataFrame) -> DataFrame:
    """(seq) of the free rows and of those that an even number of turns leads to a free row."""
    rows = cut_lineage(forerunners(left))
    state, moving = rows.filter("to IS NOT NULL").select("seq", "to", F.lit(True).alias("odd"), F.lit(False).alias("ends")), True
    while moving:
        # One grouping by place instead of a self-join: Spark's size estimate of a join is a product, which would be squared anew in each round.
        asks = state.filter("NOT ends").select(F.col("to").alias("at"), "seq", "odd", F.lit(None).cast("long").alias("next"), F.lit(None).cast("boolean").alias("more"))
        tells = state.select(F.col("seq").alias("at"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast("boolean").alias("odd"), F.col("to").alias("next"), F.col("odd").alias("more"))
        there = Window.partitionBy("at")
        met = asks.unionByName(tells).select("at", "seq", "odd", F.max("next").over(there).alias("next"), F.max("more").over(there).alias("more")).filter("seq IS NOT NULL")
        moved = met.select("seq", F.coalesce("next", "at").alias("to"), (F.col("odd") != F.coalesce("more", F.lit(False))).alias("odd"), F.col("next").isNull().alias("ends"))
        state = cut_lineage(state.filter("ends").unionByName(moved))
        moving = not state.filter("NOT ends").isEmpty()
    free = rows.filter("free").select("seq")
    return free.unionByName(state.filter("NOT odd").join(free.withColumnRenamed("seq", "to"), "to", "left_semi").select("seq"))


def _in_order(batches):
    """Settles the rows of one range, which come sorted by seq. -> (seq, key) of those kept."""
    taken: set[str] = set()
    row, keys = None, []

    def settled():
        if keys and taken.isdisjoint(keys):
            taken.update(keys)
            return [(row, k) for k in keys]
        return []

    for batch in batches:
        out = []
        for seq, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if seq != row:
                out += settled()
                row, keys = seq, []
            keys.append(key)
        yield _kept_keys(out)
    yield _kept_keys(settled())


def _kept_keys(pairs: list[tuple[int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.array([s for s, _ in pairs], dtype=np.int64)), pa.array([k for _, k in pairs], pa.string())], names=["seq", "key"])


def swept(left: DataFrame, ranges: int) -> DataFrame:
    """(seq) of the rows kept, range by range."""
    spark = left.sparkSession
    home = fresh_folder(spark, "sweep")
    left.repartitionByRange(ranges, "seq").withColumn("block", F.spark_partition_id()).write.partitionBy("block").parquet(f"{home}/rows")
    rows = spark.read.schema("seq long, key string, block int").parquet(f"{home}/rows")
    held = rows.select("key", "block").distinct()
    spread = held.groupBy("key").agg(F.min("block").alias("a"), F.max("block").alias("b")).filter("a < b").select("key")
    later = cut_lineage(held.join(spread, "key").withColumnRenamed("block", "target"))
    later.limit(0).write.partitionBy("target").parquet(f"{home}/handed")
    for block in range(ranges):
        own = rows.filter(F.col("block") == block).select("seq", "key")
        handed = spark.read.schema("key string, target int").parquet(f"{home}/handed").filter(F.col("target") == block).select("key")
        blocked = own.join(handed, "key", "left_semi").select("seq").distinct()
        ordered = own.join(blocked, "seq", "left_anti").repartition(1).sortWithinPartitions("seq")
        ordered.mapInArrow(_in_order, "seq long, key string").write.mode("overwrite").parquet(f"{home}/kept/block={block}")
        if block + 1 < ranges:
            now = spark.read.schema("seq long, key string").parquet(f"{home}/kept/block={block}")
            now.join(later.filter(F.col("target") > block), "key").select("key", "target").write.mode("append").partitionBy("target").parquet(f"{home}/handed")
    return spark.read.schema("seq long, key string").parquet(f"{home}/kept").select("seq").distinct()
