"""Prefix trie of conversations, rolled up by running sums.

A node is a distinct sequence of first turns; its key is a digest of them. Three things could depend on depth or on a hot
group, and none does:

- *Running sums.* Rows are ranged into partitions by conversation and order. One pass tells how each partition ends, a row
  each; the next adds up, beginning with what partitions before hold of the same conversation, so that a conversation of any
  length is spread over tasks. Turns get their places so.
- *Digests.* A turn's digest covers its place, and the digest of turns 0..i is the sum of theirs, in two lanes of 64 bits: a
  running sum, whatever the length. The sum before a turn is its parent's key.
- *Sums.* The nodes whose smallest member is one conversation are a path, from where it leaves smaller conversations down
  to its end. Paths hang on nodes of other paths. Sums of whole paths with all that hangs on them double their reach
  each round; how many rounds depends on how often paths hang on each other, not on the length of conversations. A
  node's sum is then a running sum along its path, from the end.

The ids that end in a node are ranged too, joined to texts of ``RUN`` ids, and these are hashed one after another, so that a
node of any size costs constant memory.

Cases: rows without a conversation id are dropped. A null turn comes first; rows of one turn go by role, then by the digest
of role and text; repeated rows are turns of their own. Null roles and texts are empty. Groups of conversations are counted
downwards for negative ids, too. Long texts count whole, as digests. Other columns are ignored. An empty table has no root and
gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_table_sql, crc32_sql, cut_lineage, table

#: Conversations that share a head, and the most turns of it.
GROUP, HEADS = 20, 4
#: Ids in one text on the way to a node's hash.
RUN = 512
#: Stands for the digest of no turns.
ROOT = b"root"
WORD = r"[^\x20\x09-\x0D]+"


def digest(c: Column) -> Column:
    """128 bits of SHA-256."""
    return F.unhex(F.substring(F.sha2(c, 256), 1, 32))


def running(rows: DataFrame, order: list[str], keep: list[str], sums: list[str]) -> DataFrame:
    """``keep`` (with conv) and, for each of ``sums``, its sum over the conversation's rows in ``order`` up to this one, and before it (``_before``), modulo 2^64."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = cut_lineage(ranged.select(*keep, *sums, F.spark_partition_id().alias("part")))

    def added(batches, begun):
        """Batches with their conversations and running sums."""
        last, total = None, None
        for batch in batches:
            conv = batch.column("conv").to_numpy()
            if not len(conv):
                continue
            if total is None:
                last, total = begun.get(batch.column("part")[0].as_py(), (None, np.zeros(len(sums), np.int64)))
            starts = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
            lengths = np.diff(np.append(starts, len(conv)))
            each, found = [batch.column(c).to_numpy() for c in sums], []
            for i, values in enumerate(each):
                up_to = np.cumsum(values)
                up_to -= np.repeat(up_to[starts] - values[starts], lengths)
                if conv[0] == last:
                    up_to[: lengths[0]] += total[i]
                found.append(up_to)
            last, total = conv[-1], np.array([up_to[-1] for up_to in found])
            yield batch, each, found

    def ends_of(batches):
        end = None
        for batch, _, found in added(batches, {}):
            end = batch.column("part")[0].as_py(), batch.column("conv")[-1].as_py(), [int(up_to[-1]) for up_to in found]
        if end:
            yield pa.RecordBatch.from_arrays([pa.array([end[0]], pa.int32()), pa.array([end[1]], pa.int64()), pa.array([end[2]], pa.list_(pa.int64()))], names=["part", "conv", "sums"])

    # One row for each partition.
    told = ranged.select("part", "conv", *sums).mapInArrow(ends_of, "part int, conv long, sums array<long>").collect()
    begun, last, total = {}, None, np.zeros(len(sums), np.int64)
    for end in sorted(told, key=lambda r: r["part"]):
        begun[end["part"]] = last, total
        total = np.array(end["sums"], np.int64) + (total if end["conv"] == last else 0)
        last = end["conv"]

    def sum_up(batches):
        for batch, each, found in added(batches, begun):
            both = [pa.array(x) for values, up_to in zip(each, found, strict=True) for x in (up_to, up_to - values)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *both], names=names)

    names = [*keep, *(c + end for c in sums for end in ("", "_before"))]
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in ranged.select(*keep).schema] + [f"{c} long" for c in names[len(keep) :]]
    return ranged.mapInArrow(sum_up, ", ".join(kinds))


def turns_in_place(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text -> (conv, at, key, words): each turn's place from 0, its digest and number of words."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    row_key = digest(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    short = rows.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), row_key.alias("key"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"), F.lit(1).cast("long").alias("turns"))
    return running(cut_lineage(short), ["conv", "turn", "role", "key"], ["conv", "key", "words"], ["turns"]).select("conv", F.col("turns_before").alias("at"), "key", "words")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, at, key, words) -> the rebuilt conversations' turns (conv, at, n, key, words), and (conv, n) of all, turnless ones too."""
    known = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("own"))
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS
    known = known.select("conv", "own", head.alias("head"), (F.col("conv") - F.pmod("conv", F.lit(GROUP))).alias("first"))
    sizes = known.select(F.col("conv").alias("first"), F.least("own", F.lit(HEADS)).alias("has"))
    known = known.join(sizes, "first", "left").withColumn("has", F.least("head", F.coalesce("has", F.lit(0))))
    known = cut_lineage(known.withColumn("n", F.col("has") + F.greatest(F.col("own") - F.col("head"), F.lit(0))))
    own = turns.join(known, "conv").filter("at >= head").select("conv", (F.col("at") - F.col("head") + F.col("has")).alias("at"), "n", "key", "words")
    heads = turns.filter(F.col("at") < HEADS - 1).withColumnRenamed("conv", "first")  # three rows a conversation, for twenty of them
    lent = known.join(heads, "first").filter("at < head").select("conv", "at", "n", "key", "words")
    return own.unionByName(lent), known.select("conv", "n")


def prefix_digests(rows: DataFrame) -> DataFrame:
    """(conv, at, n, key, words) -> the same with the digest of all turns up to this one as key, and of those before as up."""
    placed = F.sha2(F.concat(F.col("at").cast("string").cast("binary"), F.lit(b":"), "key"), 256)
    lanes = [F.conv(F.substring(placed, first, 15), 16, 10).cast("long").alias(c) for c, first in (("low", 1), ("high", 16))]
    summed = running(cut_lineage(rows.select("conv", "at", "n", "words", *lanes)), ["conv", "at"], ["conv", "at", "n", "words"], ["low", "high"])
    key, up = (F.unhex(F.concat(*(F.lpad(F.hex(c + end), 16, "0") for c in ("low", "high")))) for end in ("", "_before"))
    return summed.select("conv", "at", "n", "words", key.alias("key"), F.when(F.col("at") == 0, F.lit(ROOT)).otherwise(up).alias("up"))


def sums_below(nodes: DataFrame, least: int | None) -> DataFrame:
    """nodes (conv_id, depth, parent_conv_id, leaves, saved, ...) with leaves and saved over each node's subtree. least: the root's conv_id."""
    hangs = F.col("parent_conv_id") != F.col("conv_id")
    tops = [F.max(F.when(hangs, c)).alias(name) for c, name in ((F.col("parent_conv_id"), "on"), (F.col("depth") - 1, "place"))]
    paths = nodes.groupBy(F.col("conv_id").alias("path")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), *tops)
    # The root's path hangs on none, so that nothing need point to it, on which most paths hang.
    state = cut_lineage(paths.withColumn("up", F.when(F.col("on") != F.lit(least).cast("long"), F.col("on"))))
    while not state.filter("up IS NOT NULL").isEmpty():
        given = state.filter("up IS NOT NULL").groupBy(F.col("up").alias("path")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        further = state.filter("up IS NOT NULL").select(F.col("path").alias("up"), F.col("up").alias("next"))
        met = state.join(given, "path", "left").join(further, "up", "left")
        state = cut_lineage(met.select("path", F.col("next").alias("up"), "on", "place", (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved")))
    hung = state.filter("on IS NOT NULL").groupBy(F.col("on").alias("conv_id"), F.col("place").alias("depth")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    own = nodes.join(hung, ["conv_id", "depth"], "left").withColumn("leaves", F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).withColumn("saved", F.col("saved") + F.coalesce("more_saved", F.lit(0)))
    keep = [c for c in nodes.columns if c not in ("conv_id", "leaves", "saved")]
    return running(cut_lineage(own.withColumn("conv", F.col("conv_id")).withColumn("from_end", -F.col("depth"))), ["conv", "from_end"], ["conv", *keep], ["leaves", "saved"]).withColumnRenamed("conv", "conv_id")


def ends(members: DataFrame) -> DataFrame:
    """(node, conv) -> (node, ends_sha256): the hash of its ids, ascending, joined by commas."""

    def join(batches):
        node, held, first = None, [], 0
        for batch in batches:
            nodes, found = [], []
            for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key != node or len(held) == RUN:
                    if held:
                        nodes.append((node, first))
                        found.append(",".join(held))
                    node, held, first = key, [], conv
                held.append(str(conv))
            yield packed(nodes, found)
        if held:
            yield packed([(node, first)], [",".join(held)])

    def packed(nodes, found):
        return pa.RecordBatch.from_arrays([pa.array([n for n, _ in nodes], pa.binary()), pa.array([f for _, f in nodes], pa.int64()), pa.array(found, pa.string())], names=["node", "first", "ids"])

    def hashed(batches):
        node, state = None, None
        for batch in batches:
            nodes, found = [], []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key != node:
                    if state:
                        nodes.append(node)
                        found.append(state.hexdigest())
                    node, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(found, pa.string())], names=["node", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["node", "ends_sha256"])

    runs = members.select("node", "conv").repartitionByRange("node", "conv").sortWithinPartitions("node", "conv").mapInArrow(join, "node binary, first long, ids string")
    return runs.repartition("node").sortWithinPartitions("node", "first").select("node", "ids").mapInArrow(hashed, "node binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    root, zero = F.lit(ROOT), F.lit(0).cast("long")
    rows, known = rebuilt(turns_in_place(conversations))
    least = known.agg(F.min("conv")).first()[0]
    prefixes = prefix_digests(rows)
    nodes = prefixes.groupBy(F.col("key").alias("node")).agg((F.first("at") + 1).alias("depth"), F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("words").alias("words"), F.first("up").alias("up"))
    top = known.groupBy().agg(root.alias("node"), zero.alias("depth"), F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), zero.alias("words"), F.lit(None).cast("binary").alias("up"))
    nodes = cut_lineage(nodes.unionByName(top.filter("n_convs > 0")))
    children = nodes.filter("depth > 0").groupBy(F.col("up").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.filter("depth > 0").select(F.col("node").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    parent = F.when(F.col("depth") == 1, F.lit(least).cast("long")).otherwise(F.col("parent_conv_id"))
    n_children = F.coalesce("n_children", F.lit(0)).cast("long")
    linked = nodes.join(children, "node", "left").join(parents, "up", "left")
    linked = cut_lineage(linked.select("node", "conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", n_children.alias("n_children"), (n_children == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved")))
    ended = ends(prefixes.filter("at + 1 = n").select(F.col("key").alias("node"), "conv").unionByName(known.filter("n = 0").select(root.alias("node"), "conv")))
    out = sums_below(linked, least).join(ended, "node", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


ORACLE = f"""
WITH crc_table AS ({crc_table_sql()}),
turns AS (SELECT conv_id AS conv, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), text) - 1 AS place FROM conversations WHERE conv_id IS NOT NULL),
known AS (SELECT conv, conv - ((conv % {GROUP}) + {GROUP}) % {GROUP} AS first, {crc32_sql("CAST(conv AS VARCHAR)")} % {HEADS} AS head FROM (SELECT DISTINCT conv FROM turns), crc_table),
laid AS (SELECT k.conv, 0 AS own, t.place, t.role, t.text FROM known k JOIN turns t ON t.conv = k.first AND t.place < k.head
  UNION ALL SELECT k.conv, 1, t.place, t.role, t.text FROM known k JOIN turns t USING (conv) WHERE t.place >= k.head),
prefixes AS (SELECT conv, row_number() OVER w AS depth, sha256(string_agg(length(role) || ':' || length(text) || ':' || role || text, '') OVER w) AS node, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words FROM laid WINDOW w AS (PARTITION BY conv ORDER BY own, place)),
members AS (SELECT conv, depth, node, words FROM prefixes UNION ALL SELECT conv, 0, '', 0 FROM known),
lengths AS (SELECT conv, max(depth) AS n FROM members GROUP BY conv),
nodes AS (SELECT node, min(depth) AS depth, min(conv) AS conv_id, count(*) AS n_convs, min(words) AS words FROM members GROUP BY node),
linked AS (SELECT n.*, p.node AS up, u.conv_id AS parent_conv_id FROM nodes n LEFT JOIN members p ON p.conv = n.conv_id AND p.depth = n.depth - 1 LEFT JOIN nodes u ON u.node = p.node),
children AS (SELECT up AS node, count(*) AS n_children FROM linked WHERE up IS NOT NULL GROUP BY up),
own AS (SELECT l.*, coalesce(c.n_children, 0) AS n_children FROM linked l LEFT JOIN children c USING (node)),
sums AS (SELECT m.node, sum(CASE WHEN o.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((o.n_convs - 1) * o.words) AS saved_tokens FROM own o JOIN members m ON m.conv = o.conv_id AND m.depth <= o.depth GROUP BY m.node),
ended AS (SELECT m.node, sha256(string_agg(CAST(m.conv AS VARCHAR), ',' ORDER BY m.conv)) AS ends_sha256 FROM members m JOIN lengths l ON l.conv = m.conv AND l.n = m.depth GROUP BY m.node)
SELECT o.conv_id, CAST(o.depth AS BIGINT) AS depth, o.parent_conv_id, o.n_convs, CAST(o.n_children AS BIGINT) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM own o JOIN sums s USING (node) LEFT JOIN ended e USING (node)
"""
