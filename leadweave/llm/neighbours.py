"""Approximate nearest neighbours by cross-polytope hashing, with exact reranking.

A table turns unit vectors by pseudo-random rotations (three rounds of random signs and a fast Hadamard transform) and puts
each in the bucket of its nearest signed axes, one of each rotation. The number of buckets grows with the rows, so that one
holds about ``BUCKET_ROWS`` of them. A query looks, in every table, into the buckets whose axes it is nearest to, as many as
hold about ``LOOKS`` rows in all, however many rows there are. The inner products of what it finds there with the original
vectors, in double precision, decide.

Neighbouring buckets make a shelf of about ``SHELF_ROWS`` rows, which is the shuffle key; rows go to their shelf in each
table, queries to the shelves they look into only. Shelves with more rows, or more queries, are split by a hash of the id.
Of equal vectors only the least ids can be among the nearest, and equal queries are searched for once, so that copies, in
whatever number, cost nothing. A query that finds fewer rows than asked for is compared to all rows, in blocks. Vectors of
different lengths are first put on a sphere by one more component, so that the largest inner product becomes the nearest;
that is left out where all lengths agree.

Cases: vectors that are null, all zero, or hold a null or a non-finite component, and such of another dimension than most,
take no part; nor do rows without an id. Of rows with the same id one counts, the one with the least vector. Ties go to
the smaller id. With fewer rows than asked for, all are returned. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage, table

TABLES = 8
#: Rows of a bucket, rows a query looks at (those met in several tables counted each time), rows and queries of one task.
BUCKET_ROWS, LOOKS = 24, 16_000
SHELF_ROWS, BLOCK_QUERIES = 65_536, 8192


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast transform of each row; the row length is a power of two."""
    n, d = x.shape
    step = 1
    while step < d:
        x = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        step *= 2
    return x


def rotations(dim: int, tables: int, seed: int = 0) -> np.ndarray:
    """Signs for three rounds in each table, for the next power of two."""
    return np.random.default_rng(seed).choice([-1.0, 1.0], size=(tables, 3, 1 << max(0, dim - 1).bit_length()))


def axes(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Each row's products with all signed axes after rotation: +1..+d, then -1..-d."""
    x = np.pad(x, ((0, 0), (0, signs.shape[1] - x.shape[1])))
    for s in signs:
        x = hadamard(x * s)
    return np.concatenate([x, -x], axis=1)


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) with finite, nonzero vectors of the usual dimension, one for each id."""
    v = F.col("v")
    ok = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0))
    ok = ok.groupBy("vec_id").agg(F.min("v").alias("v"))
    usual = ok.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return ok.filter(F.size("v") == (usual["d"] if usual else 0))


class Tables:
    """Which bucket a vector is in, and which ones a query looks into."""

    def __init__(self, dim: int, rows: int, tables: int, looks: int):
        self.width = 2 << max(0, dim - 1).bit_length()  # signed axes
        wanted, self.sizes = max(2.0, rows / BUCKET_ROWS), [self.width]
        while math.prod(self.sizes) < wanted:
            left = wanted / math.prod(self.sizes)
            self.sizes.append(min(self.width, 2 << max(0, math.ceil(math.log2(left)) - 1)))
        self.buckets = math.prod(self.sizes)
        self.probes = max(1, min(self.buckets, round(looks / tables / max(rows, 1) * self.buckets)))
        self.shelves = min(self.buckets, 1 << max(0, round(math.log2(max(rows, 1) / SHELF_ROWS))))
        self.signs = rotations(dim, tables * len(self.sizes)).reshape(tables, len(self.sizes), 3, -1)

    def products(self, x: np.ndarray, table: int) -> list[np.ndarray]:
        """With the signed axes of each rotation; only so many of them are used as it has buckets."""
        out = []
        for signs, size in zip(self.signs[table], self.sizes, strict=True):
            own = axes(x, signs)
            half = own.shape[1] // 2
            out.append(np.concatenate([own[:, : size // 2], own[:, half : half + size // 2]], axis=1))
        return out

    def homes(self, x: np.ndarray, table: int) -> np.ndarray:
        out = np.zeros(len(x), dtype=np.int64)
        for own, size in zip(self.products(x, table), self.sizes, strict=True):
            out = out * size + own.argmax(axis=1)
        return out

    def looks(self, x: np.ndarray, table: int) -> np.ndarray:
        """The buckets with the largest sums of products: of sums the best are sums of the best, so that few are formed."""
        best, codes = np.zeros((len(x), 1)), np.zeros((len(x), 1), dtype=np.int64)
        for own, size in zip(self.products(x, table), self.sizes, strict=True):
            sums = (best[:, :, None] + own[:, None, :]).reshape(len(x), -1)
            wide = (codes[:, :, None] * size + np.arange(size)).reshape(len(x), -1)
            if sums.shape[1] > self.probes:
                at = np.argpartition(-sums, self.probes - 1, axis=1)[:, : self.probes]
                sums, wide = np.take_along_axis(sums, at, axis=1), np.take_along_axis(wide, at, axis=1)
            best, codes = sums, wide
        return codes

    def shelf(self, table: int, code: np.ndarray) -> np.ndarray:
        return table * self.shelves + code * self.shelves // self.buckets


_FOUND = ["node", "vec_id", "score"]


def _matrix(column) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def best_of(queries: np.ndarray, rows: np.ndarray, which: np.ndarray, at: np.ndarray, near: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs (query, row) with their inner products, those of each query's k best by the exact product. -> query, row, product."""
    order = np.lexsort((-near, which))
    which, at, near = which[order], at[order], near[order]
    first = np.searchsorted(which, which)
    last = np.minimum(first + k - 1, np.searchsorted(which, which, side="right") - 1)
    keep = near >= near[last] - 1e-9 * np.abs(near[first]) if len(which) else np.zeros(0, bool)
    which, at = which[keep], at[keep]
    score = (rows[at] * queries[which]).sum(axis=1)  # the same order of additions for every row: equal vectors tie
    order = np.lexsort((ids[at], -score, which))
    which, at, score = which[order], at[order], score[order]
    keep = np.arange(len(which)) - np.searchsorted(which, which) < k
    return which[keep], at[keep], score[keep]


def _as_found(parts, nodes: np.ndarray, ids: np.ndarray) -> pa.Table:
    which, at, score = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return pa.table([pa.array(nodes[which], pa.int64()), pa.array(ids[at], pa.int64()), pa.array(score, pa.float64())], names=_FOUND)


def nearest(df: DataFrame, is_query, k: int, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES, looks: int = LOOKS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products found for each row that ``is_query`` (a condition on vec_id) marks."""
    rows = cut_lineage(usable(df, id_col, vector_col))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    few = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    held = cut_lineage(rows.withColumn("n", few).filter(F.col("n") <= k + 1).drop("n"))
    asked = cut_lineage(rows.filter(is_query).groupBy("v").agg(F.min("vec_id").alias("node")))
    facts = held.agg(F.count(F.lit(1)).alias("n"), F.max(length).alias("most"), F.min(length).alias("least"), F.max(F.size("v")).alias("d")).first()
    total = facts["n"]
    longest = facts["most"] if total and facts["most"] > facts["least"] * 1.001 else 0.0
    own = Tables((facts["d"] or 1) + (1 if longest else 0), total, tables, looks)

    def place(x: np.ndarray, lift: bool) -> np.ndarray:
        norms = np.sqrt((x * x).sum(axis=1, keepdims=True))
        if not longest:
            return x / norms
        if lift:
            return np.hstack([x / longest, np.sqrt(np.maximum(0.0, 1.0 - (norms / longest) ** 2))])
        return np.hstack([x / norms, np.zeros((len(x), 1))])

    def deal(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, 2048):
                batch = whole.slice(a, 2048)
                x = place(_matrix(batch.column(1)), True)
                for t in range(tables):
                    code = own.homes(x, t)
                    yield pa.RecordBatch.from_arrays([pa.array(own.shelf(t, code)), pa.array(code), *batch.columns], names=["shelf", "code", "vec_id", "v"])

    def ask(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                batch = whole.slice(a, 256)
                x = place(_matrix(batch.column(1)), False)
                for t in range(tables):
                    code = np.sort(own.looks(x, t), axis=1)
                    shelf, row = own.shelf(t, code).ravel(), np.repeat(np.arange(len(x)), code.shape[1])
                    cut = np.flatnonzero(np.concatenate([[True], (np.diff(shelf) != 0) | (np.diff(row) != 0)]))
                    lists = pa.ListArray.from_arrays(pa.array(np.append(cut, len(shelf)).astype(np.int32)), pa.array(code.ravel()))
                    picked = pa.array(row[cut])
                    yield pa.RecordBatch.from_arrays([pa.array(shelf[cut]), lists, batch.column(0).take(picked), batch.column(1).take(picked)], names=["shelf", "codes", "node", "v"])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        """The rows of a shelf that share a bucket with a query."""
        if not left.num_rows or not right.num_rows:
            return _as_found([], np.zeros(0, np.int64), np.zeros(0, np.int64))
        ids, nodes, x, q = left.column("vec_id").to_numpy(), right.column("node").to_numpy(), _matrix(left.column("v")), _matrix(right.column("v"))
        code, codes = left.column("code").to_numpy(), right.column("codes").combine_chunks()
        by_code = np.argsort(code, kind="stable")
        wanted, asking = codes.flatten().to_numpy(), np.repeat(np.arange(len(nodes)), codes.value_lengths().to_numpy())
        order = np.argsort(wanted, kind="stable")
        wanted, asking = wanted[order], asking[order]
        met, starts = np.unique(wanted, return_index=True)
        ends = np.append(starts[1:], len(wanted))
        lo, hi = np.searchsorted(code[by_code], met), np.searchsorted(code[by_code], met, side="right")
        parts, held_ = [], 0
        for i in np.flatnonzero(hi > lo):
            who, at = asking[starts[i] : ends[i]], by_code[lo[i] : hi[i]]
            parts.append((np.repeat(who, len(at)), np.tile(at, len(who)), (q[who] @ x[at].T).ravel()))
            held_ += len(who) * len(at)
            if held_ > 2_000_000:
                which, at, near = best_of(q, x, *(np.concatenate(c) for c in zip(*parts, strict=True)), ids, k + 1)
                parts, held_ = [(which, at, near)], len(which)
        return _as_found([best_of(q, x, *(np.concatenate(c) for c in zip(*parts, strict=True)), ids, k + 1)] if parts else [], nodes, ids)

    def search_all(left: pa.Table, right: pa.Table) -> pa.Table:
        """All rows of a block."""
        if not left.num_rows or not right.num_rows:
            return _as_found([], np.zeros(0, np.int64), np.zeros(0, np.int64))
        ids, nodes, x, q = left.column("vec_id").to_numpy(), right.column("node").to_numpy(), _matrix(left.column("v")), _matrix(right.column("v"))
        parts = []
        for a in range(0, len(q), 256):
            n = len(q[a : a + 256])
            parts.append(best_of(q, x, np.repeat(np.arange(a, a + n), len(x)), np.tile(np.arange(len(x)), n), (q[a : a + n] @ x.T).ravel(), ids, k + 1))
        return _as_found(parts, nodes, ids)

    kind = "node long, vec_id long, score double"
    dealt = held.select("vec_id", "v").mapInArrow(deal, "shelf long, code long, vec_id long, v array<double>")
    looked = asked.select("node", "v").mapInArrow(ask, "shelf long, codes array<long>, node long, v array<double>")

    def parts_of(part: DataFrame, most: int, name: str) -> DataFrame:
        """How many parts each shelf is cut into."""
        return part.groupBy("shelf").agg(F.ceil(F.count(F.lit(1)) / most).alias(name))

    def every(n):
        return F.explode(F.sequence(F.lit(0).cast("long"), n - F.lit(1).cast("long")))

    def one_of(c: str, n):
        return F.pmod(F.xxhash64(c), n)

    cuts = cut_lineage(parts_of(dealt.select("shelf"), 2 * SHELF_ROWS, "rs").join(parts_of(looked.select("shelf"), BLOCK_QUERIES, "qs"), "shelf"))
    left = dealt.join(cuts, "shelf").select("shelf", one_of("vec_id", F.col("rs")).alias("r"), every(F.col("qs")).alias("b"), "code", "vec_id", "v")
    right = looked.join(cuts, "shelf").select("shelf", every(F.col("rs")).alias("r"), one_of("node", F.col("qs")).alias("b"), "codes", "node", "v")
    found = left.groupBy("shelf", "r", "b").cogroup(right.groupBy("shelf", "r", "b")).applyInArrow(search, kind)
    place_ = F.dense_rank().over(Window.partitionBy("node").orderBy(F.desc("score"), "vec_id"))  # found in several tables: one place

    def ranked(part: DataFrame) -> DataFrame:
        return part.withColumn("place", place_).filter(F.col("place") <= k + 1).select(*_FOUND).distinct()

    found = cut_lineage(ranked(found))
    enough = found.groupBy("node").count().filter(F.col("count") >= min(k + 1, total)).select("node")
    short = cut_lineage(asked.join(enough, "node", "left_anti").select("node", "v"))
    n_short = short.count()
    if n_short:
        shards, blocks = -(-16 * total // SHELF_ROWS), -(-n_short // BLOCK_QUERIES)
        shards, blocks = F.lit(shards).cast("long"), F.lit(blocks).cast("long")
        left = held.select(one_of("vec_id", shards).alias("r"), every(blocks).alias("b"), "vec_id", "v")
        right = short.select(every(shards).alias("r"), one_of("node", blocks).alias("b"), "node", "v")
        again = left.groupBy("r", "b").cogroup(right.groupBy("r", "b")).applyInArrow(search_all, kind)
        found = found.join(short.select("node"), "node", "left_anti").unionByName(ranked(again))
    # every query has its vector's nearest, but itself
    each = rows.filter(is_query).select(F.col("vec_id").alias("query_id"), "v").join(asked, "v").select("query_id", "node")
    pairs = each.join(found, "node").filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)
