"""Near-duplicate texts: a Jaccard join of word shingles with Bayesian pruning of candidates.

1. Each text becomes the set of hashes of its five-word runs and a MinHash signature; texts with the same set are one node,
   whatever their number.
2. Signature bands put nodes into buckets; of buckets with the same nodes one is kept. Two sets of similarity 0.8 share no
   band with a chance of about 3 in a million.
3. The signatures of a bucket's pairs, a byte a value, are compared a few values at a time. A pair is dropped as soon as the
   posterior chance that its similarity reaches the threshold, given the matches so far and a uniform prior, falls below a
   tolerance. The pairs that are left tie nodes together; a bucket emits ties, no more than its nodes, and never its pairs. A
   large bucket first ties all it can to its least node; only nodes that this leaves meet the others, block by block.
4. Texts are fetched for tied nodes only. Inside a connected component whole signatures drop pairs once more and the exact
   similarity of the others decides. Components beyond a number of nodes or bytes are cut into blocks, and each pair of
   blocks is compared on its own, so that neither a bucket nor a component has to fit into one task.
5. The links found tie nodes to classes; a class's id is its least document id.

Cases: null and empty texts are copies of one another. A text of fewer than five words is one run of all its words; one
without any word is compared by its bytes. Repeated rows are copies. Rows with a null id take part, but no class is named
after them. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import components
from .common import U64, Words, byte_chunks, cut_lineage, give_back, mix, odd_constants, runs, shingles, table

WIDTH, THRESHOLD = 5, 0.8
BANDS, BAND_ROWS = 42, 6
#: Signature values compared between two prunings, and the posterior chance below which a pair is dropped.
STEP, TOLERANCE = 28, 1e-6
#: Nodes and bytes of text of one block of a component, nodes of one block of a bucket, pairs compared at once.
BLOCK, BLOCK_BYTES, BUCKET, PAIRS = 512, 8 << 20, 2048, 1 << 20


def shingle_sets(texts: pa.Array, words: Words, width: int = WIDTH):
    """The sorted distinct shingle hashes of each text; never empty."""
    for _, data, offsets in byte_chunks(texts):
        hashes, _, _, before = words(data, offsets)
        terms, starts = shingles(hashes, before, width)
        for j in range(len(offsets) - 1):
            own = terms[starts[j] : starts[j + 1]]
            if len(own):
                own = np.sort(own)
                yield own[np.concatenate([[True], own[1:] != own[:-1]])]
            else:
                yield np.frombuffer(hashlib.blake2b(data[offsets[j] : offsets[j + 1]].tobytes(), digest_size=8).digest(), dtype=U64)


def set_key(terms: np.ndarray) -> int:
    """64 bits that stand for a whole set; two of n different sets share them with a chance of about n^2 / 2^65."""
    return int.from_bytes(hashlib.blake2b(terms.tobytes(), digest_size=8).digest(), "little", signed=True)


def signature(terms: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """The least value of each of many hash functions over the set."""
    least = np.full(len(multipliers), U64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(terms), 2048):
        least = np.minimum(least, (multipliers[:, None] * terms[None, at : at + 2048]).min(axis=1))
    return least


def least_matches(compared: int, threshold: float, tolerance: float) -> int:
    """The fewest matches among ``compared`` values that leave similarity >= threshold a posterior chance of ``tolerance``.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail at t is the chance of at most m
    successes in n + 1 trials of chance t.
    """
    n, total = compared + 1, 0.0
    for m in range(compared + 1):
        total += comb(n, m) * threshold**m * (1 - threshold) ** (n - m)
        if total >= tolerance:
            return m
    return compared


def pruned(i: np.ndarray, j: np.ndarray, signs: np.ndarray, sizes: np.ndarray, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that may be similar enough: by the sets' sizes for certain, by their signatures but for the tolerance."""
    keep = np.minimum(sizes[i], sizes[j]) >= threshold * np.maximum(sizes[i], sizes[j]) - 1e-9
    i, j = i[keep], j[keep]
    values = signs.shape[1]
    matches = np.zeros(len(i), dtype=np.int64)
    for at in range(0, values, STEP):
        parts = [(signs[i[a : a + 65536], at : at + STEP] == signs[j[a : a + 65536], at : at + STEP]).sum(axis=1) for a in range(0, len(i), 65536)]
        matches += np.concatenate(parts) if parts else 0
        alive = matches >= least_matches(min(at + STEP, values), threshold, tolerance)
        i, j, matches = i[alive], j[alive], matches[alive]
    return i, j


def similar_pairs(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, values: int = BANDS * BAND_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i from left, j from right; i < j where both are the same) whose sets are similar enough."""
    multipliers = odd_constants(values, 2)
    signs = np.array([signature(s, multipliers) for s in sets])
    i, j = np.meshgrid(left, right, indexing="ij")
    keep = (i < j) if left is right else np.ones(i.shape, dtype=bool)
    sizes = np.array([len(s) for s in sets])
    i, j = pruned(i[keep], j[keep], signs, sizes, threshold, tolerance)
    if not len(i):
        return i, j
    if len(i) <= 4 * len(sets):
        shared = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)])
    else:  # many pairs of few sets: count through the columns that two or more sets have
        used = np.unique(np.concatenate([i, j]))
        owner = np.repeat(used, sizes[used])
        kinds, column, times = np.unique(np.concatenate([sets[a] for a in used]), return_inverse=True, return_counts=True)
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        keep = times[column] > 1
        owner, column = owner[keep], np.unique(column[keep], return_inverse=True)[1]
        place = np.zeros(len(sets), dtype=np.int64)
        place[used] = np.arange(len(used))
        total = np.zeros((len(used), len(used)), dtype=np.float64)
        for a in range(0, int(column.max(initial=-1)) + 1, 2048):
            lo, hi = np.searchsorted(column, [a, a + 2048])
            grid = np.zeros((len(used), 2048), dtype=np.float32)
            grid[place[owner[lo:hi]], column[lo:hi] - a] = 1
            total += grid @ grid.T
        shared = total[place[i], place[j]]
    good = shared >= threshold * (sizes[i] + sizes[j] - shared) - 1e-9
    return i[good], j[good]


def least_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Connected components of n points; each point gets the least of its component."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _signs(column) -> np.ndarray:
    """A row of bytes for each signature."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1)


def _met(rows: np.ndarray, others: np.ndarray, signs: np.ndarray, sizes: np.ndarray, threshold: float, tolerance: float):
    """Pairs of a row and another, some at a time, pruned."""
    step = max(1, PAIRS // max(1, len(others)))
    for a in range(0, len(rows), step):
        some = rows[a : a + step]
        yield pruned(np.repeat(some, len(others)), np.tile(others, len(some)), signs, sizes, threshold, tolerance)


def bucket_labels(starts: np.ndarray, signs: np.ndarray, sizes: np.ndarray, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> np.ndarray:
    """For the rows of several buckets (``starts``, and the end), the least row that each is tied to."""
    n, found = np.diff(starts), []
    for m in np.unique(n[n <= 32]):  # all pairs, of all buckets of one size together
        i, j = np.triu_indices(m, 1)
        firsts = starts[:-1][n == m]
        step = max(1, PAIRS // max(1, len(i)))
        for a in range(0, len(firsts), step):
            some = firsts[a : a + step, None]
            found.append(pruned((some + i).ravel(), (some + j).ravel(), signs, sizes, threshold, tolerance))
    for k in np.flatnonzero(n > 32):
        rows = np.arange(starts[k], starts[k + 1])
        near = pruned(np.full(len(rows), rows[0]), rows, signs, sizes, threshold, tolerance)
        found.append(near)
        found += _met(np.setdiff1d(rows, near[1]), rows, signs, sizes, threshold, tolerance)
    return least_labels(starts[-1], *(np.concatenate(c) for c in zip(*found, strict=True))) if found else np.arange(starts[-1])


def candidate_ties(nodes: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """From (key, size, sig, bands) of distinct nodes, (u, v): ties whose connected components hold all pairs that may be similar enough."""
    banded = nodes.select("key", F.explode("bands").alias("bucket"))
    listed = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("head"), F.bit_xor(F.xxhash64("key")).alias("which")).filter("n > 1")
    buckets = listed.groupBy("n", "head", "which").agg(F.min("bucket").alias("bucket")).select("bucket", "head", "n")
    members = banded.join(buckets, "bucket").join(nodes.select("key", "size", "sig"), "key").select("bucket", "head", "n", "key", "size", "sig")
    members = cut_lineage(members)

    def whole(batches):
        """Buckets of one task each, several at a time."""
        held: list[pa.Table] = []

        def flush():
            rows = pa.concat_tables(held).combine_chunks()
            bucket, keys = rows.column("bucket").to_numpy(), rows.column("key").to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
            label = bucket_labels(starts, _signs(rows.column("sig")), rows.column("size").to_numpy(), threshold, tolerance)
            tied = label != np.arange(len(label))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys[tied]), pa.array(keys[label[tied]])], names=["u", "v"])

        waiting = 0
        for run in runs(batches, ["bucket"]):
            held.append(run)
            waiting += run.num_rows
            if waiting >= 2 * BUCKET:
                waiting = 0
                yield flush()
        if held:
            yield flush()

    shape = "u long, v long"
    small = members.filter(F.col("n") <= BUCKET).select("bucket", "key", "size", "sig")
    ties = small.repartition("bucket").sortWithinPartitions("bucket", "key").mapInArrow(whole, shape)
    large = members.filter(F.col("n") > BUCKET)
    if large.isEmpty():
        return ties

    def to_head(batches):
        for batch in batches:
            n = batch.num_rows
            signs = np.concatenate([_signs(batch.column("sig")), _signs(batch.column("head_sig"))]) if n else np.zeros((0, 1), np.uint8)
            sizes = np.concatenate([batch.column("size").to_numpy(), batch.column("head_size").to_numpy()])
            near = np.zeros(n, dtype=bool)
            near[pruned(np.arange(n), np.arange(n) + n, signs, sizes, threshold, tolerance)[0]] = True
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(near)], names=[*names, "near"])

    names = ["bucket", "head", "n", "key", "size", "sig"]
    heads = large.filter("key = head").select("bucket", F.col("size").alias("head_size"), F.col("sig").alias("head_sig"))
    large = cut_lineage(large.join(heads, "bucket").mapInArrow(to_head, "bucket long, head long, n long, key long, size long, sig binary, near boolean"))
    ties = ties.unionByName(large.filter("near AND key <> head").select(F.col("key").alias("u"), F.col("head").alias("v")))
    # what is not near the head meets all of its bucket
    rest = large.filter("NOT near")
    cuts = rest.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BUCKET).alias("rows"), F.ceil(F.first("n") / BUCKET).alias("all"))

    def part(c: str):
        return F.pmod(F.xxhash64("key"), F.col(c))

    def every(c: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - F.lit(1).cast("long")))

    left = rest.join(cuts, "bucket").select("bucket", part("rows").alias("a"), every("all").alias("b"), "key", "size", "sig")
    right = large.join(cuts, "bucket").select(F.col("bucket").alias("bucket"), every("rows").alias("a"), part("all").alias("b"), *[F.col(c).alias(c) for c in ("key", "size", "sig")])

    def across(one: pa.Table, two: pa.Table) -> pa.Table:
        n = one.num_rows
        if not n or not two.num_rows:
            return pa.table([pa.array([], pa.int64())] * 2, names=["u", "v"])
        keys, sizes = (np.concatenate([t.column(c).to_numpy() for t in (one, two)]) for c in ("key", "size"))
        signs = np.concatenate([_signs(one.column("sig")), _signs(two.column("sig"))])
        found = list(_met(np.arange(n), np.arange(n, len(keys)), signs, sizes, threshold, tolerance))
        label = least_labels(len(keys), *(np.concatenate(c) for c in zip(*found, strict=True)))
        tied = label != np.arange(len(label))
        return pa.table([pa.array(keys[tied]), pa.array(keys[label[tied]])], names=["u", "v"])

    return ties.unionByName(left.groupBy("bucket", "a", "b").cogroup(right.groupBy("bucket", "a", "b")).applyInArrow(across, shape))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, width: int = WIDTH, tolerance: float = TOLERANCE) -> DataFrame:
    """(id, class_id, n_links) for each row: links lead to all rows whose text is similar enough, copies included."""
    texts = docs.select(F.col(text_col).alias("text"))

    def sign(batches):
        words, multipliers = Words(), odd_constants(BANDS * BAND_ROWS, 2)
        salt = mix(np.arange(BANDS, dtype=U64))
        for batch in batches:
            keys, bands, sizes, signs = [], [], [], []
            for terms in shingle_sets(batch.column(1), words, width):
                keys.append(set_key(terms))
                sizes.append(len(terms))
                total, least = salt.copy(), signature(terms, multipliers)
                for value in least.reshape(BANDS, BAND_ROWS).T:
                    total = mix(total ^ value)
                bands.append(total.view(np.int64))
                signs.append((mix(least) >> U64(56)).astype(np.uint8).tobytes())
            flat = pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64), pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * BANDS, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), batch.column(2), pa.array(sizes, pa.int64()), pa.array(signs, pa.binary()), lists], names=["doc_id", "key", "bytes", "size", "sig", "bands"])
        give_back()

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("bytes"))
    rows = cut_lineage(read.mapInArrow(sign, "doc_id long, key long, bytes long, size long, sig binary, bands array<long>"))
    nodes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least"), F.max("bytes").alias("bytes"))
    ties = candidate_ties(rows.select("key", "size", "sig", "bands").dropDuplicates(["key"]), threshold, tolerance)
    found = cut_lineage(components(ties))

    # How each component is cut, and the copies of each node.
    known = found.withColumnRenamed("node", "key").join(nodes.select("key", "copies", "bytes"), "key")
    sizes = known.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    placed = cut_lineage(known.join(sizes, "root").select("key", "root", "copies", F.greatest("blocks", F.lit(1)).alias("blocks")))

    def keyed(batches):
        """Each distinct set's text, once a partition."""
        words, seen = Words(), set()
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000)
                keys = np.array([set_key(t) for t in shingle_sets(some.column(0), words, width)], dtype=np.int64)
                new = []
                for i, k in enumerate(keys.tolist()):
                    if k not in seen:
                        seen.add(k)
                        new.append(i)
                yield pa.RecordBatch.from_arrays([pa.array(keys[new], pa.int64()), some.column(0).take(pa.array(new, pa.int64()))], names=["key", "text"])

    pieces = texts.mapInArrow(keyed, "key long, text string").join(placed, "key").withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pieces = pieces.select("*", other.alias("peer")).select("*", F.least("own", "peer").alias("a"), F.greatest("own", "peer").alias("b"))
    pieces = pieces.select("root", "a", "b", "own", "key", "copies", "text")

    def compare(batches):
        """One pair of blocks at a time."""
        words = Words()
        for rows_of in runs(batches, ["root", "a", "b"]):
            rows_of = rows_of.combine_chunks()
            column = {n: rows_of.column(n).to_numpy() for n in ("a", "b", "own", "key", "copies")}
            once = np.unique(column["key"], return_index=True)[1]  # ascending keys, each once
            sets = list(shingle_sets(rows_of.column("text").take(pa.array(once)), words, width))
            own, a, b = column["own"][once], column["a"][0], column["b"][0]
            left = np.flatnonzero(own == a)
            right = left if a == b else np.flatnonzero(own == b)
            i, j = similar_pairs(sets, left, right, threshold, tolerance)
            copies, keys = column["copies"][once], column["key"][once]
            links = np.bincount(i, weights=copies[j], minlength=len(once)) + np.bincount(j, weights=copies[i], minlength=len(once))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(keys[least_labels(len(keys), i, j)]), pa.array(links.astype(np.int64))], names=["key", "label", "links"])
        give_back()

    dealt = pieces.repartition("root", "a", "b").sortWithinPartitions("root", "a", "b", "key")
    compared = cut_lineage(dealt.mapInArrow(compare, "key long, label long, links long"))
    classes = components(compared.select(F.col("key").alias("u"), F.col("label").alias("v")))
    links = compared.groupBy("key").agg(F.sum("links").alias("links"))
    named = nodes.join(links, "key", "left").join(classes.withColumnRenamed("node", "key"), "key", "left").select("key", F.coalesce("root", "key").alias("root"), "least", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    named = cut_lineage(named)
    ids = named.groupBy("root").agg(F.min("least").alias("class_id"))
    named = named.join(ids, "root").select("key", "class_id", "n_links")
    return rows.select("doc_id", "key").join(named, "key").select(F.col("doc_id").alias(id_col), "class_id", "n_links")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without all but one document of each class; rows without an id stay. Rows repeated with id and text count once."""
    found = cut_lineage(near_duplicates(docs, id_col, text_col, **options).filter(F.col(id_col).isNotNull()))
    gone = found.filter(F.col(id_col) != F.col("class_id")).select(id_col).distinct()
    kept = docs.join(gone, id_col, "left_anti").select(*docs.columns)
    repeated = cut_lineage(found.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(id_col))
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, id_col, "left_anti").select(*docs.columns)
    again = kept.join(repeated, id_col, "left_semi").select(*docs.columns)
    return once.unionByName(again.dropDuplicates([id_col, text_col]))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+', 0) AS l FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) = 0 THEN ['#' || t] ELSE list_transform(range(0, greatest(len(l) - 4, 1)), lambda i: array_to_string(l[i + 1:i + 5], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
r(u, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.v, r.root FROM r JOIN l ON l.u = r.u)
SELECT d.doc_id, (SELECT min(root) FROM r WHERE r.u = d.doc_id) AS class_id, (SELECT count(*) FROM l WHERE l.u = d.doc_id) AS n_links FROM documents d"""
