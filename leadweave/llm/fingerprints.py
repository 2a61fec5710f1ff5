"""Document fingerprints by consistent weighted sampling.

A text is a bag of word shingles, each weighted by its count. For sample i and term x with weight w, consistent
weighted sampling draws r, c ~ Gamma(2, 1) and b ~ U(0, 1) from (i, x) alone, sets t = floor(ln w / r + b),
y = exp(r (t - b)) and a = c / (y exp(r)); the sample is the (x, t) with the smallest a. Two bags agree in a sample
with a chance equal to their generalised Jaccard similarity, sum of minima over sum of maxima.

Both gammas are built from exponentials so that the common weight 1 needs only one of them: with E1, E2, E3 ~ Exp(1),
c = E1 + E2 makes E1 / c uniform, and s = -ln(E1 / c) ~ Exp(1), r = s + E3, b = 1 - s / r are as required. For w = 1,
t = 0 and a = E1 follow, so that the smallest a is that of the smallest uniform number behind E1, found by integer
arithmetic. All other weights go through the full formula.

Cases: null and empty texts have no terms; their fingerprint is all f's, alike to itself only. A text of fewer words than
a shingle is one term of all its words. A text without any word (only signs) is one term of its bytes. Repeated rows and equal ids are kept; ids that tie
are ordered by text. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Words, byte_chunks, mix, odd_constants, shingles, table

SAMPLES = 128
SHINGLE_WORDS = 5
EMPTY = U64(0xFFFF)


def _exponential(x: np.ndarray) -> np.ndarray:
    """From 64 random bits; finite and above 0."""
    return -np.log1p(-((x >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53)


def weighted_sample(terms: np.ndarray, weights: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """One bag's samples as 16-bit values. terms: distinct 64-bit hashes; weights: positive, any real numbers."""
    k = len(multipliers)
    if not len(terms):
        return np.full(k, EMPTY, dtype=U64)
    unit = weights == 1
    light, heavy = terms[unit], terms[~unit]
    chosen = np.full(k, U64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(light), 2048):
        chosen = np.minimum(chosen, (multipliers[:, None] * light[None, at : at + 2048]).min(axis=1))
    least = _exponential(chosen) if len(light) else np.full(k, np.inf)
    for at in range(0, len(heavy), 512):
        x = multipliers[:, None] * heavy[None, at : at + 512]
        w = weights[~unit][None, at : at + 512]
        e1, e2, e3 = (_exponential(v) for v in (x, mix(x ^ U64(0x5851F42D4C957F2D)), mix(x ^ U64(0x14057B7EF767814F))))
        c = e1 + e2
        s = np.log(c / e1)
        r = s + e3
        b = 1 - s / r
        t = np.floor(np.log(w) / r + b)
        a = c * np.exp(-r * (t - b) - r)
        best = a.argmin(axis=1)
        rows = np.arange(k)
        better = a[rows, best] < least
        least = np.where(better, a[rows, best], least)
        token = x[rows, best] ^ (t[rows, best].astype(np.int64).astype(U64) * U64(0xD1342543DE82EF95))
        chosen = np.where(better, token, chosen)
    return np.minimum(mix(chosen) >> U64(48), U64(0xFFFE))


def fingerprints(texts: list[str] | pa.Array, words: Words, multipliers: np.ndarray, width: int = SHINGLE_WORDS) -> np.ndarray:
    """A row of samples for each text."""
    texts = texts if isinstance(texts, (pa.Array, pa.ChunkedArray)) else pa.array(texts, type=pa.large_string())
    out = np.empty((len(texts), len(multipliers)), dtype=U64)
    for row, data, offsets in byte_chunks(texts):
        hashes, _, _, before = words(data, offsets)
        terms, starts = shingles(hashes, before, width)
        for j in range(len(offsets) - 1):
            own = np.sort(terms[starts[j] : starts[j + 1]])
            if not len(own) and offsets[j + 1] > offsets[j]:  # no word, but some text
                own = np.frombuffer(hashlib.blake2b(data[offsets[j] : offsets[j + 1]].tobytes(), digest_size=8).digest(), dtype=U64)
            edge = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
            counts = np.diff(np.append(edge, len(own)))
            out[row + j] = weighted_sample(own[edge], counts.astype(np.float64), multipliers)
    return out


def as_hex(samples: np.ndarray) -> str:
    return samples.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal samples: estimates generalised Jaccard similarity with a standard error of at most 0.5 / sqrt(samples)."""
    return float(np.mean(a == b))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES, width: int = SHINGLE_WORDS) -> DataFrame:
    """(id, n_chars, fingerprint) of every text, in place, without a shuffle."""

    def run(batches):
        words, multipliers = Words(), odd_constants(samples, 1)
        for batch in batches:
            texts = batch.column(1).fill_null("") if batch.column(1).null_count else batch.column(1)
            prints = fingerprints(texts, words, multipliers, width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts.to_pylist()], pa.int64()), pa.array([as_hex(p) for p in prints], pa.string())], names=["id", "n_chars", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_chars long, fingerprint string").withColumnRenamed("id", id_col)


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (block, extra, id, text), dealt and sorted so that each row's follower by id comes right after it.

    The ids are cut at approximate quantiles, a few numbers on the driver. Each block of ids is a partition of its own, and
    the rows of its least id go also to the end of the block before it (extra = 1), those of the least of all to the end
    of the last block. The least ids are counted, not taken from the quantiles, which are inexact beyond 2^53. The texts
    are shuffled once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)] or [0.5], 20 * parts + 1000).alias("cuts")).first()["cuts"]
    edges = np.array(sorted(set(cuts or [])), dtype=np.int64)

    @F.pandas_udf("int")
    def block_of(ids: pd.Series) -> pd.Series:
        null = ids.isna().to_numpy()
        known = ids.fillna(0).astype("int64").to_numpy()
        return pd.Series(np.where(null, 0, np.searchsorted(edges, known, side="right")).astype(np.int32))

    rows = rows.withColumn("block", block_of("id"))
    # nulls come first: where there are any, they are the least
    leasts = rows.groupBy("block").agg(F.min("id").alias("least"), F.count(F.when(F.col("id").isNull(), 1)).alias("nulls")).orderBy("block").collect()
    before = [leasts[i - 1]["block"] for i in range(len(leasts))]
    opens = F.lit(None).cast("int")
    if leasts:
        known = spark.createDataFrame([(r["block"], None if r["nulls"] else r["least"], b) for r, b in zip(leasts, before, strict=True)], "block int, least long, before int")
        rows = rows.join(F.broadcast(known), "block")
        opens = F.when(F.col("id").eqNullSafe(F.col("least")), F.col("before"))
    one = F.struct(F.col("block").alias("block"), F.lit(0).alias("extra"))
    dealt = rows.select("id", "text", F.explode(F.when(opens.isNotNull(), F.array(one, F.struct(opens.alias("block"), F.lit(1).alias("extra")))).otherwise(F.array(one))).alias("place"))
    dealt = dealt.select("place.block", "place.extra", "id", "text")
    return dealt.repartitionById(parts, F.col("block")).sortWithinPartitions("block", "extra", F.col("id").asc_nulls_first(), F.coalesce("text", F.lit("")))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES, width: int = SHINGLE_WORDS) -> DataFrame:
    """Fingerprints of each text, of the text with its last half replaced by the start of the next one, and how alike they are."""

    def run(batches):
        words, multipliers = Words(), odd_constants(samples, 1)
        held: list[tuple] = []  # the last row so far: (block, extra, id, text, samples)
        names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

        def finish(rows: list[tuple]):
            pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if not a[1] and a[0] == b[0]]
            edits = []
            for a, b in pairs:
                half = len(a[3]) // 2
                edits.append(a[3][: len(a[3]) - half] + b[3][:half])
            prints = fingerprints(edits, words, multipliers, width)
            columns = [
                pa.array([a[2] for a, _ in pairs], pa.int64()),
                pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edits], pa.string()),
                pa.array([as_hex(a[4]) for a, _ in pairs], pa.string()),
                pa.array([as_hex(p) for p in prints], pa.string()),
                pa.array([likeness(a[4], p) for (a, _), p in zip(pairs, prints, strict=True)], pa.float64()),
                pa.array([likeness(a[4], b[4]) for a, b in pairs], pa.float64()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                texts = [t or "" for t in batch.column(3).to_pylist()]
                prints = fingerprints(texts, words, multipliers, width)
                rows = held + list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), texts, prints, strict=True))
                held = rows[-1:]
                yield finish(rows)

    return with_next(docs, id_col, text_col).mapInArrow(run, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").withColumnRenamed("id", id_col)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
