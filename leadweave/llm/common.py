"""What several operators of this folder share: table reading, checkpoints, vectorised word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..operators.lineage import cut_lineage

__all__ = ["U64", "Words", "byte_chunks", "crc32_sql", "crc_table_sql", "cut_lineage", "give_back", "kept", "mix", "odd_constants", "runs", "shingles", "table"]

U64 = np.uint64
FULL = U64(0xFFFFFFFFFFFFFFFF)
#: Bytes of text that one round of array work covers; temporaries take about 30 times as much.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_kept: dict = {}


def give_back() -> None:
    """Memory that this process has freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def kept(kind: str, key, make):
    """A costly object of a worker process, which has one at a time: that of the operator that ran last."""
    if (kind, key) not in _kept:
        _kept.clear()
        gc.collect()
        give_back()
        _kept[kind, key] = make()
    return _kept[kind, key]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x + U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def odd_constants(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) + U64(seed << 32)) | U64(1)


class Words:
    """Hashes every word of a run of texts with array operations only.

    A word is a maximal run of word bytes of the UTF-8 text. Each byte has a random 64-bit value; a word's hash is
    the polynomial of its bytes' values over an odd base, finalised. Hashes stand for words: two of n distinct words
    share one with a chance of about n^2 / 2^65.
    """

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self, separators: bytes | None = None, fold_case: bool = True):
        """separators: the bytes between words; None: all ASCII but letters and digits."""
        code = np.arange(256)
        if separators is None:
            word = (code >= 128) | ((code | 32 >= 97) & (code | 32 <= 122) & (code >= 65)) | ((code >= 48) & (code <= 57))
        else:
            word = ~np.isin(code, list(separators))
        folded = np.where(fold_case & (code >= 65) & (code <= 90), code + 32, code)
        self.is_word = word
        self.value = np.where(word, mix(folded.astype(U64) + U64(7)) | U64(1), U64(0))
        self.powers = self.inverses = np.ones(1, dtype=U64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, CHUNK_BYTES + 1)
            for name, base in (("powers", self.BASE), ("inverses", pow(self.BASE, -1, 1 << 64))):
                steps = np.full(n, U64(base), dtype=U64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """data: the bytes; offsets: where each text starts, and the end. -> hashes, first and end byte of each word, words before each text (and in all)."""
        n = len(data)
        if not n:
            none = np.zeros(0, dtype=np.int64)
            return none.astype(U64), none, none, np.zeros(len(offsets), dtype=np.int64)
        self._grow(n)
        inside = self.is_word[data]
        first, last = inside.copy(), inside.copy()
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        first[1:] &= ~inside[:-1]
        first[cut] = inside[cut]
        last[:-1] &= ~inside[1:]
        last[cut - 1] = inside[cut - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        if len(starts):
            sums = np.add.reduceat(self.value[data] * self.powers[:n], starts)
            hashes = mix(sums * self.inverses[starts])
        else:
            hashes = np.zeros(0, dtype=U64)
        return hashes, starts, ends, np.searchsorted(starts, offsets)


def byte_chunks(texts: pa.Array, limit: int = CHUNK_BYTES):
    """Cut a string column into runs of about ``limit`` bytes, whole rows each. -> first row, bytes, offsets. Null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    _, where, body = texts.buffers()
    where = np.frombuffer(where, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(where, where[row] + limit, side="right")) - 1)
        yield row, body[where[row] : where[end]], where[row : end + 1] - where[row]
        row = end


def shingles(hashes: np.ndarray, before: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words of each text; a shorter text is one run of all its words. -> hashes, runs before each text."""
    base = U64(0xD6E8FEB86659FD93)
    counts = np.diff(before)
    n = len(hashes)
    runs = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    starts = np.concatenate([[0], np.cumsum(runs)])
    owner = np.repeat(np.arange(len(counts)), runs)
    at = before[:-1][owner] + (np.arange(starts[-1]) - starts[:-1][owner])
    padded = np.concatenate([hashes, np.zeros(width, dtype=U64)])
    left = before[1:][owner] - at
    total = np.zeros(len(at), dtype=U64)
    for j in range(width):
        step = padded[np.minimum(at + j, n)]
        if j and len(left):
            step = np.where(left > j, step, U64(0))
        total = total * base + step
    return mix(total), starts


def runs(batches, names: list[str]):
    """Batches sorted by the columns, regrouped: a table for each run of rows equal in them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b == a:
                continue
            if held and tuple(keys[:, a]) != last:
                yield pa.Table.from_batches(held)
                held = []
            last = tuple(keys[:, a])
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def crc_table_sql() -> str:
    """DuckDB SQL for one row with the 256 steps of crc32 as ``steps``, made from its polynomial."""
    step = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    return f"SELECT list(v ORDER BY i) AS steps FROM (SELECT i, list_reduce([CAST(i AS BIGINT)] || list_transform(range(8), lambda k: CAST(0 AS BIGINT)), lambda c, k: {step}) AS v FROM range(256) r(i))"


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of a text's UTF-8 bytes, where crc_table_sql()'s row is at hand."""
    code = f"hex(encode({text}))"
    parts = f"list_transform(range(length({code}) // 2), lambda i: CAST('0x' || substr({code}, CAST(2 * i + 1 AS INT), 2) AS BIGINT))"
    return f"xor(list_reduce([CAST(4294967295 AS BIGINT)] || {parts}, lambda c, b: xor(c // 256, steps[CAST(xor(c, b) % 256 + 1 AS INT)])), 4294967295)"
