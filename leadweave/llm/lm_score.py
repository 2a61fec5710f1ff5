"""Language-model scores from a log-frequency Bloom filter.

All training texts are counted: tokens exactly, runs of several tokens (n-grams) by a hash. A count c is quantised to level
1 + floor(log_b c), and the filter holds a key (n-gram, 1), ..., (n-gram, level). Probing levels until one is missing gives
the level back, never too low, seldom too high. The filter has ``BITS_PER_KEY`` bits for every key, so it grows with the
corpus, and is built in segments by hash, in parallel. One of up to ``BROADCAST_BYTES`` is broadcast. The segments of a
larger one stay where they are: each run of documents sends its distinct n-grams to them and gets the levels back, so that
a task holds one segment or one run. N-grams seen once are left out, as a smoothed model gives them next to nothing.

Probabilities are smoothed by interpolation (Jelinek-Mercer): p(w | h) = a c(hw) / c(h) + (1 - a) p(w | h'), h' being h
without its first token, all counts from repeated probes; below stands p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)). The weight a
depends on the order and the level of c(h); the weights are fitted by expectation maximisation on all training texts, each
token with its own occurrence taken off all counts. Levels are few, so the tokens are counted by the levels that decide
their probability, and the driver fits on these counts, which do not grow with the number of texts.

The base score needs each token's exact count. The most frequent tokens, a bounded number, are broadcast; all others meet
their counts in a shuffle, already summed by document. Tokens are told apart by a 64-bit hash.

Cases: null and empty texts are the end mark alone. Rows with a null id belong to the fold of the empty text. Repeated rows
are counted, and scored, once each. Without any training text N = V = 0, and a token's base probability is 1. Other columns are ignored. An
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Words, byte_chunks, cut_lineage, give_back, mix, runs, table
from .language import fold_of

SPACES = bytes([0x20, *range(0x09, 0x0E)])
END = U64(0xE7D0E7D0E7D0E7D1)
ORDER = 2
#: Ratio of neighbouring quantised counts, least count of an n-gram of several tokens.
BASE, LEAST = 2**0.5, 2
#: Rounds of the fit.
FIT_ROUNDS = 25
LEVELS = 130
BITS_PER_KEY, PROBES = 10, 5
#: The largest filter that is broadcast, and bytes of text whose n-grams are sent to the segments of a larger one at once.
BROADCAST_BYTES, RUN_BYTES = 64 << 20, 4 << 20
HEAD_TOKENS = 400_000
#: Bits of an n-gram's hash that are kept below those of its slice.
REST = 40
FLUSH_TOKENS = 1_000_000
#: Tokens that are scored at once; temporaries take about a hundred bytes each.
SCORE_TOKENS = 250_000


def token_hashes(texts: pa.Array, words: Words):
    """For runs of texts: first row, each token's hash with the end mark last, tokens before each text and in all."""
    for row, data, offsets in byte_chunks(texts):
        hashes, _, _, before = words(data, offsets)
        n = len(offsets) - 1
        starts = before + np.arange(n + 1)
        tokens = np.empty(len(hashes) + n, dtype=U64)
        last = np.zeros(len(tokens), dtype=bool)
        last[starts[1:] - 1] = True
        tokens[last] = END
        tokens[~last] = hashes
        yield row, tokens, starts


def portions(batch: pa.RecordBatch, lengths: np.ndarray):
    """A batch in runs of whole rows of ``SCORE_TOKENS`` tokens at most, or one longer row."""
    ends, row = np.cumsum(lengths), 0
    while row < len(ends):
        before = ends[row] - lengths[row]
        end = max(row + 1, int(np.searchsorted(ends, before + SCORE_TOKENS, side="right")))
        yield batch.slice(row, end - row), lengths[row:end]
        row = end


def ngrams(tokens: np.ndarray, starts: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the 1-, 2-, ... order-grams that end at each token; 0 where the text has too few tokens before."""
    out = [tokens]
    place = np.arange(len(tokens)) - np.repeat(starts[:-1], np.diff(starts))
    for n in range(2, order + 1):
        longer = np.zeros(len(tokens), dtype=U64)
        if len(tokens) >= n:
            longer[1:] = mix(out[-1][:-1] * U64(0xA0761D6478BD642F) + mix(tokens[1:]))
        longer[place < n - 1] = 0
        out.append(longer)
    return out


def levels(counts: np.ndarray, least: int) -> np.ndarray:
    """The quantised level of each count; 0 below the least."""
    q = 1 + np.floor(np.log(np.maximum(counts, least) / least) / np.log(BASE) + 1e-9).astype(np.int64)
    return np.where(counts >= least, q, 0)


def level_counts(least: int, n: int = LEVELS) -> np.ndarray:
    """The mean count of each level, from 0."""
    edge = least * BASE ** np.arange(n + 1)
    low, high = np.ceil(edge[:-1] - 1e-9), np.ceil(edge[1:] - 1e-9) - 1
    return np.concatenate([[0.0], np.where(high >= low, (low + high) / 2, edge[:-1])])


class Filter:
    """Segments of bits; a key's hash names its segment."""

    def __init__(self, slice_bits: int, segments: dict[tuple[int, int], bytes], orders: int):
        self.slice_bits = slice_bits
        shape = (orders + 1, 1 << slice_bits)
        self.first, self.bits = np.zeros(shape, dtype=np.int64), np.zeros(shape, dtype=np.int64)
        at = 0
        for key, body in sorted(segments.items()):
            self.first[key], self.bits[key] = at, 8 * len(body)
            at += len(body)
        self.body = np.frombuffer(b"".join(body for _, body in sorted(segments.items())) or b"\0", dtype=np.uint8)

    @staticmethod
    def places(keys: np.ndarray, level: int, bits) -> list[np.ndarray]:
        a = mix(keys ^ mix(np.array([level], dtype=U64)))
        b = mix(a) | U64(1)
        bits = np.asarray(bits).astype(U64)
        return [((a + U64(j) * b) % bits).astype(np.int64) for j in range(PROBES)]

    def level(self, order: int, hashes: np.ndarray) -> np.ndarray:
        """The level of each n-gram, by probing one level after the other."""
        part = (hashes >> U64(64 - self.slice_bits)).astype(np.int64) if self.slice_bits else np.zeros(len(hashes), np.int64)
        return np.where(hashes != 0, self.find(order, part, shortened(hashes, self.slice_bits, order)), 0)

    def find(self, order: int, part: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The level of each key of a segment, ``LEVELS`` at most."""
        out = np.zeros(len(keys), dtype=np.int64)
        alive = np.flatnonzero(self.bits[order][part] > 0)
        for level in range(1, LEVELS + 1):
            if not len(alive):
                break
            first, bits = self.first[order][part[alive]], self.bits[order][part[alive]]
            there = np.ones(len(alive), dtype=bool)
            for place in self.places(keys[alive], level, bits):
                there &= (self.body[first + (place >> 3)] >> (place & 7).astype(np.uint8)) & 1 == 1
            alive = alive[there]
            out[alive] = level
        return out


def shortened(hashes: np.ndarray, slice_bits: int, order: int) -> np.ndarray:
    return hashes if order == 1 else hashes >> U64(64 - slice_bits - REST)


def _fold(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sum the counts of equal hashes."""
    hashes, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(hashes, kind="stable")
    hashes, counts = hashes[order], counts[order]
    edge = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
    return hashes[edge], np.add.reduceat(counts, edge) if len(edge) else counts


def _pack(keys: np.ndarray, order: int) -> bytes:
    """Sorted keys of one slice; those of longer n-grams without the slice, five bytes each."""
    if order == 1:
        return keys.tobytes()
    rest = keys & U64((1 << REST) - 1)
    return rest.astype(np.uint32).tobytes() + (rest >> U64(32)).astype(np.uint8).tobytes()


def _unpack(body: bytes, order: int, part: int) -> np.ndarray:
    if order == 1:
        return np.frombuffer(body, dtype=U64)
    n = len(body) // 5
    low, high = np.frombuffer(body, dtype=np.uint32, count=n), np.frombuffer(body, dtype=np.uint8, offset=4 * n)
    return low.astype(U64) | (high.astype(U64) << U64(32)) | U64(part << REST)


_COUNTS = "n int, slice int, once binary, more binary, counts binary"


def _counted(n: int, part: int, hashes: np.ndarray, counts: np.ndarray) -> tuple:
    """Keys seen once need no counts."""
    one = counts == 1
    return n, part, _pack(hashes[one], n), _pack(hashes[~one], n), counts[~one].astype(np.uint32).tobytes()


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["n", "slice", "once", "more", "counts"])


def corpus_counts(texts: DataFrame, order: int, slice_bits: int) -> DataFrame:
    """Exact counts of all n-grams as a sorted block for each order and slice of the hash range."""

    def count(batches):
        words = Words(separators=SPACES)
        held: list[list[np.ndarray]] = [[] for _ in range(order)]
        waiting = 0

        def flush():
            for n, parts in enumerate(held, 1):
                keys = np.sort(np.concatenate(parts)) if parts else np.zeros(0, U64)
                keys = shortened(keys[keys != 0], slice_bits, n)
                edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
                counts, keys = np.diff(np.append(edge, len(keys))), keys[edge]
                shift = U64(64 - slice_bits if n == 1 else REST)
                cuts = np.searchsorted((keys >> shift) if slice_bits else np.zeros(len(keys), U64), np.arange((1 << slice_bits) + 1, dtype=U64))
                rows = [_counted(n, s, keys[a:b], counts[a:b]) for s, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
                parts.clear()
                if rows:
                    yield _as_batch(rows)

        for batch in batches:
            for _, tokens, starts in token_hashes(batch.column(0), words):
                for parts, hashes in zip(held, ngrams(tokens, starts, order), strict=True):
                    parts.append(hashes)
                waiting += len(tokens)
                if waiting >= FLUSH_TOKENS:
                    yield from flush()
                    waiting = 0
        yield from flush()
        give_back()

    def total(rows: pa.Table) -> pa.Table:
        n, part = rows.column("n")[0].as_py(), rows.column("slice")[0].as_py()
        parts = []
        for once, more, counts in zip(*(rows.column(c).to_pylist() for c in ("once", "more", "counts")), strict=True):
            keys = _unpack(once, n, part)
            parts.append((keys, np.ones(len(keys), dtype=np.int64)))
            parts.append((_unpack(more, n, part), np.frombuffer(counts, dtype=np.uint32).astype(np.int64)))
        keys, counts = _fold(parts)
        if n > 1:
            keys, counts = keys[counts >= LEAST], counts[counts >= LEAST]
        q = int(levels(counts, 1 if n == 1 else LEAST).sum())
        return pa.table({"n": pa.array([n], pa.int32()), "slice": pa.array([part], pa.int32()), "keys": pa.array([_pack(keys, n)], pa.binary()), "counts": pa.array([counts.astype("<i8").tobytes()], pa.binary()), "tokens": pa.array([int(counts.sum())], pa.int64()), "distinct": pa.array([len(keys)], pa.int64()), "levels": pa.array([q], pa.int64())})

    return texts.mapInArrow(count, _COUNTS).groupBy("n", "slice").applyInArrow(total, "n int, slice int, keys binary, counts binary, tokens long, distinct long, levels long")


def segment_bytes(levels_in_all) -> int:
    return max(8, int(levels_in_all * BITS_PER_KEY / 8))


def filter_segments(counts: DataFrame) -> DataFrame:
    """(n, slice, body): each slice's bits, as many for a key at any size of the corpus."""

    def segment(batches):
        for batch in batches:
            for n, part, body, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                hashes, times = _unpack(body, n, part), np.frombuffer(raw, dtype="<i8")
                q = levels(times, 1 if n == 1 else LEAST)
                size = segment_bytes(q.sum())
                marks = np.zeros(size * 8, dtype=np.uint8)
                for level in range(1, int(q.max(initial=0)) + 1):
                    for place in Filter.places(hashes[q >= level], level, size * 8):
                        marks[place] = 1
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([part], pa.int32()), pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())], names=["n", "slice", "body"])

    return counts.select("n", "slice", "keys", "counts").mapInArrow(segment, "n int, slice int, body binary")


def build_filter(segments: DataFrame, order: int, slice_bits: int) -> Filter:
    """The whole filter on the driver."""
    return Filter(slice_bits, {(r["n"], r["slice"]): bytes(r["body"]) for r in segments.toLocalIterator()}, order)


def _run_grams(texts: pa.Array, words: Words, order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """tokens, starts and n-grams of a run of texts."""
    tokens, starts, grams = [], [np.zeros(1, dtype=np.int64)], [[] for _ in range(order)]
    for _, some, first in token_hashes(texts, words):
        tokens.append(some)
        starts.append(first[1:] + starts[-1][-1])
        for parts, hashes in zip(grams, ngrams(some, first, order), strict=True):
            parts.append(hashes)
    return np.concatenate(tokens), np.concatenate(starts), [np.concatenate(parts) for parts in grams]


def sharded(rows: DataFrame, segments: DataFrame, order: int, slice_bits: int, code, kinds: str) -> DataFrame:
    """``code`` over runs of documents, given the levels that their n-grams have in segments that are not broadcast."""
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = rows.withColumn("run", F.pmod(F.xxhash64("doc_id", "text"), F.lit(total // RUN_BYTES + 1)))

    def ask(batches):
        words = Words(separators=SPACES)
        for table in runs(batches, ["run"]):
            run = table.column("run")[0].as_py()
            _, _, grams = _run_grams(table.column("text").combine_chunks(), words, order)
            for n, hashes in enumerate(grams, 1):
                keys = shortened(np.unique(hashes[hashes != 0]), slice_bits, n)
                keys = np.unique(keys)
                part = keys >> U64(64 - slice_bits if n == 1 else REST) if slice_bits else np.zeros(len(keys), U64)
                cuts = np.searchsorted(part, np.arange((1 << slice_bits) + 1, dtype=U64))
                found = [(run, n, s, _pack(keys[a:b], n)) for s, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["run", "n", "slice", "body"])

    def answer(batches):
        key = bloom = None
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                run, n, part, body = (batch.column(c)[i].as_py() for c in ("run", "n", "slice", "body"))
                if run < 0:
                    key, bloom = (n, part), Filter(slice_bits, {(n, part): body}, order)
                    continue
                keys = _unpack(body, n, part)
                level = bloom.find(n, np.full(len(keys), part), keys) if key == (n, part) else np.zeros(len(keys))
                out.append((run, n, part, level.astype(np.uint8).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["run", "n", "slice", "body"])

    def meet(batches):
        words = Words(separators=SPACES)
        for table in runs(batches, ["run"]):
            asked = table.filter(pa.compute.greater(table.column("n"), 0))
            docs = table.filter(pa.compute.equal(table.column("n"), 0))
            tokens, starts, grams = _run_grams(docs.column("text").combine_chunks(), words, order)
            found = []
            for n, hashes in enumerate(grams, 1):
                bodies = asked.filter(pa.compute.equal(asked.column("n"), n)).column("body").to_pylist()
                there = hashes != 0
                keys, where = np.unique(shortened(hashes[there], slice_bits, n), return_inverse=True)
                got = np.frombuffer(b"".join(bodies), dtype=np.uint8)
                if len(got) != len(keys):
                    raise ValueError(f"{len(got)} levels for {len(keys)} n-grams")
                level = np.zeros(len(hashes), dtype=np.uint8)
                level[there] = got[where]
                found.append(level)
            yield code(docs.column("doc_id").combine_chunks(), docs.column("held_out").combine_chunks(), [(tokens, starts, found)])

    shape = "run long, n int, slice int, body binary"
    probes = dealt.select("run", "text").repartition("run").sortWithinPartitions("run").mapInArrow(ask, shape)
    met = segments.select(F.lit(-1).cast("long").alias("run"), "n", "slice", "body").unionByName(probes).repartition("n", "slice").sortWithinPartitions("n", "slice", "run").mapInArrow(answer, shape)
    docs = dealt.select("run", F.lit(0).alias("n"), F.lit(0).alias("slice"), "doc_id", "held_out", "text")
    both = met.unionByName(docs, allowMissingColumns=True).repartition("run").sortWithinPartitions("run", "n", "slice")
    return both.mapInArrow(meet, kinds)


def head_and_tail(counts: DataFrame, slice_bits: int, head_tokens: int = HEAD_TOKENS) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """The most frequent tokens of each slice, ``head_tokens`` at most, as arrays, and all others as (token, count)."""
    each = max(1, head_tokens >> slice_bits)

    def split(part: str):
        def run(batches):
            for batch in batches:
                for body, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    hashes, times = np.frombuffer(body, dtype=np.int64), np.frombuffer(raw, dtype="<i8")
                    order = np.lexsort((hashes, -times))
                    at = order[:each] if part == "head" else order[each:]
                    yield pa.RecordBatch.from_arrays([pa.array(hashes[at]), pa.array(times[at])], names=["token", "count"])

        return run

    single = counts.filter("n = 1").select("keys", "counts")
    head = single.mapInArrow(split("head"), "token long, count long").toPandas()
    tokens, times = head["token"].to_numpy(dtype=np.int64).view(U64), head["count"].to_numpy(dtype=np.int64)
    order = np.argsort(tokens)
    return tokens[order], times[order], single.mapInArrow(split("tail"), "token long, count long")


class Model:
    """Smoothed log10 probabilities of tokens from the levels of their n-grams."""

    def __init__(self, order: int, whole: float, weights: np.ndarray | None = None):
        self.order, self.whole = order, whole
        self.sizes = [level_counts(1)] + [level_counts(LEAST)] * (order - 1)
        #: For each order from 2 on and each level of the context.
        self.weights = np.zeros((order - 1, LEVELS + 1)) if weights is None else weights

    def cases(self, body: bytes, lengths: np.ndarray) -> np.ndarray:
        """A number for each token from the levels of its n-grams and of their contexts (0: none); all it takes to score it."""
        level = np.frombuffer(body, dtype=np.uint8).reshape(-1, self.order).astype(np.int64)
        place = np.arange(len(level)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out = np.zeros(len(level), dtype=np.int64)
        for n in range(1, self.order):
            out[1:] = out[1:] * (LEVELS + 1) + np.where(place[1:] >= n, level[:-1, n - 1], 0)
        for n in range(self.order):
            out = out * (LEVELS + 1) + level[:, n]
        return out

    def counted(self, cases: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each order, the n-gram's count, and the level of its context."""
        digits = []
        for _ in range(2 * self.order - 1):
            digits.append(cases % (LEVELS + 1))
            cases = cases // (LEVELS + 1)
        digits.reverse()
        contexts, level = [np.zeros(len(cases), np.int64), *digits[: self.order - 1]], digits[self.order - 1 :]
        return [size[at] for size, at in zip(self.sizes, level, strict=True)], contexts

    def log_probabilities(self, cases: np.ndarray) -> np.ndarray:
        counts, contexts = self.counted(cases)
        p = (counts[0] + 0.5) / self.whole
        for n in range(1, self.order):
            a = self.weights[n - 1][contexts[n]]
            p = a * np.minimum(1.0, counts[n] / np.maximum(self.sizes[n - 1][contexts[n]], 1.0)) + (1 - a) * p
        return np.log10(p)

    def fit(self, cases: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Expectation maximisation over each case as often as it occurs."""
        self.weights = np.zeros((self.order - 1, LEVELS + 1))
        counts, contexts = self.counted(cases)
        lower = (np.maximum(counts[0] - 1, 0) + 0.5) / self.whole
        for n in range(1, self.order):
            at = contexts[n]
            without = np.where(counts[n] > LEAST, counts[n] - 1, 0.0)
            share = np.minimum(1.0, without / np.maximum(self.sizes[n - 1][at] - 1, 1.0))
            a = np.where(np.arange(LEVELS + 1) > 0, 0.1, 0.0)
            rows = np.bincount(at, weights=times, minlength=LEVELS + 1)
            for _ in range(FIT_ROUNDS):
                own = a[at] * share
                part = own / (own + (1 - a[at]) * lower)
                # two tokens' worth of doubt, so that a level seen once is not trusted
                a = np.where(rows > 0, np.bincount(at, weights=part * times, minlength=LEVELS + 1) / (rows + 2.0), 0.0)
                a[0] = 0.0
            self.weights[n - 1] = a
            lower = a[at] * share + (1 - a[at]) * lower
        return self.weights


def training_cases(coded: DataFrame, model: Model):
    """How often each case occurs in the documents."""

    def count(batches):
        held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            for some, lengths in portions(batch, batch.column(0).to_numpy()):
                cases = model.cases(b"".join(some.column(1).to_pylist()), lengths)
                for parts, found in zip(held, np.unique(cases, return_counts=True), strict=True):
                    parts.append(found)
                cases, where = np.unique(np.concatenate(held[0]), return_inverse=True)
                held = [cases], [np.bincount(where, weights=np.concatenate(held[1]), minlength=len(cases)).astype(np.int64)]
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts)) for parts in held], names=["case", "times"])

    return coded.select("n_tokens", "levels").mapInArrow(count, "case long, times long").groupBy("case").agg(F.sum("times").alias("times")).orderBy("case").toPandas()


def score_documents(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score); ``train`` is the condition that marks what is learned from."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), (~train).alias("held_out"), F.col(text_col).alias("text"))
    slice_bits = max(0, int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()
    counts = cut_lineage(corpus_counts(rows.filter("NOT held_out").select("text"), order, slice_bits))
    facts = counts.filter("n = 1").agg(F.sum("tokens").alias("n"), F.sum("distinct").alias("v")).first()
    n_all, v_all = facts["n"] or 0, facts["v"] or 0
    whole = n_all + 0.5 * (v_all + 1)
    head, times, tail = head_and_tail(counts, slice_bits)
    known = spark.sparkContext.broadcast((head, np.log10(times + 0.5)))

    def code(ids, held_out, parts) -> pa.RecordBatch:
        """Each document's sums over its frequent tokens, its other tokens, and the levels of its n-grams, a byte each."""
        head, logs = known.value
        out: list[list] = [[] for _ in range(3)]
        others, ends, levels_ = [], [np.zeros(1, np.int64)], []
        for tokens, starts, found in parts:
            at = np.minimum(np.searchsorted(head, tokens), max(len(head) - 1, 0))
            common = head[at] == tokens if len(head) else np.zeros(len(tokens), dtype=bool)
            base = np.zeros(len(tokens))
            base[common] = logs[at[common]]
            rare = np.concatenate([[0], np.cumsum(~common)])[starts]
            out[0].append(np.diff(starts))
            out[1].append(np.diff(starts) - np.diff(rare))
            out[2].append(np.add.reduceat(base, starts[:-1]))
            others.append(tokens[~common].view(np.int64))
            ends.append(rare[1:] + ends[-1][-1])
            levels_.append(np.stack([level.astype(np.uint8) for level in found], axis=1))
        joined = [np.concatenate(c) if c else np.zeros(0) for c in out]
        rest = pa.ListArray.from_arrays(pa.array(np.concatenate(ends).astype(np.int32)), pa.array(np.concatenate(others) if others else np.zeros(0, np.int64), pa.int64()))
        bounds = np.concatenate([[0], np.cumsum(joined[0])]).astype(np.int32) * order
        body = np.concatenate(levels_).tobytes() if levels_ else b""
        packed = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(body)])
        return pa.RecordBatch.from_arrays([ids, held_out, pa.array(joined[0].astype(np.int64)), pa.array(joined[1].astype(np.int64)), pa.array(joined[2].astype(float)), rest, packed], names=["doc_id", "held_out", "n_tokens", "known", "base", "rare", "levels"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    kinds = f"doc_id {kind}, held_out boolean, n_tokens long, known long, base double, rare array<long>, levels binary"
    segments = filter_segments(counts)
    sizes = counts.select("levels").toPandas()["levels"]
    if sum(segment_bytes(q) for q in sizes) <= BROADCAST_BYTES:
        bloom = spark.sparkContext.broadcast(build_filter(segments, order, slice_bits))

        def probe(batches):
            words = Words(separators=SPACES)
            for batch in batches:
                for row, tokens, starts in token_hashes(batch.column(2), words):
                    found = []
                    for n, hashes in enumerate(ngrams(tokens, starts, order), 1):
                        keys, where = np.unique(hashes, return_inverse=True)
                        found.append(bloom.value.level(n, keys)[where].astype(np.uint8))
                    some = batch.slice(row, len(starts) - 1)
                    yield code(some.column(0), some.column(1), [(tokens, starts, found)])
            give_back()

        coded = rows.mapInArrow(probe, kinds)
    else:
        coded = sharded(rows, segments, order, slice_bits, code, kinds)
    coded = cut_lineage(coded.withColumn("row", F.monotonically_increasing_id()))
    model = Model(order, whole)
    seen = training_cases(coded.filter("NOT held_out"), model)
    model.fit(seen["case"].to_numpy(dtype=np.int64), seen["times"].to_numpy(dtype=np.int64))

    def score(batches):
        for batch in batches:
            for some, lengths in portions(batch, batch.column(1).to_numpy()):
                each = model.log_probabilities(model.cases(b"".join(some.column(2).to_pylist()), lengths))
                sums = np.add.reduceat(each, np.cumsum(lengths) - lengths)
                yield pa.RecordBatch.from_arrays([*(some.column(i) for i in (0, 1, 3, 4, 5, 6)), pa.array(sums)], names=["row", "n_tokens", "doc_id", "held_out", "known", "base", "score"])
        give_back()

    rare = coded.select("row", F.explode("rare").alias("token")).groupBy("row", "token").agg(F.count(F.lit(1)).alias("times"))
    met = rare.join(tail, "token").groupBy("row").agg(F.sum("times").alias("met"), F.sum(F.col("times") * F.log10(F.col("count") + 0.5)).alias("met_base"))
    scored = coded.select("row", "n_tokens", "levels", "doc_id", "held_out", "known", "base").mapInArrow(score, f"row long, n_tokens long, doc_id {kind}, held_out boolean, known long, base double, score double")
    out = scored.join(met, "row", "left")
    met_n = F.coalesce("met", F.lit(0))
    unknown = F.col("n_tokens") - F.col("known") - met_n
    base = F.col("base") + F.coalesce("met_base", F.lit(0.0)) + unknown * F.lit(float(np.log10(0.5))) - F.col("n_tokens") * F.lit(float(np.log10(whole)))
    return out.select(F.col("doc_id").alias(id_col), "held_out", "n_tokens", (F.col("known") + met_n).alias("n_known"), F.lit(int(n_all)).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), fold_of("doc_id", 5) != 1)
