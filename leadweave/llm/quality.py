"""Quality scores from random-indexing word vectors and a small network.

Tokens are runs of letters and digits, as written, and runs of other signs. Every token has an index vector: one +1 or -1
in each group of eight places, drawn from its hash. A vocabulary word's vector is the sum of the index vectors around all of
its occurrences in all documents; words outside the vocabulary share one vector for each form (case, digits or signs, and
length). A document is pooled from its tokens: the mean of their unit vectors; how far a token's index vector agrees with
those around it (it is one where a word repeats itself), how far its word's vector does (whether the word is used as
elsewhere), how far all index vectors add up, and the number of tokens. A network with one hidden layer gives a logit, and a
temperature, fitted on rows that the network has not learned from, makes it a probability.

The vocabulary and the network come from at most ``fit_rows`` labelled rows (those with the smallest hash of the id), of equal
texts one. Word vectors are counted over all documents: a task sums into an array as large as the vocabulary, and the sums
of tasks meet by word. Scoring is in place, without a shuffle.

Cases: null and empty texts have no tokens and are pooled to zeros, which get a score as any other text. Rows without a
label, or with one other than 0 and 1, teach nothing; of several labels for an id the highest counts. If labels of one kind
only are learned, every text gets their share (with one text more of each kind). Repeated rows are scored once each, and
count as often as they occur in word vectors. Whole texts count, however long: dense arrays cover a block of tokens. Other
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Words, byte_chunks, cut_lineage, kept, mix, table
from .language import fold_of

FIT_ROWS, VOCABULARY = 20_000, 8_192
GROUPS, WIDE = 8, 8
DIMS = GROUPS * WIDE
#: Tokens to each side that count as around a token.
WINDOW = 2
#: Tokens for which dense arrays are held at once, and bytes of text.
BLOCK, TEXT_BYTES = 1 << 16, 1 << 19
HIDDEN, EPOCHS, RATE, DECAY, BATCH = 24, 60, 0.01, 1e-4, 64
#: One in so many rows is kept from the network and fits the temperature.
HELD = 5
#: Forms of words outside the vocabulary: kinds by lengths.
KINDS, LENGTHS = 6, (3, 7)
FORMS = KINDS * (len(LENGTHS) + 1)


class Tokens:
    """Cuts texts into tokens: hash, form, and the number of tokens before each text."""

    def __init__(self):
        self.words = Words(fold_case=False)
        self.signs = Words(fold_case=False)
        code = np.arange(256)
        self.signs.is_word = sign = ~self.words.is_word & ~np.isin(code, [9, 10, 11, 12, 13, 32])
        self.signs.value = np.where(sign, mix(code.astype(U64) + U64(1009)) | U64(1), U64(0))

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, s, e, _ = self.words(data, offsets)
        sign_h, sign_s, sign_e, _ = self.signs(data, offsets)
        hashes, starts, ends = np.concatenate([h, sign_h]), np.concatenate([s, sign_s]), np.concatenate([e, sign_e])
        order = np.argsort(starts, kind="stable")
        hashes, starts, ends = hashes[order], starts[order], ends[order]
        if not len(hashes):
            return hashes, np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        upper, lower = self.cases(data)
        capitals, smalls, digits = (inside(v, starts, ends) for v in (upper, lower, (data >= 48) & (data <= 57)))
        # In order: signs, with a digit, capitals only, a capital first, capitals within, other.
        kind = np.select([order >= len(h), digits > 0, (capitals > 1) & (smalls == 0), (capitals == 1) & upper[starts], capitals > 0], [0, 1, 2, 3, 4], 5)
        form = kind * (len(LENGTHS) + 1) + np.searchsorted(np.array(LENGTHS), ends - starts)
        return hashes, form, np.searchsorted(starts, offsets)

    @staticmethod
    def cases(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether a capital, or a small letter, begins at a byte: ASCII and Latin-1 letters, the latter two bytes from C3."""
        upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
        lead, second = data[:-1] == 0xC3, data[1:]
        upper[:-1] |= lead & (second >= 0x80) & (second <= 0x9E)
        lower[:-1] |= lead & (second >= 0x9F) & (second <= 0xBF)
        return upper, lower


def inside(marks: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many marks each token has."""
    total = np.concatenate([[0], np.cumsum(marks)])
    return total[ends] - total[starts]


@functools.cache
def index_halves() -> np.ndarray:
    """For each 16 bits, a +1 or -1 in four groups of places: three bits say where, one which."""
    bits = np.arange(1 << 16)
    out = np.zeros((len(bits), GROUPS // 2, WIDE), dtype=np.int8)
    for g in range(GROUPS // 2):
        out[bits, g, (bits >> (4 * g + 1)) & (WIDE - 1)] = np.where((bits >> (4 * g)) & 1, 1, -1)
    return out.reshape(len(bits), -1)


def index_vectors(hashes: np.ndarray) -> np.ndarray:
    """A +1 or -1 in each group of places, from the hash's lower 32 bits."""
    low, high = (hashes & U64(0xFFFF)).astype(np.int64), ((hashes >> U64(16)) & U64(0xFFFF)).astype(np.int64)
    return np.hstack([index_halves()[low], index_halves()[high]])


def around(vectors: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The sum of the vectors of up to WINDOW tokens to each side, of the same text; a byte holds it."""
    n = len(owner)
    at = np.arange(n) + WINDOW * (1 + np.cumsum(np.append(False, owner[1:] != owner[:-1])[:n]))  # texts set apart by empty rows
    padded = np.zeros((int(at[-1]) + WINDOW + 1 if n else 0, DIMS), dtype=np.int8)
    padded[at] = vectors
    total = np.zeros_like(padded)
    for step in range(1, WINDOW + 1):
        total[step:] += padded[:-step]
        total[:-step] += padded[step:]
    return total[at]


def blocks(texts: pa.Array, tokens: Tokens):
    """-> first text, number of texts, and a list of (hashes, forms, owner, what of it counts): blocks of tokens with those around them."""
    for row, data, offsets in byte_chunks(texts, TEXT_BYTES):
        hashes, forms, before = tokens(data, offsets)
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
        parts = []
        for a in range(0, len(hashes), BLOCK):
            b = min(a + BLOCK, len(hashes))
            lo, hi = max(0, a - WINDOW), min(len(hashes), b + WINDOW)
            parts.append((hashes[lo:hi], forms[lo:hi], owner[lo:hi], slice(a - lo, b - lo)))
        yield row, len(offsets) - 1, parts


def slots(hashes: np.ndarray, forms: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Place of each token's vector: of its form, or after these, of its vocabulary word."""
    if not len(vocabulary):
        return forms
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, FORMS + at, forms)


def choose_vocabulary(rows: DataFrame, size: int = VOCABULARY) -> np.ndarray:
    """Hashes, sorted, of the tokens that most of the rows' texts have. rows: (text, ...), bounded."""

    def count(batches):
        tokens, total = Tokens(), pd.Series(dtype=np.int64)
        for batch in batches:
            for _, n, parts in blocks(batch.column(0), tokens):
                if parts:
                    hashes, owner = np.concatenate([h[keep] for h, _, _, keep in parts]), np.concatenate([o[keep] for _, _, o, keep in parts])
                    order = np.lexsort((owner, hashes))
                    hashes, owner = hashes[order], owner[order]
                    new = np.append(True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1]))
                    kinds, counts = np.unique(hashes[new].view(np.int64), return_counts=True)
                    total = total.add(pd.Series(counts, index=kinds), fill_value=0)
        yield pa.RecordBatch.from_arrays([pa.array(total.index.to_numpy(np.int64)), pa.array(total.to_numpy(np.int64))], names=["token", "n"])

    counts = rows.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter("n > 1")
    best = [r["token"] for r in counts.orderBy(F.desc("n"), "token").limit(size).collect()]
    return np.sort(np.array(best, dtype=np.int64).view(U64))


def word_vectors(docs: DataFrame, vocabulary: np.ndarray, text_col: str = "text") -> np.ndarray:
    """(FORMS + words) x DIMS sums over all documents, scaled to unit length."""
    places = [f"v{i}" for i in range(DIMS)]
    shape = "slot int, " + ", ".join(f"{p} long" for p in places)

    def count(batches):
        tokens = Tokens()
        total = np.zeros((FORMS + len(vocabulary), DIMS), dtype=np.int64)
        for batch in batches:
            for _, _, parts in blocks(batch.column(0), tokens):
                for hashes, forms, owner, keep in parts:
                    sums = around(index_vectors(hashes), owner)[keep]
                    slot = slots(hashes[keep], forms[keep], vocabulary)
                    order = np.argsort(slot, kind="stable")
                    slot = slot[order]
                    first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
                    total[slot[first]] += np.add.reduceat(np.ascontiguousarray(sums[order].T).astype(np.int32), first, axis=1).T
        used = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *[pa.array(total[used, i]) for i in range(DIMS)]], names=["slot", *places])

    sums = docs.select(F.col(text_col).alias("text")).mapInArrow(count, shape).groupBy("slot").agg(*[F.sum(p).alias(p) for p in places]).collect()
    out = np.zeros((FORMS + len(vocabulary), DIMS))
    for r in sums:
        out[r["slot"]] = r[1:]
    return unit(out)


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.sqrt((v * v).sum(axis=-1, keepdims=True)), 1e-12)


#: A text's features: its mean vector, and four numbers.
FEATURES = DIMS + 4


def pooled(texts: pa.Array, vocabulary: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """A row of features for each text."""
    out = np.zeros((len(texts), FEATURES))
    tokens, small = Tokens(), vectors.astype(np.float32)
    for row, n, parts in blocks(texts, tokens):
        count = np.zeros(n)
        index_sum = np.zeros((n, DIMS))
        for hashes, forms, owner, keep in parts:
            index = index_vectors(hashes)
            near = around(index, owner)[keep].astype(np.float32)
            index, owner = index[keep], owner[keep]
            own = small[slots(hashes[keep], forms[keep], vocabulary)]
            length = np.maximum(np.sqrt(np.einsum("ij,ij->i", near, near)), 1e-12)
            repeats = np.einsum("ij,ij->i", index.astype(np.float32), near) / length / np.sqrt(GROUPS)
            usual = np.einsum("ij,ij->i", own, near) / length
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            for lo, hi in zip(first, np.append(first[1:], len(owner)), strict=True):
                mine, who = out[row + owner[lo]], owner[lo]
                mine[:DIMS] += own[lo:hi].sum(axis=0, dtype=np.float64)
                mine[DIMS] += repeats[lo:hi].sum(dtype=np.float64)
                mine[DIMS + 1] += usual[lo:hi].sum(dtype=np.float64)
                index_sum[who] += index[lo:hi].sum(axis=0, dtype=np.int32)
                count[who] += hi - lo
        mine = out[row : row + n]
        mine[:, : DIMS + 2] /= np.maximum(count, 1)[:, None]
        mine[:, DIMS + 2] = np.log1p((index_sum**2).sum(axis=1) / GROUPS) - np.log1p(count)
        mine[:, DIMS + 3] = np.log1p(count)
    return out


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, features: np.ndarray) -> np.ndarray:
        return np.tanh(((features - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, features: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(features) / self.temperature)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def log_loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0.0, z) - y * z))


def fit_network(x: np.ndarray, y: np.ndarray, seed: int = 0) -> Network:
    """Adam on the log loss. Rows come in a fixed order, so that equal rows give an equal network."""
    rng = np.random.default_rng(seed)
    held = np.arange(len(y)) % HELD == HELD - 1
    if len(np.unique(y[~held])) < 2 or len(np.unique(y[held])) < 2:
        held = np.zeros(len(y), dtype=bool)
    mean, scale = x[~held].mean(axis=0), np.maximum(x[~held].std(axis=0), 1e-6)
    net = Network(mean, scale, rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), 0.0)
    a, t = (x[~held] - mean) / scale, y[~held].astype(float)
    params = [net.w1, net.b1, net.w2, np.array([net.b2])]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(t))
        for lo in range(0, len(t), BATCH):
            pick = order[lo : lo + BATCH]
            hidden = np.tanh(a[pick] @ params[0] + params[1])
            off = (sigmoid(hidden @ params[2] + params[3][0]) - t[pick]) / len(pick)
            back = np.outer(off, params[2]) * (1 - hidden**2)
            grads = [a[pick].T @ back + DECAY * params[0], back.sum(axis=0), hidden.T @ off + DECAY * params[2], np.array([off.sum()])]
            step += 1
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                params[i] -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = *params[:3], float(params[3][0])
    net.temperature = fit_temperature(net.logits(x[held]), y[held]) if held.any() else 1.0
    return net


def fit_temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden sections of its logarithm."""
    lo, hi, cut = np.log(0.05), np.log(20.0), (np.sqrt(5.0) - 1) / 2
    for _ in range(60):
        left, right = hi - cut * (hi - lo), lo + cut * (hi - lo)
        if log_loss(z / np.exp(left), y) <= log_loss(z / np.exp(right), y):
            hi = right
        else:
            lo = left
    return float(np.exp((lo + hi) / 2))


@dataclass
class Model:
    vocabulary: np.ndarray
    vectors: np.ndarray
    network: Network | None
    share: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), self.share)
        return self.network.probabilities(pooled(texts, self.vocabulary, self.vectors))


def labelled(docs: DataFrame, labels: DataFrame, label_col: str = "quality", fit_rows: int = FIT_ROWS) -> DataFrame:
    """(digest, text, label) of a bounded number of labelled rows, equal texts once. The labels broadcast are ``fit_rows`` at most."""
    chosen = labels.select("doc_id", F.col(label_col).cast("int").alias("label")).filter("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return rows.groupBy(F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest")).agg(F.first("text").alias("text"), F.max("label").alias("label"))


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "quality", fit_rows: int = FIT_ROWS, size: int = VOCABULARY) -> Model:
    """docs: all documents, whose texts give the word vectors; labels: those that may be learned from."""
    rows = cut_lineage(labelled(docs, labels, label_col, fit_rows))
    totals = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = (totals.get(1, 0) + 1) / (sum(totals.values()) + 2)
    if len(totals) < 2:
        return Model(np.zeros(0, U64), np.zeros((FORMS, DIMS)), None, share)
    vocabulary = choose_vocabulary(rows, size)
    vectors = word_vectors(docs, vocabulary)

    def features(batches):
        for batch in batches:
            x = pooled(batch.column("text"), vocabulary, vectors)
            yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("label"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float64()))], names=["digest", "label", "x"])

    found = rows.mapInArrow(features, "digest string, label int, x array<double>").orderBy("digest").collect()
    return Model(vocabulary, vectors, fit_network(np.array([r["x"] for r in found]), np.array([r["label"] for r in found])), share)


def score_texts(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with score; in place, without a shuffle."""

    @F.pandas_udf("double")
    def scored(column: pd.Series) -> pd.Series:
        return pd.Series(model.scores(pa.array(column, pa.large_string(), from_pandas=True)))

    return docs.withColumn("score", scored.asNondeterministic()(F.col(text_col)))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels").filter(fold_of("doc_id", 3) != 1))
    return score_texts(docs, model).select("doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
