"""Language identification by rank-order profiles.

A language's profile is its most frequent letter n-grams (one to three letters; words are set off by a space) in order of
frequency, counted over all training texts. A text's own most frequent n-grams, in their order, are compared to each
profile: the out-of-place distance sums how far each n-gram's rank is from its rank there, a full profile length where
it is missing. The nearest profile wins; ties go to the first language by name.

Cases: a text that is null, empty or without letters is `und` with score 0. Rows without a language teach nothing; if no
row teaches, all are `und`. With one language learned, its score is the closeness to it. Whole texts count, however long;
repeated rows count as often as they occur. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import kept, table

PROFILE = 400
CHUNK_CHARS = 1 << 18
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter; made once for each process."""
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)], dtype=bool))
    return _letters[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of the texts, in order, as numbers of 3 x 21 bits, and how many come before each text and in all."""
    lowered = [t.lower() + "\n" for t in texts]
    code = np.frombuffer("".join(lowered).encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.int64)
    ends = np.cumsum([len(t) for t in lowered])
    code = np.where(letters()[code], code, 0)
    keep = code != 0
    keep[1:] |= code[:-1] != 0
    keep[ends - 1] = True  # each text ends with a gap of its own
    before = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], ends])]
    code = code[keep]
    last = np.zeros(len(code), dtype=bool)
    last[before[1:] - 1] = True
    left = np.concatenate([[0], np.where(last, 0, code)[:-1]])  # the sign before, a gap at a text's start
    right = np.append(code[1:], 0)
    solid = code != 0
    out = np.empty((len(code), 3), dtype=np.int64)
    out[:, 0] = code
    out[:, 1] = (left << 21) | code
    out[:, 2] = (left << 42) | (code << 21) | right
    keep = np.empty((len(code), 3), dtype=bool)
    keep[:, 0] = solid
    keep[:, 1] = (solid | (left != 0))
    keep[:, 2] = solid
    flat = keep.ravel()
    counts = np.concatenate([[0], np.cumsum(flat)])[before * 3]
    # A bigram's high bit tells it from a unigram or trigram of the same number.
    out[:, 1] |= 1 << 62
    return out.ravel()[flat], counts


def most_frequent(g: np.ndarray, n: int) -> np.ndarray:
    """The n most frequent, most frequent first; ties by number."""
    kinds, counts = np.unique(g, return_counts=True)
    return kinds[np.lexsort((kinds, -counts))[:n]]


def _runs(texts: list[str]):
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) < CHUNK_CHARS):
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


def learn_profiles(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", length: int = PROFILE) -> dict[str, list[int]]:
    """Each language's n-grams in order. Counts cover all rows; the driver gets ``length`` numbers a language."""

    def count(batches):
        total: dict[str, list] = {}

        def fold(parts):
            kinds, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return [(kinds, np.bincount(where, weights=np.concatenate([p[1] for p in parts])).astype(np.int64))]

        for batch in batches:
            frame = pd.DataFrame({"lang": batch.column(0).to_pylist(), "text": batch.column(1).to_pylist()})
            for lang, own in frame.groupby("lang"):
                texts = own["text"].tolist()
                for a, b in _runs(texts):
                    parts = total.setdefault(lang, [])
                    parts.append(np.unique(grams(texts[a:b])[0], return_counts=True))
                    if len(parts) > 16:
                        total[lang] = fold(parts)
        for lang, parts in total.items():
            [(kinds, counts)] = fold(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(kinds), pa.string()), pa.array(kinds, pa.int64()), pa.array(counts, pa.int64())], names=["lang", "gram", "n"])

    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("rank") <= length)
    profiles: dict[str, list[int]] = {}
    for r in ranked.orderBy("lang", "rank").toLocalIterator():
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


class Profiles:
    def __init__(self, profiles: dict[str, list[int]], length: int):
        self.langs = sorted(profiles)
        self.length = length
        self.known = np.unique(np.array([g for p in profiles.values() for g in p], dtype=np.int64))
        self.ranks = np.full((len(self.known) + 1, len(self.langs)), -1, dtype=np.int64)
        for j, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.known, profiles[lang]), j] = np.arange(len(profiles[lang]))

    def closest(self, g: np.ndarray) -> tuple[str, float]:
        """The language, and how clearly it is nearer than the next: 1 - (its distance / the next's)."""
        if not len(g) or not self.langs:
            return "und", 0.0
        top = most_frequent(g, self.length)
        at = np.minimum(np.searchsorted(self.known, top), max(len(self.known) - 1, 0))
        rank = np.where((self.known[at] == top)[:, None], self.ranks[at], -1)
        off = np.where(rank < 0, self.length, np.abs(rank - np.arange(len(top))[:, None])).sum(axis=0)
        best = int(off.argmin())
        if len(off) == 1:
            return self.langs[0], 1.0 - float(off[0]) / (self.length * len(top))
        other = np.delete(off, best).min()
        return self.langs[best], 1.0 - float(off[best]) / float(other) if other else 0.0


def identify(docs: DataFrame, profiles: dict[str, list[int]], text_col: str = "text", length: int = PROFILE) -> DataFrame:
    """All columns of ``docs`` with lang_pred and score, in place, without a shuffle."""
    names = {c.lower() for c in docs.columns}
    spare = next(n for n in ("_text", *(f"_text{i}" for i in range(len(names) + 1))) if n not in names)

    @F.pandas_udf("lang_pred string, score double")
    def predict(column: pd.Series) -> pd.DataFrame:
        model = _model(profiles, length)
        texts = [t if t is not None else "" for t in column]
        out = []
        for a, b in _runs(texts):
            g, before = grams(texts[a:b])
            out += [model.closest(g[i:j]) for i, j in zip(before, before[1:], strict=False)]
        return pd.DataFrame(out, columns=["lang_pred", "score"])

    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.withColumn(spare, predict.asNondeterministic()(F.col(text_col))).select(*kept, F.col(f"{spare}.lang_pred"), F.col(f"{spare}.score"))


def _model(profiles: dict[str, list[int]], length: int) -> Profiles:
    """Built once for each batch's closure at most."""
    key = hash((length, tuple((k, tuple(v)) for k, v in sorted(profiles.items()))))
    return kept("language", key, lambda: Profiles(profiles, length))


def fold_of(id_col: str, folds: int):
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (fold_of("doc_id", 4) == 2).alias("held_out"))
    profiles = learn_profiles(docs.filter("NOT held_out"))
    return identify(docs.drop("lang"), profiles).select("doc_id", "held_out", "lang_pred", "score")
