"""Spelling variants: a symmetric-delete join of all words.

Words are runs of letters, with A-Z in lower case. Every word emits itself and its single deletions, each with the place
deleted. Shared keys meet in one shuffle by key, and what lies under a key is verified by place: a word and a deletion that
equals it are one insertion apart; two deletions at the same place are one replacement apart, since both words agree
everywhere else; two deletions at different places are two edits apart and do not count. So the rows of a key and place are
all near one another, and what each of them needs of the others (how many, and the best) comes from a window over the
group; pairs are never written. A group has at most one row for each sign that fits the place, however large the corpus.

A word's form is its near word of largest count, if that is at least twice its own. Counts double along a chain of forms, so
that pointers joined with themselves reach the roots in a few rounds, each twice as far as the one before.

Cases: a null text has no words; a null id counts as empty text. Repeated rows count as often as they occur, as do equal
words of a text. Ties of count go to the smaller word in code-point order. Long texts count whole. A word without near words
is its own root. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_table_sql, crc32_sql, cut_lineage, table

LETTERS = "A-Za-zÀ-ÿ"
SHORTEST, LEAST = 5, 3
#: One in so many runs of a document loses a letter.
DROPPED = 97
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def without(word: Column, at: Column) -> Column:
    """The word without the code point at a place from 0."""
    return F.concat(word.substr(F.lit(1), at), word.substr(at + 2, F.length(word)))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, least: int = LEAST, dropped: int = DROPPED) -> DataFrame:
    """(word, n) of the words with at least ``shortest`` letters that occur ``least`` times.

    A run whose crc32 with its document's id is divisible by ``dropped`` loses one letter. Shorter runs make no word, so
    they are not taken out of the text.
    """
    runs = F.regexp_extract_all(F.translate(text_col, UPPER, LOWER), F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    word = F.when(F.col("h") % dropped == 0, without(F.col("run"), (F.col("h") % F.length("run")).cast("int"))).otherwise(F.col("run"))
    return rows.select(word.alias("word")).filter(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def emitted(words: DataFrame) -> DataFrame:
    """(word, n) -> (key, at, fresh, word, n): the word itself at place -1, and its deletions by place.

    Equal deletions come from runs of one letter; only the first place of a run is fresh.
    """
    word, last = F.col("word"), F.length("word") - 1

    def deletion(i: Column) -> Column:
        fresh = (i == 0) | (word.substr(i, F.lit(1)) != word.substr(i + 1, F.lit(1)))
        return F.struct(without(word, i).alias("key"), i.alias("at"), fresh.alias("fresh"))

    itself = F.array(F.struct(word.alias("key"), F.lit(-1).alias("at"), F.lit(True).alias("fresh")))
    keys = F.concat(itself, F.transform(F.sequence(F.lit(0), last), deletion))
    return words.select("word", "n", F.explode(keys).alias("k")).select("k.key", "k.at", "k.fresh", "word", "n")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n) -> (word, n_near, best): how many words are one edit away, and (-n, word) of the best, for those that have any."""
    one = F.struct((-F.col("n")).alias("m"), F.col("word").alias("other"))
    key, place = Window.partitionBy("key"), Window.partitionBy("key", "at")
    ranked = place.orderBy(F.desc("n"), "word")
    whole = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    itself, shorter = F.col("at") < 0, (F.col("at") >= 0) & F.col("fresh")
    met = emitted(words).select(
        "word", "at", "fresh",
        F.count(F.when(shorter, 1)).over(key).alias("longer"), F.min(F.when(shorter, one)).over(key).alias("longer_best"), F.min(F.when(itself, one)).over(key).alias("key_word"),
        F.count(F.lit(1)).over(place).alias("like"), F.row_number().over(ranked).alias("rank"), F.first(one).over(whole).alias("first"), F.nth_value(one, 2).over(whole).alias("second"),
    )
    inserted = F.col("fresh") & F.col("key_word").isNotNull()
    near = F.when(itself, F.col("longer")).otherwise(F.col("like") - 1 + inserted.cast("int"))
    replaced = F.when(F.col("rank") == 1, F.col("second")).otherwise(F.col("first"))
    best = F.when(itself, F.col("longer_best")).otherwise(F.least(replaced, F.when(inserted, F.col("key_word"))))
    found = met.select("word", near.alias("near"), best.alias("best")).filter("near > 0")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) without cycles -> (word, root), by pointers that double their reach each round."""
    state, done = cut_lineage(forms.select("word", F.col("form").alias("root"))), []
    while not state.isEmpty():
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        for part in done[-1:]:
            ahead = ahead.unionByName(part.select(F.col("word").alias("root"), F.col("root").alias("next")))
        moved = cut_lineage(state.join(ahead, "root", "left"))
        ended = moved.filter("next IS NULL").select("word", "root")
        done.append(ended if not done else cut_lineage(done[-1].unionByName(ended)))
        state = moved.filter("next IS NOT NULL").select("word", F.col("next").alias("root"))
    return done[-1] if done else forms.select("word", F.col("form").alias("root"))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", factor: int = 2, **counting) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = cut_lineage(word_counts(docs, id_col, text_col, **counting))
    formed = F.when(-F.col("best.m") >= factor * F.col("n"), F.col("best"))
    found = cut_lineage(words.join(near_words(words), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), formed.alias("to")))
    found = found.select("word", "n", "n_near", F.col("to.other").alias("form"), (-F.col("to.m")).alias("form_n"))
    ends = roots(found.filter("form IS NOT NULL").select("word", "form"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = f"""
WITH RECURSIVE crc_table AS ({crc_table_sql()}),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-zÀ-ÿ]+')) AS run FROM documents),
kinds AS (SELECT id, run, count(*) AS times FROM runs WHERE length(run) >= {SHORTEST} GROUP BY id, run),
hashed AS (SELECT run, times, {crc32_sql("id || ':' || run")} AS h FROM kinds, crc_table),
spelled AS (SELECT CASE WHEN h % {DROPPED} = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, times FROM hashed),
words AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM spelled WHERE length(word) >= {SHORTEST} GROUP BY word HAVING sum(times) >= {LEAST}),
cut AS (SELECT word, n, substr(word, 1, CAST(i AS INT)) || substr(word, CAST(i AS INT) + 2) AS rest, i FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (
  SELECT DISTINCT a.word AS a, b.word AS b FROM words a JOIN cut b ON a.word = b.rest
  UNION SELECT DISTINCT b.word, a.word FROM words a JOIN cut b ON a.word = b.rest
  UNION SELECT a.word, b.word FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word),
ranked AS (SELECT p.a AS word, p.b AS other, w.n AS m, count(*) OVER (PARTITION BY p.a) AS n_near, row_number() OVER (PARTITION BY p.a ORDER BY w.n DESC, encode(p.b)) AS rank FROM pairs p JOIN words w ON w.word = p.b),
formed AS (SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.m >= 2 * w.n THEN r.other END AS form, CASE WHEN r.m >= 2 * w.n THEN r.m END AS form_n FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.rank = 1),
walk AS (SELECT word, word AS at FROM formed UNION ALL SELECT walk.word, f.form FROM walk JOIN formed f ON f.word = walk.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, walk.at AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n
FROM formed f JOIN walk ON walk.word = f.word JOIN formed e ON e.word = walk.at AND e.form IS NULL
"""
