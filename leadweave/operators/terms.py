"""Terms of a table in texts: what targeting's ordered conditions do for a few fixed terms, as joins by equality for any number.

A text can only hold a term if it holds all of its pieces: its words, or its runs of three signs where a term may begin and
end within words. Each term is filed under the one piece that fewest texts hold, so that a piece of many texts finds few terms;
texts meet terms by equal pieces, and what meets is verified. Equal texts are looked at once, and only
their numbers travel with pieces. A term with a piece that no text
holds meets nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.extract import LEGAL_SUFFIXES
from .lineage import cut_lineage

#: Signs of a run; terms shorter than that are filed whole.
RUN = 3
#: What \\b stands between; both sides of a match must differ in it.
WORD = r"(?U)\w+"


def words_of(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(WORD), F.lit(0)))


def runs_of(c: Column, size: int) -> Column:
    places = F.sequence(F.lit(1), F.greatest(F.length(c) - size + 1, F.lit(1)))
    return F.array_distinct(F.when(F.length(c) >= size, F.transform(places, lambda i: c.substr(i, F.lit(size)))).otherwise(F.array().cast("array<string>")))


def at_boundaries(text: Column, term: Column) -> Column:
    quoted = F.concat(F.lit(r"(?U)\b\Q"), F.replace(term, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E\b"))
    return F.contains(text, term) & F.rlike(text, quoted)


def found_terms(texts: DataFrame, terms: DataFrame, text: str = "text", term: str = "term", whole_words: bool = True) -> DataFrame:
    """(text, term) for every distinct text and term that stands in it, with word boundaries on both sides or anywhere.

    Both are taken as they are: lower-case them first where case is nothing. Null texts, and null or empty terms, meet nothing.
    """
    kinds = cut_lineage(texts.select(F.col(text).alias("text")).filter("text IS NOT NULL").distinct().withColumn("id", F.monotonically_increasing_id()))
    wanted = cut_lineage(terms.select(F.col(term).alias("term")).filter("term <> ''").distinct())
    if whole_words:
        keyed, needed = kinds.select("id", F.explode(words_of(F.col("text"))).alias("piece")), wanted.select("term", F.explode(words_of(F.col("term"))).alias("piece"))
    else:
        sizes = [r["n"] for r in wanted.select(F.least(F.length("term"), F.lit(RUN)).alias("n")).distinct().collect()]  # RUN at most
        keyed = kinds.select("id", F.explode(F.concat(*[runs_of(F.col("text"), n) for n in sizes] or [F.array().cast("array<string>")])).alias("piece"))
        needed = F.when(F.length("term") < RUN, F.array("term")).otherwise(runs_of(F.col("term"), RUN))
        needed = wanted.select("term", F.explode(needed).alias("piece"))
    held = keyed.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    least = F.min_by(F.struct("piece", "n"), F.struct(F.coalesce("n", F.lit(0)), "piece")).alias("_least")
    filed = needed.join(held, "piece", "left").groupBy("term").agg(least).select("term", "_least.*").filter("n > 0").select("term", "piece")
    met = keyed.join(filed, "piece").select("id", "term").join(kinds, "id")
    fits = at_boundaries(F.col("text"), F.col("term")) if whole_words else F.contains("text", F.col("term"))
    found = met.filter(fits).select("text", "term")
    if whole_words:  # terms of signs only have no words
        signs = wanted.filter(~F.rlike("term", F.lit(WORD)))
        if not signs.isEmpty():
            found = found.unionByName(found_terms(kinds.select("text"), signs, whole_words=False).filter(at_boundaries(F.col("text"), F.col("term"))))
    return found


def first_term(rows: DataFrame, terms: DataFrame, text: str, columns: list[str], order: str = "ord", whole_words: bool = True) -> DataFrame:
    """``rows`` with ``columns`` of the term of least order that stands in the text, case aside; null where none does.

    terms: (term, order, columns). Rows meet their text's answer by equality, so that a text of many rows is answered once.
    """
    low = terms.withColumn("_term", F.lower("term"))
    least = low.groupBy("_term").agg(F.min(F.struct(F.col(order).alias("ord"), *columns)).alias("_best"))
    found = found_terms(rows.select(F.lower(text).alias("text")), low.select(F.col("_term").alias("term")), whole_words=whole_words)
    best = found.join(least, found["term"] == least["_term"]).groupBy(F.col("text").alias("_text")).agg(F.min("_best").alias("_best"))
    return rows.withColumn("_text", F.lower(text)).join(best, "_text", "left").select(*rows.columns, *[F.col(f"_best.{c}").alias(c) for c in columns])


def company_terms(name: Column) -> Column:
    """The words of a name that tell companies apart: over two signs, and no legal suffix."""
    return F.array_distinct(F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda t: (F.length(t) > 2) & ~t.isin(*LEGAL_SUFFIXES)))


def first_card_of_companies(companies: DataFrame, cards: DataFrame, name: str = "company_name") -> DataFrame:
    """(name, card) for each company: of the cards (rank, text, ...) that hold one of its words, the first; cards name no company.

    A term keeps its first card before companies meet it, so that a word of many companies and many cards is no product. A name
    without such words fits all cards, and gets the first of all. Companies that no card fits are left out.
    """
    names = companies.select(F.col(name).alias("name")).filter("name IS NOT NULL").distinct().withColumn("terms", company_terms(F.col("name")))
    names = cut_lineage(names)
    shown = cards.filter("text IS NOT NULL").withColumn("_low", F.lower("text"))
    card = F.struct("rank", *[c for c in cards.columns if c != "rank"])
    by_text = shown.groupBy(F.col("_low").alias("text")).agg(F.min(card).alias("card"))
    own = names.select("name", F.explode("terms").alias("term"))
    by_term = found_terms(by_text, own, whole_words=False).join(by_text, "text").groupBy("term").agg(F.min("card").alias("card"))
    any_card = shown.groupBy().agg(F.min(card).alias("card")).filter("card IS NOT NULL").select(F.lit("").alias("term"), "card")
    own = own.unionByName(names.filter(F.size("terms") == 0).select("name", F.lit("").alias("term")))
    return own.join(by_term.unionByName(any_card), "term").groupBy("name").agg(F.min("card").alias("card"))
