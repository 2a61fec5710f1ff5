"""Toxicity scores from a learned lexicon, found with Levenshtein automata.

The lexicon holds the words, and the beginnings of words (written ``stem*``), of which labelled texts prove that they tell
toxic from clean. A term is tested by its own texts alone, however few of all toxic texts they are: so many of them must be
toxic that chance (the binomial tail's Chernoff bound, over all words tried) hardly explains it. Clean texts that only quote
or report it do not count against it, nor such toxic texts for it. What a term weighs is its precision: the share of toxic
ones among the texts in which no more precise term explains the label, drawn towards that among all its texts. Terms
that weigh too little are left out, and what they explained falls to others, until none is.

All terms form one trie. The words of a text run through the product of that trie and the terms' Levenshtein automata, made
deterministic as states are met, so that misspelled terms are found without trying each term. Each find weighs as much as
its term, or its term at that distance, has proved in the labelled texts; the words and signs around it raise that weight
(address) or lower it (quotation, report) by factors that start from stated priors and move with what labelled texts with
such finds show. A text's score is the chance that any of its finds is abuse, each taken to be independent.

Learning uses at most ``fit_rows`` labelled rows (those with the smallest hash of the id), of equal texts one. Scoring
covers all rows and whole texts.

Cases: null and empty texts, and texts without finds, get the lowest score. Rows without a label or with a null one teach
nothing; of several labels for an id the highest counts. If nothing is learned, all get the lowest score. Repeated rows are
scored once each. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, kept, table
from .language import fold_of

FIT_ROWS = 40_000
MAX_TERMS = 5_000
#: Terms expected to be learned by chance, were the labels dealt at random, and the least share of toxic ones among a term's texts.
CHANCE, LEAST_SHARE = 1.0, 0.8
#: What a kept term weighs at least, and how often terms that weigh less are dropped and their texts dealt out anew.
LEAST_WEIGHT, ROUNDS = 0.8, 20
#: Texts' weight with which a term's precision in all its texts stands beside that in the texts left to it.
OWN_TEXTS = 2.0
#: Lengths of the beginnings that may become stems.
STEMS = (4, 5, 6, 7)
#: Taken for misspelled terms before any is seen in labelled texts, by distance, with this many texts' weight.
PRIOR, PRIOR_TEXTS = {1: 0.8, 2: 0.6}, 2.0
#: What a context does to a find's weight before any is seen in labelled texts, with this many texts' weight, and the bounds.
CONTEXTS, CONTEXT_TEXTS, FACTORS = {"quoted": 0.5, "reported": 0.7, "addressed": 1.3}, 20.0, (0.02, 2.0)
LOWEST = 0.01
WINDOW = 4
#: Words that tell of speech or address near a term.
REPORTING = frozenset("said says called quote quoted word term means wrote sagte nannte wort zitat dit appelé mot citation dijo llamó palabra cita".split())
ADDRESS = frozenset("you your you're youre u du dich dein ihr tu te toi ton vous tú ti tus usted".split())
OPENING, CLOSING = "\"“„«‘'", "\"”“»’'"
WORD = re.compile(r"[^\W_]+(?:[*@$!'’_-][^\W_]+)*")


def allowed_edits(term: str) -> int:
    return 0 if len(term) < 4 else 1 if len(term) < 8 else 2


class TermAutomaton:
    """Trie x Levenshtein automata, determinised lazily. A state is the set of (trie node, edits) reached."""

    def __init__(self, allowed: dict[str, int], most_states: int = 60_000):
        """allowed: the most edits of each term; one that ends in * is found as the beginning of words, without edits."""
        self.terms, self.most_states = sorted(allowed), most_states
        self.allowed = [allowed[t] for t in self.terms]
        self.stem_end: dict[int, int] = {}  # where a stem ends -> the node that then takes any letters
        self.children: list[dict[str, int]] = [{}]
        self.term_at: list[int] = [-1]
        self.most: list[int] = [0]  # edits that some term below may have
        for k, term in enumerate(self.terms):
            node, edits = 0, self.allowed[k]
            self.most[0] = max(self.most[0], edits)
            for c in term.removesuffix("*"):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term_at.append(-1)
                    self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], edits)
            if term.endswith("*"):
                self.stem_end[node] = node = len(self.children)
                self.children.append({})
                self.term_at.append(-1)
                self.most.append(0)
            self.term_at[node] = k
        self.after_stem = frozenset(self.stem_end.values())
        self.alphabet = frozenset(c for kids in self.children for c in kids)
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.found: list[list[tuple[int, int]]] = []
        self.start = self._state({0: 0} if self.terms else {})

    def _state(self, nodes: dict[int, int]) -> int:
        todo = list(nodes.items())  # skipping a term's letter costs an edit
        while todo:
            node, e = todo.pop()
            if nodes.get(node, 99) < e:
                continue
            for kid in self.children[node].values():
                if e + 1 <= self.most[kid] and e + 1 < nodes.get(kid, 99):
                    nodes[kid] = e + 1
                    todo.append((kid, e + 1))
        for node, e in list(nodes.items()):
            if e == 0 and node in self.stem_end:
                nodes[self.stem_end[node]] = 0
        key = frozenset(nodes.items())
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.next.append({})
            self.found.append([(e, k) for n, e in nodes.items() if (k := self.term_at[n]) >= 0 and e <= self.allowed[k]])
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        after: dict[int, int] = {}
        for node, e in self.states[state]:
            if node in self.after_stem:
                after[node] = 0
                continue
            for letter, kid in self.children[node].items():
                cost = e + (letter != c)
                if cost <= self.most[kid] and cost < after.get(kid, 99):
                    after[kid] = cost
            if e + 1 <= self.most[node] and e + 1 < after.get(node, 99):
                after[node] = e + 1
        return self._state(after) if after else -1

    def find(self, word: str) -> list[tuple[int, int]]:
        """(edits, term number) of every term within its allowed edits of the word."""
        if len(self.states) > self.most_states:
            self._reset()
        state = self.start
        for c in word:
            c = c if c in self.alphabet else ""
            after = self.next[state].get(c)
            if after is None:
                after = self.next[state][c] = self._step(state, c)
            if after < 0:
                return []
            state = after
        return self.found[state]


class Lexicon(dict):
    """term -> {edits: chance that a find is abuse}, with the factors of the contexts."""

    def __init__(self, weights=(), factors: dict[str, float] = CONTEXTS):
        super().__init__(weights)
        self.factors = dict(factors)

    def __reduce__(self):
        return Lexicon, (dict(self), self.factors)


def tokens_of(lowered: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), m.group()) for m in WORD.finditer(lowered)]


def is_quoted(text: str, a: int, b: int) -> bool:
    return a > 0 and text[a - 1] in OPENING and b < len(text) and text[b] in CLOSING


def contexts_of(text: str, tokens: list[tuple[int, int, str]], i: int) -> list[str]:
    """Which contexts the i-th word stands in."""
    near = [w for _, _, w in tokens[max(0, i - WINDOW) : i] + tokens[i + 1 : i + 1 + WINDOW]]
    out = ["quoted"] if is_quoted(text, *tokens[i][:2]) else []
    if any(w in REPORTING for w in near):
        out.append("reported")
    if any(w in ADDRESS for w in near):
        out.append("addressed")
    return out


class Scorer:
    """weights: a Lexicon, or a plain dict of the same shape."""

    def __init__(self, weights: dict[str, dict[int, float]]):
        self.weights, self.factors = weights, getattr(weights, "factors", CONTEXTS)
        self.automaton = TermAutomaton({t: max(w) for t, w in weights.items()})
        self.seen: dict[str, tuple[str, int, float] | None] = {}

    def best(self, word: str) -> tuple[str, int, float] | None:
        """The term that weighs most of those found: (term, edits, weight)."""
        if word in self.seen:
            return self.seen[word]
        found = [(self.weights[t].get(e, 0.0), -e, t) for e, k in self.automaton.find(word) for t in [self.automaton.terms[k]]]
        out = None
        if found:
            weight, edits, term = max(found)
            out = (term, -edits, weight)
        if len(self.seen) < 100_000:
            self.seen[word] = out
        return out

    def matches(self, text: str) -> list[tuple[int, int, str, int, float, float]]:
        """(start, end, term, edits, weight, context) of each find."""
        lowered = text.lower()
        if not any(self.best(w) for w in set(WORD.findall(lowered))):
            return []
        tokens = tokens_of(lowered)
        out = []
        for i, (a, b, word) in enumerate(tokens):
            if hit := self.best(word):
                out.append((a, b, *hit, math.prod(self.factors[c] for c in contexts_of(lowered, tokens, i))))
        return out

    def score(self, matches: list[tuple]) -> float:
        clear = 1.0 - LOWEST
        for *_, weight, context in matches:
            clear *= 1.0 - min(0.999, weight * context)
        return 1.0 - clear


def plain_words(text: str) -> set[str]:
    """The words of a text that it neither only quotes nor only reports."""
    lowered = text.lower()
    tokens = tokens_of(lowered)
    told = {j for i, (_, _, w) in enumerate(tokens) if w in REPORTING for j in range(i - WINDOW, i + WINDOW + 1) if j != i}
    return {w for i, (a, b, w) in enumerate(tokens) if i not in told and not is_quoted(lowered, a, b)}


def _words(batches):
    """Distinct plain words of each text, and their beginnings, counted by label."""
    counts = {0: Counter(), 1: Counter()}
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = plain_words(text or "")
            counts[toxic].update(words)
            counts[toxic].update({w[:n] + "*" for w in words for n in STEMS if len(w) > n})
    both = list(counts[1].keys() | counts[0].keys())
    yield pa.RecordBatch.from_arrays([pa.array(both, pa.string()), pa.array([counts[1][w] for w in both], pa.int64()), pa.array([counts[0][w] for w in both], pa.int64())], names=["word", "toxic", "clean"])


def labelled(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(text, toxic) of a bounded number of labelled rows, equal texts once. The labels broadcast are ``fit_rows`` at most."""
    chosen = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return rows.groupBy(F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"), "toxic").agg(F.first("text").alias("text")).select("text", "toxic")


Find = tuple[str, int, str]  # term, edits, context


def finds_of(automaton: TermAutomaton, text: str) -> set[Find]:
    """Every term found in a text, at each distance and in each context: quoted, else reported, else addressed, else ''."""
    lowered = text.lower()
    hits = {w: found for w in set(WORD.findall(lowered)) if (found := automaton.find(w))}
    out: set[Find] = set()
    if hits:
        tokens = tokens_of(lowered)
        for i, (_, _, word) in enumerate(tokens):
            if word in hits:
                context = (contexts_of(lowered, tokens, i) or [""])[0]
                out.update((automaton.terms[k], e, context) for e, k in hits[word])
    return out


def explained_by(finds: list[Find], own: dict[str, float]) -> list[Find]:
    """What explains a text's label, of the terms in ``own``: its most precise plain find; without one, its most precise
    quoted or reported find; without an exact one, each of its misspelled terms."""
    exact = [f for f in finds if f[1] == 0 and f[0] in own]
    if not exact:
        return sorted({(term, e, "") for term, e, _ in finds if term in own})
    plain = [f for f in exact if f[2] in ("", "addressed")]
    _, term = max((own[f[0]], f[0]) for f in plain or exact)
    around = {f[2] for f in plain or exact if f[0] == term}
    return [(term, 0, next(c for c in ("addressed", "reported", "", "quoted") if c in around))]


def learn_weights(rows: DataFrame, max_terms: int = MAX_TERMS, chance: float = CHANCE, least_share: float = LEAST_SHARE) -> Lexicon:
    """From (text, toxic): the terms, what a find at each distance weighs, and what contexts do to it."""
    rows = cut_lineage(rows)  # the documents are read once for it
    totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals.get(1) or not totals.get(0):
        return Lexicon()
    counts = cut_lineage(rows.mapInArrow(_words, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).filter("toxic > 0"))
    share = totals[1] / (totals[0] + totals[1])
    least = math.log(max(1, counts.count()) / chance)
    both = F.col("toxic") + F.col("clean")
    evidence = F.col("toxic") * F.log(F.col("toxic") / both / share) + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / both / (1 - share))).otherwise(0.0)
    precision = F.col("toxic") / (both + 1.0)
    terms = counts.select("word", evidence.alias("evidence"), precision.alias("precision"), (F.col("toxic") > share * both).alias("more"))
    terms = terms.filter(F.col("more") & (F.col("evidence") >= least) & (F.col("toxic") >= least_share * both)).orderBy(F.desc("evidence"), "word").limit(max_terms).collect()
    own = {r["word"]: r["precision"] for r in terms}
    tried = {t: 0 if t.endswith("*") else allowed_edits(t) for t in own}
    automaton = TermAutomaton(tried)

    def held(batches):
        for batch in batches:
            found = [sorted(finds_of(automaton, text or "")) for text in batch.column(0).to_pylist()]
            keep = [i for i, f in enumerate(found) if f]
            lists = pa.array([[dict(zip(("term", "edits", "context"), f, strict=True)) for f in found[i]] for i in keep], pa.list_(pa.struct([("term", pa.string()), ("edits", pa.int32()), ("context", pa.string())])))
            yield pa.RecordBatch.from_arrays([lists, batch.column(1).cast(pa.int32()).take(pa.array(keep, pa.int64()))], names=["finds", "toxic"])

    texts = cut_lineage(rows.mapInArrow(held, "finds array<struct<term:string,edits:int,context:string>>, toxic int"))
    for _ in range(ROUNDS):
        seen = _explained(texts, own)
        lexicon = weigh(own, tried, seen)
        if len(lexicon) == len(own):
            break
        own = {t: own[t] for t in lexicon}  # what a dropped term explained falls to others
    return lexicon


def _explained(texts: DataFrame, own: dict[str, float]) -> Counter:
    """How many texts of each label each (term, edits, context) explains."""

    def count(batches):
        found = Counter()
        for batch in batches:
            for finds, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.update((*f, toxic) for f in explained_by([(f["term"], f["edits"], f["context"]) for f in finds], own))
        kinds = (pa.string(), pa.int32(), pa.string(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in found], kind) for i, kind in enumerate(kinds)] + [pa.array(list(found.values()), pa.int64())], names=["term", "edits", "context", "toxic", "n"])

    seen: Counter = Counter()
    for r in texts.mapInArrow(count, "term string, edits int, context string, toxic int, n long").groupBy("term", "edits", "context", "toxic").agg(F.sum("n").alias("n")).collect():
        seen[r["term"], r["edits"], r["context"], r["toxic"]] = r["n"]
    return seen


def weigh(own: dict[str, float], tried: dict[str, int], seen: Counter) -> Lexicon:
    """The lexicon from each term's precision in all its texts, its most edits, and texts explained by (term, edits, context, label)."""

    def rate(toxic: float, clean: float, prior: float, texts: float) -> float:
        return (toxic + texts * prior) / (toxic + clean + texts)

    def of(term: str, e: int, label: int) -> int:
        return sum(seen[term, e, context, label] for context in ("", "addressed"))

    weights = {t: {0: w} for t, p in own.items() if (w := rate(of(t, 0, 1), of(t, 0, 0), p, OWN_TEXTS)) >= LEAST_WEIGHT}
    for e, prior in PRIOR.items():
        overall = rate(*(sum(of(t, e, label) for t in weights) for label in (1, 0)), prior, PRIOR_TEXTS)
        for t, w in weights.items():
            if e <= tried[t]:
                w[e] = w[0] * rate(of(t, e, 1), of(t, e, 0), overall, PRIOR_TEXTS)
    factors = {}
    for context, prior in CONTEXTS.items():
        toxic = sum(seen[t, 0, context, 1] for t in weights)
        expected = sum(w[0] * (seen[t, 0, context, 1] + seen[t, 0, context, 0]) for t, w in weights.items())
        factors[context] = min(FACTORS[1], max(FACTORS[0], (toxic + CONTEXT_TEXTS * prior) / (expected + CONTEXT_TEXTS)))
    return Lexicon(weights, factors)


def _scorer(weights: dict[str, dict[int, float]]) -> Scorer:
    return kept("toxicity", hash(str((sorted(weights.items()), getattr(weights, "factors", CONTEXTS)))), lambda: Scorer(weights))


def score_texts(docs: DataFrame, weights: dict[str, dict[int, float]], text_col: str = "text", finds: bool = False) -> DataFrame:
    """All columns of ``docs`` with score and, if asked for, the finds; in place, without a shuffle."""
    names = {c.lower() for c in docs.columns}
    spare = next(n for n in ("_text", *(f"_text{i}" for i in range(len(names) + 1))) if n not in names)
    shape = "score double" + ", finds array<struct<start:int,end:int,term:string,edits:int,weight:double,context:double>>" * finds

    @F.pandas_udf(shape)
    def scored(column: pd.Series) -> pd.DataFrame:
        scorer = _scorer(weights)
        found = [scorer.matches(t) if t else [] for t in column]
        out = {"score": [scorer.score(m) for m in found]}
        if finds:
            out["finds"] = [[dict(zip(("start", "end", "term", "edits", "weight", "context"), x, strict=True)) for x in m] for m in found]
        return pd.DataFrame(out)

    new = ["score", *["finds"] * finds]
    kept = [c for c in docs.columns if c not in new]
    return docs.withColumn(spare, scored.asNondeterministic()(F.col(text_col))).select(*kept, *[F.col(f"{spare}.{c}") for c in new])


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold_of("doc_id", 5) == 0).alias("held_out"))
    train = table(spark, sf_dir, "labels").filter(fold_of("doc_id", 5) != 0)
    weights = learn_weights(labelled(docs, train))
    return score_texts(docs, weights).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
