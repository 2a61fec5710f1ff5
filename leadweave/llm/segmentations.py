"""Sampled SentencePiece segmentations without replacement, and decoding.

A text's lattice has an edge for each piece of the vocabulary that fits. A segmentation's probability is proportional to the
product of its pieces' weights. No piece crosses the start of a word, so the lattice is a chain of word lattices, each
small, and its total weight their product.

Segmentations are drawn without replacement by Gumbel top-k: the k with the largest log probability plus Gumbel noise. The
search is A-star from the top: an agenda holds disjoint sets of segmentations, each with the exact maximum of its perturbed
log probabilities (a Gumbel variable at the logarithm of its weight, truncated at its parent's), best first. Popping a set
yields its best segmentation: the words fixed so far, one word drawn from what is left of it, the others drawn freely
(forward filtering, backward sampling). What is left falls into one set for each word at which the first difference may
be. A sample's inclusion score is 1 - exp(-exp(l - z)), l its log probability, z the perturbed value after the last sample's.

All noise comes from a generator seeded by the row's key. The vocabulary file holds merge ranks, not probabilities: a piece's
log probability is taken from its rank by Zipf's law. Signs that are no piece are spelled in bytes.

A word that may no longer be some of its segmentations is drawn anew until it is another; where that takes long, one is drawn
from its others, best first, as many as it takes.

Cases: null and empty texts have one segmentation, the empty one, with log probability 0 and inclusion 1. Texts with fewer
segmentations than asked for give all they have. Repeated rows give the same samples. Null keys share a seed. Other columns
are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, kept, mix, table

SAMPLES = 2
SPACE = "▁"
#: Text of one round of array work, and letters of distinct words whose lattices (about 80 bytes a letter) a worker keeps
#: for the next rounds.
BATCH_CHARS, KEPT_LETTERS = 1_000_000, 3_000_000
#: Draws of a word that must differ, after which its other segmentations are walked.
MOST_DRAWS = 84
#: A difference of weights smaller than this share of them is summed up instead, as digits cancel.
CANCELS = 1e-8


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def single(x: float) -> float:
    """Rounded to single precision, in which lattices keep weights."""
    return float(np.float32(x))


class Column:
    """An array that grows at its end."""

    def __init__(self, kind):
        self.data, self.n = np.empty(1024, dtype=kind), 0

    def extend(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.data):
            wider = np.empty(self.n + len(values) + len(self.data) // 2, dtype=self.data.dtype)
            wider[: self.n] = self.data[: self.n]
            self.data = wider
        self.data[self.n : self.n + len(values)] = values
        self.n += len(values)


class Numbers(dict):
    """Numbers words as they are met; ``new`` lists those since it was last emptied."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class Lattices:
    """The lattices of many words, added to as words are met.

    For each end in a word, the pieces that may come last up to there, likeliest first, with the chance of each and of
    those before it, so that one uniform number picks a piece. The segmentation that takes the likeliest piece at every
    step is kept whole with its chance: one uniform number tells whether a word is that one, else where it first differs.
    """

    def __init__(self, vocabulary: "Segmenter"):
        self.vocabulary, self.numbers = vocabulary, Numbers()
        #: For each word: first letter, letters, log weight of all its segmentations, whether it has but one.
        self.starts, self.lengths, self.totals, self.single = Column(np.int64), Column(np.int64), Column(np.float64), Column(bool)
        #: For each letter, its first edge and how many; for each edge, piece, letters, log weight, chance up to it.
        self.first, self.degree = Column(np.int32), Column(np.int8)
        self.ids, self.sizes, self.logs, self.chances = Column(np.int32), Column(np.int8), Column(np.float32), Column(np.float32)
        #: For each word, the likeliest steps' segmentation: where its ids are in ``pool``, how many, log weight, chance.
        self.pool, self.top_first, self.top_count, self.top_log, self.top_chance = Column(np.int32), Column(np.int64), Column(np.int64), Column(np.float64), Column(np.float64)
        self.remains: dict[tuple[int, bytes], float] = {}  # log weight of what a word has besides a heavy segmentation

    def number(self, words: list[str]) -> np.ndarray:
        out = np.fromiter(map(self.numbers.__getitem__, words), dtype=np.int64, count=len(words))
        if self.numbers.new:
            self._add(self.numbers.new)
            self.numbers.new = []
        return out

    def _add(self, words: list[str]) -> None:
        own = self.vocabulary
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        n = len(code)
        word = np.repeat(np.arange(len(words)), lengths)
        place = np.arange(n) - starts[word] + 1
        prefix, inverses = own.prefix(code)
        parts, ends = [], np.arange(n)
        for d in range(1, own.longest + 1):
            at = ends = ends[place[ends] >= d]
            if not len(at):
                break
            keys = (prefix[at + 1] - prefix[at + 1 - d]) * inverses[at + 1 - d]
            if d in own.endings:  # ends of longer pieces only from here on
                ends = at[own.may_end(d, keys)]
            ids, logs = own.find(keys)
            if d == 1:  # spelled in bytes: the letter itself, below zero
                odd = code[ids < 0]
                logs[ids < 0] = own.byte_log * (1 + (odd >= 0x80) + (odd >= 0x800) + (odd >= 0x10000))
                ids[ids < 0] = -1 - odd
                parts.append((at, np.full(len(at), d, np.int8), ids.astype(np.int32), logs))
            else:
                there = ids >= 0
                parts.append((at[there], np.full(np.count_nonzero(there), d, np.int8), ids[there].astype(np.int32), logs[there]))
        # edges by place in the word, then letter
        by_place = np.argsort(place.astype(np.uint16) if lengths.max() < 1 << 16 else place, kind="stable")  # short numbers sort faster
        degree = np.zeros(n, dtype=np.int64)
        for at, *_ in parts:  # an end once in each
            degree[at] += 1
        degree = degree[by_place]
        first = np.cumsum(degree) - degree
        slots = np.empty(n, dtype=np.int64)  # for each letter, where its next edge goes
        slots[by_place] = first
        end, size, ids, logs = (np.empty(int(degree.sum()), dtype=c.dtype) for c in parts[0])
        for at, *values in parts:
            to = slots[at]
            end[to], (size[to], ids[to], logs[to]) = at, values
            slots[at] = to + 1
        slot = np.arange(n) + word + 1  # each word has one more place, before its first letter, of log weight 0
        reach = np.zeros(n + len(words))
        source, chance = slot[end] - size, np.empty(len(end))
        places = np.searchsorted(place[by_place], np.arange(1, int(lengths.max()) + 2))
        for la, lb in zip(places, places[1:], strict=False):
            a, b = first[la], first[lb - 1] + degree[lb - 1]
            ways, seg, times = logs[a:b] + reach[source[a:b]], first[la:lb] - a, degree[la:lb]
            top = np.maximum.reduceat(ways, seg)
            ways = np.exp(ways - np.repeat(top, times))
            sums = np.add.reduceat(ways, seg)
            reach[slot[by_place[la:lb]]] = top + np.log(sums)
            chance[a:b] = ways / np.repeat(sums, times)
        several = np.flatnonzero(np.repeat(degree > 1, degree))
        order = several[np.argsort(np.repeat(np.arange(n), degree)[several] - 0.9999 * chance[several], kind="stable")]
        for column in (size, ids, logs, chance):
            column[several] = column[order]
        sums = np.concatenate([[0.0], np.cumsum(chance)])
        upto = sums[1:] - np.repeat(sums[first], degree)
        upto[first + degree - 1] = 2.0  # the last one takes what is left
        base, letters, edges = self.starts.n, self.first.n, self.ids.n
        at_letter = np.empty(n, dtype=np.int64)
        at_letter[by_place] = first + edges
        self.first.extend(at_letter)
        at_letter[by_place] = degree
        self.degree.extend(at_letter)
        for column, values in ((self.ids, ids), (self.sizes, size), (self.logs, logs), (self.chances, upto), (self.starts, starts + letters), (self.lengths, lengths)):
            column.extend(values)
        self.totals.extend(reach[slot[starts + lengths - 1]])
        self.single.extend(np.maximum.reduceat(at_letter, starts) <= 1)
        self._tops(np.arange(base, base + len(words)))

    def _tops(self, words: np.ndarray) -> None:
        place, starts = self.lengths.data[words].copy(), self.starts.data[words]
        chance, log, counts = np.ones(len(words)), np.zeros(len(words)), np.zeros(len(words), dtype=np.int64)
        alive, taken = np.arange(len(words)), []
        while len(alive):
            edge = self.first.data[starts[alive] + place[alive] - 1]
            taken.append((alive, self.ids.data[edge]))
            chance[alive] *= np.minimum(self.chances.data[edge], np.float32(1))
            log[alive] += self.logs.data[edge]
            counts[alive] += 1
            place[alive] -= self.sizes.data[edge]
            alive = alive[place[alive] > 0]
        self.top_first.extend(self.pool.n + np.cumsum(counts) - counts)
        self.pool.extend(in_order(taken, counts))
        self.top_count.extend(counts)
        self.top_log.extend(log)
        self.top_chance.extend(chance)

    def draw(self, words: np.ndarray, noise, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A segmentation of each word with its chance. noise(which, step): a uniform number for each.

        -> where its ids are (from ``base``: in the array given back, else in ``pool``), how many, log weights, that array.
        """
        luck = noise(np.arange(len(words)), 0)
        first, count, log = self.top_first.data[words], self.top_count.data[words], self.top_log.data[words]
        other = np.flatnonzero(luck >= self.top_chance.data[words])
        luck, starts, place = luck[other], self.starts.data[words[other]], self.lengths.data[words[other]].copy()
        likeliest, chance = np.ones(len(other), dtype=bool), np.ones(len(other))
        sums, counts = np.zeros(len(other)), np.zeros(len(other), dtype=np.int64)
        alive, taken = np.arange(len(other)), []
        while len(alive):
            edge = self.first.data[starts[alive] + place[alive] - 1].astype(np.int64)
            below = noise(other[alive], len(taken) + 1)
            upto = np.minimum(self.chances.data[edge], np.float32(1)).astype(np.float64)
            chance[alive] *= upto
            still = likeliest[alive]
            stays = still & (luck[alive] < chance[alive])
            below = np.where(stays, -1.0, np.where(still, upto + below * (1 - upto), below))  # the first that differs is none of the likeliest
            likeliest[alive] = stays
            going = np.flatnonzero(below >= self.chances.data[edge])
            while len(going):
                edge[going] += 1
                going = going[below[going] >= self.chances.data[edge[going]]]
            taken.append((alive, self.ids.data[edge]))
            sums[alive] += self.logs.data[edge]  # the weights are these single-precision numbers
            counts[alive] += 1
            place[alive] -= self.sizes.data[edge]
            alive = alive[place[alive] > 0]
        first[other], count[other], log[other] = base + np.cumsum(counts) - counts, counts, sums
        return first, count, log, in_order(taken, counts)

    def edges(self, word: int) -> list[list[tuple[int, float, int]]]:
        """For each end in a word, the pieces that may come last: letters, log weight, id."""
        first, length = int(self.starts.data[word]), int(self.lengths.data[word])
        out = []
        for letter in range(first, first + length):
            a = int(self.first.data[letter])
            b = a + int(self.degree.data[letter])
            out.append(list(zip(self.sizes.data[a:b].tolist(), self.logs.data[a:b].tolist(), self.ids.data[a:b].tolist(), strict=True)))
        return out

    def others(self, word: int, barred) -> Iterator[tuple[float, np.ndarray]]:
        """The segmentations of a word that are not barred, heaviest first: log weight, ids in order."""
        edges = self.edges(word)
        heaviest = [0.0]
        for p, ways in enumerate(edges, 1):
            heaviest.append(max(log + heaviest[p - d] for d, log, _ in ways))
        heap, n = [(-heaviest[-1], 0, len(edges), 0.0, ())], 1
        while heap:
            _, _, p, log, tail = heapq.heappop(heap)
            if not p:
                own = np.array(tail, dtype=np.int32)
                if own.tobytes() not in barred:
                    yield log, own
                continue
            for d, own_log, i in edges[p - 1]:
                heapq.heappush(heap, (-(log + own_log + heaviest[p - d]), n, p - d, log + own_log, (i, *tail)))
                n += 1

    def left(self, word: int, barred: dict[bytes, float]) -> float:
        """Log weight of what is not barred; -inf if nothing is."""
        whole = float(self.totals.data[word])
        share = 1.0 - sum(math.exp(v - whole) for v in barred.values())
        if share > CANCELS:
            return whole + math.log(share)
        total, most, ways = 0.0, None, self.ways(word)
        for log, _ in self.others(word, barred):
            most = log if most is None else most
            total += math.exp(log - most)
            if math.exp(log - most) * ways < 1e-12 * total:
                break  # all that follow add nothing to the number
        return -math.inf if most is None else most + math.log(total)

    def another(self, word: int, barred: dict[bytes, float], point: float) -> tuple[float, np.ndarray]:
        """The segmentation that a uniform number picks among those that are not barred: log weight, ids."""
        mass, passed = self.left(word, barred), 0.0
        for log, own in self.others(word, barred):
            passed += math.exp(log - mass)
            if passed >= point:
                break
        return log, own

    def ways(self, word: int) -> float:
        """How many segmentations a word has; infinite for very many."""
        out = [1.0]
        for p, ways in enumerate(self.edges(word), 1):
            out.append(sum(out[p - d] for d, _, _ in ways))
        return out[-1]


def in_order(taken: list[tuple[np.ndarray, np.ndarray]], counts: np.ndarray) -> np.ndarray:
    """The ids of all words in order, from those taken at each step, last piece first."""
    ends = np.cumsum(counts)
    out = np.empty(ends[-1] if len(ends) else 0, dtype=np.int32)
    for step, (which, own) in enumerate(taken):
        out[ends[which] - 1 - step] = own
    return out


class Segmenter:
    """A vocabulary with log probabilities, and sampling with it."""

    BASE = 0x9E3779B97F4A7C15 | 1
    SLOTS = 19

    def __init__(self, path: str, sharpness: float = 1.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces: dict[str, tuple[int, float]] = {}
        self.spelled, self.as_bytes = [0] * 256, [b""] * n
        self.byte_log = single(-sharpness * math.log(n + 2))
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.spelled[int(piece[3:5], 16)] = i
                self.as_bytes[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.pieces[piece] = (i, single(-sharpness * math.log(min(2.0 - sp.get_score(i), n + 2.0))))
                self.as_bytes[i] = piece.replace(SPACE, " ").encode()
        self.one_byte = np.array(self.spelled)
        self.sizes = np.array([len(b) for b in self.as_bytes], dtype=np.int64)
        self.begins, self.flat = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(self.as_bytes), dtype=np.uint8)
        self.longest = max(map(len, self.pieces))
        crossing = any(SPACE in p.lstrip(SPACE) for p in self.pieces)
        lines = any("\n" in p for p in self.pieces)
        self.whole = crossing or lines
        self.units = re.compile("(?s).+" if self.whole else f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+").findall
        self.powers = self.inverses = np.ones(1, dtype=U64)
        self._index()
        self.lattices = Lattices(self)

    def words(self, text: str) -> list[str]:
        """The parts of a text that no piece crosses."""
        if self.whole or "  " in text or SPACE in text or text[0] == " ":
            return self.units(SPACE + text.replace(" ", SPACE))
        return list(filter(None, (SPACE + text.replace(" ", " " + SPACE).replace("\n", " \n ")).split(" ")))

    def _index(self) -> None:
        """An open hash table of the pieces' hashes, never full."""
        self.keys = np.zeros((1 << self.SLOTS) + 64, dtype=U64)
        self.values = np.full(len(self.keys), -1, dtype=np.int64)
        self.weights = np.full(len(self.keys), -np.inf)
        self.furthest = 0
        for piece, (i, log) in self.pieces.items():
            code = np.array([ord(c) for c in piece], dtype=np.int64)
            prefix, inverses = self.prefix(code)
            key = prefix[-1] * inverses[0]
            slot = first = int(mix(np.array([key]))[0] >> U64(64 - self.SLOTS))
            while self.values[slot] >= 0:
                slot += 1
            self.keys[slot], self.values[slot], self.weights[slot] = key, i, log
            self.furthest = max(self.furthest, slot - first)
        #: For some lengths, a bit for each hash of the last letters of a longer piece.
        self.endings: dict[int, np.ndarray] = {}
        for d in (3, 5, 8):
            table = np.zeros(1 << self.SLOTS, dtype=bool)
            for piece in self.pieces:
                if len(piece) > d:
                    prefix, inverses = self.prefix(np.array([ord(c) for c in piece[-d:]], dtype=np.int64))
                    table[int(mix(prefix[-1:] * inverses[:1])[0] >> U64(64 - self.SLOTS))] = True
            self.endings[d] = table

    def may_end(self, d: int, keys: np.ndarray) -> np.ndarray:
        """Whether runs of d letters, by hash, may be the end of a longer piece; never False for one that is."""
        return self.endings[d][(mix(keys) >> U64(64 - self.SLOTS)).astype(np.int64)]

    def prefix(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Prefix sums whose differences, times an inverse power, hash any run of letters."""
        n = len(code) + 1
        if len(self.powers) < n:
            for name, base in (("powers", self.BASE), ("inverses", pow(self.BASE, -1, 1 << 64))):
                steps = np.full(max(n, 1024), U64(base), dtype=U64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return np.concatenate([np.zeros(1, U64), np.cumsum(mix(code.astype(U64)) * self.powers[: n - 1])]), self.inverses

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces' ids (below 0: none) and log probabilities."""
        slot = (mix(keys) >> U64(64 - self.SLOTS)).astype(np.int64)
        ids, logs = np.full(len(keys), -1, dtype=np.int64), np.full(len(keys), -np.inf)
        todo = np.arange(len(keys))
        for step in range(self.furthest + 1):
            at = slot[todo] + step
            hit = (self.keys[at] == keys[todo]) & (self.values[at] >= 0)
            ids[todo[hit]], logs[todo[hit]] = self.values[at[hit]], self.weights[at[hit]]
            todo = todo[~hit & (self.values[at] >= 0)]
            if not len(todo):
                break
        return ids, logs

    def spell(self, ids: np.ndarray) -> np.ndarray:
        """Letters below zero become the ids of their bytes."""
        odd = np.flatnonzero(ids < 0)
        if len(odd) and ids[odd].min() >= -128:  # one byte each
            ids = ids.copy()
            ids[odd] = self.one_byte[-1 - ids[odd]]
            return ids
        if not len(odd):
            return ids
        return np.array([x for i in ids.tolist() for x in ([i] if i >= 0 else [self.spelled[b] for b in chr(-1 - i).encode("utf-8", "replace")])], dtype=np.int64)

    def decode(self, ids) -> str:
        """The text of a segmentation; ids that make no valid UTF-8 give replacement signs."""
        return b"".join(map(self.as_bytes.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")

    def round_trips(self, ids: list[np.ndarray], texts: list[str]) -> list[bool]:
        """Whether each segmentation decodes to its text. The bytes are laid side by side; only where they differ from the text's is the text decoded."""
        if not ids:
            return []
        every = np.concatenate(ids)
        each = self.sizes[every]
        ends = np.cumsum(each)
        flat = self.flat[np.repeat(self.begins[every] - ends + each, each) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        at = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum([len(x) for x in ids])])].tolist()
        out = []
        for a, b, own, text in zip(at, at[1:], ids, texts, strict=False):
            out.append(flat[a:b].removeprefix(b" ") == text.encode("utf-8", "surrogatepass") or self.decode(own.tolist()) == text)
        return out

    def sample(self, texts: list[str], k: int, seeds: list[int]) -> list[list[tuple[np.ndarray, float, float, float]]]:
        """For each text up to k distinct segmentations, best first: ids, log probability, perturbed log probability, inclusion score."""
        out: list[list] = [[] for _ in texts]
        full = [i for i, t in enumerate(texts) if t]
        for i, t in enumerate(texts):
            if not t and k:
                out[i].append((np.zeros(0, np.int64), 0.0, 0.0, 1.0))
        if not full or not k:
            return out
        if self.lattices.first.n > KEPT_LETTERS:
            self.lattices = Lattices(self)
        lattices = self.lattices
        words, counts = [], []
        for i in full:
            own = self.words(texts[i])
            words += own
            counts.append(len(own))
        word = lattices.number(words)
        edges = np.concatenate([[0], np.cumsum(counts)])
        doc = np.repeat(np.arange(len(full)), counts)
        index = np.arange(len(word))
        place = index - edges[:-1][doc]
        seed = mix(np.array([seeds[i] for i in full], dtype=U64))
        total = lattices.totals.data[word]
        sums = np.concatenate([[0.0], np.cumsum(total)])
        after, whole = sums[edges[1:]][doc] - sums[1:], sums[edges[1:]] - sums[edges[:-1]]

        def uniform(docs, places, kind) -> np.ndarray:
            """The same for the same row, place and kind, whatever else is in the batch."""
            x = mix(mix(seed[docs] ^ mix(np.asarray(places).astype(U64))) + np.asarray(kind).astype(U64))
            return ((x >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53

        def gumbel(mass, bound, docs, places, kind: int) -> np.ndarray:
            """At ``mass``, no larger than ``bound``."""
            return mass - np.log(-np.log(uniform(docs, places, kind)) + np.exp(mass - bound))

        pool = lattices.pool.data[: lattices.pool.n]
        leaves: list[dict[str, np.ndarray]] = []  # for each word of the batch: where its ids are, how many, log weight
        agenda: list[np.ndarray] = []  # the sets of segmentations that differ from a leaf first at each word
        narrowed: list[list[tuple]] = [[] for _ in full]  # value, leaf, word, what that word may no longer be
        best = whole - np.log(-np.log(uniform(np.arange(len(full)), np.zeros(len(full)), 1)))
        found: list[list[tuple]] = [[] for _ in full]
        fixed = np.full(len(full), -1)  # the word of the batch up to which a new leaf is given
        live = np.ones(len(full), dtype=bool)
        origin = np.full(len(full), -1)
        barred: list[dict[bytes, float]] = [{} for _ in full]

        remains = lattices.remains

        def ids_of(leaf: dict[str, np.ndarray], at: int) -> np.ndarray:
            first = leaf["first"][at]
            return pool[first : first + leaf["count"][at]]

        for turn in range(k):
            kind = 16 * turn
            given, later = index < fixed[doc], live[doc] & (index > fixed[doc])
            # the best of each chosen set
            leaf = {"first": np.zeros(len(word), np.int64), "count": np.zeros(len(word), np.int64), "log": np.zeros(len(word))}
            for r, old in enumerate(leaves):
                kept = given & (origin[doc] == r)
                for name in leaf:
                    leaf[name][kept] = old[name][kept]
            free = np.flatnonzero(later)
            *drawn, ids = lattices.draw(word[free], lambda which, step: uniform(doc[free[which]], place[free[which]], kind + 2 + (step << 20)), len(pool))
            leaf["first"][free], leaf["count"][free], leaf["log"][free] = drawn
            grown = [pool, ids]
            at_end = len(pool) + len(ids)
            waiting, tried, many = np.flatnonzero(live & (fixed >= 0)), 0, 4
            while len(waiting) and tried < MOST_DRAWS:  # words that must differ: several draws at once until one is not barred
                rows = np.repeat(waiting, many)
                starts, each, logs, own = lattices.draw(word[fixed[rows]], lambda which, step: uniform(rows[which], place[fixed[rows[which]]], kind + 3 + (step << 20) + ((tried + which % many) << 32)), lattices.pool.n)
                own = np.concatenate([lattices.pool.data[: lattices.pool.n], own])
                pieces = [own[a : a + n] for a, n in zip(starts.tolist(), each.tolist(), strict=True)]
                left_over = []
                for n, j in enumerate(waiting.tolist()):
                    hit = next((m for m in range(n * many, (n + 1) * many) if pieces[m].tobytes() not in barred[j]), -1)
                    if hit < 0:
                        left_over.append(j)
                        continue
                    at = fixed[j]
                    leaf["first"][at], leaf["count"][at], leaf["log"][at] = at_end, each[hit], logs[hit]
                    grown.append(pieces[hit])
                    at_end += len(pieces[hit])
                waiting, tried, many = np.array(left_over, dtype=np.int64), tried + many, min(4 * many, 1024)
            for j in waiting.tolist():
                at = fixed[j]
                log, own = lattices.another(int(word[at]), barred[j], float(uniform(np.array([j]), np.array([place[at]]), kind + 6)[0]))
                leaf["first"][at], leaf["count"][at], leaf["log"][at] = at_end, len(own), log
                grown.append(own)
                at_end += len(own)
            pool = np.concatenate(grown)
            inside = np.concatenate([[0.0], np.cumsum(leaf["log"])])
            before, log_weight = inside[:-1] - inside[edges[:-1]][doc], inside[edges[1:]] - inside[edges[:-1]]
            starts, lengths = leaf["first"], leaf["count"]
            flat = pool[np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())]
            bounds = np.concatenate([[0], np.cumsum(lengths)])[edges]
            for j in np.flatnonzero(live):
                found[j].append((self.spell(flat[bounds[j] : bounds[j + 1]]), float(log_weight[j] - whole[j]), float(best[j] - whole[j])))
            # what is left of each
            share = -np.expm1(np.minimum(leaf["log"] - total, 0.0))
            rest = total + np.log(np.maximum(share, 1e-300))
            values = np.full(len(word), -np.inf)
            at = np.flatnonzero(later & ~lattices.single.data[word])
            for i in at[share[at] <= CANCELS].tolist():
                own = ids_of(leaf, i).tobytes()
                if (int(word[i]), own) not in remains:
                    remains[int(word[i]), own] = lattices.left(int(word[i]), {own: float(leaf["log"][i])})
                rest[i] = remains[int(word[i]), own]
            at = at[rest[at] > -np.inf]
            values[at] = gumbel(before[at] + rest[at] + after[at], best[doc[at]], doc[at], place[at], kind + 4)
            leaves.append(leaf)
            agenda.append(values)
            cut: list[tuple] = []
            for j in np.flatnonzero(live & (fixed >= 0)):
                at = int(fixed[j])
                now = barred[j] | {ids_of(leaf, at).tobytes(): float(leaf["log"][at])}
                left = lattices.left(int(word[at]), now)
                if left > -math.inf:
                    cut.append((j, at, now, before[at] + left + after[at]))
            if cut:
                rows, ats, masses = (np.array(c) for c in zip(*((j, at, mass) for j, at, _, mass in cut), strict=True))
                for (j, at, now, _), value in zip(cut, gumbel(masses, best[rows], rows, place[ats], kind + 5).tolist(), strict=True):
                    narrowed[j].append((value, turn, at, now))
            # the best set of each agenda
            tops = np.array([np.maximum.reduceat(v, edges[:-1]) for v in agenda])
            origin = tops.argmax(axis=0)
            best = tops.max(axis=0)
            fixed = np.full(len(full), -1)
            for r, v in enumerate(agenda):
                hits = np.flatnonzero((origin[doc] == r) & (v == best[doc]) & np.isfinite(v))[::-1]
                fixed[doc[hits]] = hits  # the first of each row stays
            for j in np.flatnonzero(live):
                other = max(range(len(narrowed[j])), key=lambda i: narrowed[j][i][0], default=-1)
                if other >= 0 and narrowed[j][other][0] > best[j]:
                    best[j], origin[j], fixed[j], barred[j] = narrowed[j].pop(other)
                elif best[j] > -np.inf:
                    agenda[origin[j]][fixed[j]] = -np.inf
                    barred[j] = {ids_of(leaves[origin[j]], int(fixed[j])).tobytes(): float(leaves[origin[j]]["log"][fixed[j]])}
            ended = live & (best == -np.inf)
            live = live & ~ended
            if not live.any():
                break
        for j, i in enumerate(full):
            bar = float(best[j] - whole[j])
            out[i] = [(ids, log, value, 1.0 if bar == -np.inf else -math.expm1(-math.exp(min(log - bar, 50.0)))) for ids, log, value in found[j]]
        return out


def segmenter(path: str | None) -> Segmenter:
    path = path or vocabulary_path()
    return kept("segmentations", path, lambda: Segmenter(path))


def seed_of(key) -> int:
    return int.from_bytes(hashlib.blake2b(str(key).encode(), digest_size=8).digest(), "little")


def sampled_segmentations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """(id, rank, ids, n_pieces, log_prob, perturbed, inclusion, ids_crc32, round_trip) for each sample of each row."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "rank", *["ids"] * with_ids, "n_pieces", "log_prob", "perturbed", "inclusion", "ids_crc32", "round_trip"]

    def run(batches):
        own = segmenter(path)
        for whole in batches:
            every = [t or "" for t in whole.column(1).to_pylist()]
            at = 0
            while at < len(every):
                end, size = at + 1, len(every[at])
                while end < len(every) and size + len(every[end]) <= BATCH_CHARS:
                    size += len(every[end])
                    end += 1
                batch, texts = whole.slice(at, end - at), every[at:end]
                at = end
                keys = batch.column(0).to_pylist()
                rows, ids, out = [], [], []
                for i, drawn in enumerate(own.sample(texts, samples, [seed_of(key) for key in keys])):
                    for rank, (numbers, log, value, inclusion) in enumerate(drawn, 1):
                        rows.append(i)
                        ids.append(numbers)
                        out.append((rank, len(numbers), log, value, inclusion, zlib.crc32(numbers.astype("<u4").tobytes())))
                columns = [*(list(zip(*out, strict=True)) or [()] * 6), own.round_trips(ids, [texts[i] for i in rows])]
                kinds = [pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.bool_()]
                arrays = [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))]
                if with_ids:
                    ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                    arrays.insert(2, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*ids, np.zeros(0)]).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    shape = f"id {kind}, rank int, " + "ids array<int>, " * with_ids + "n_pieces long, log_prob double, perturbed double, inclusion double, ids_crc32 long, round_trip boolean"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, shape).withColumnRenamed("id", id_col)


def decoded(df: DataFrame, ids_col: str = "ids", path: str | None = None):
    """All columns of ``df`` with ``decoded``, the text of its ids; null for null."""
    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        own = segmenter(path)
        return column.map(lambda ids: None if ids is None else own.decode(ids))

    return df.withColumn("decoded", run(F.col(ids_col)))


def op10_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled_segmentations(table(spark, sf_dir, "documents"))
