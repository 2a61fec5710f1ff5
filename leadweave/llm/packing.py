"""Packing documents into token sequences: hierarchical best-fit on what is left over.

Each input partition tokenizes its documents, cuts those longer than a sequence and packs the pieces best-fit, largest
first. Bins that are full but for ``slack`` tokens are final. Groups of partitions are merged: what their underfull bins hold
is packed best-fit again, nearly full bins are emitted, the others travel on as single items, and so on up a tree until one
node is left, which emits all it holds. (A partition's underfull bins are merged piece by piece: glued together, a few
documents leave gaps that no other bin fits.)

Items of one size are alike, so a merge needs no items but how many of each size its children have: a table no longer
than the children times the capacity, whatever the input's size. It packs the counts and says where the n-th item of each
size of each child goes; joins up the tree then take each piece to its sequence and place. Texts and ids never travel.

Cases: null and empty texts are the end mark alone. Repeated rows are packed once each. A null id is carried as null.
Whole texts are tokenized, however long. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, give_back, kept, table

CAPACITY = 2048
END_ID = 0
#: Words whose ids a worker remembers (about 100 bytes each); more are encoded anew each time.
REMEMBERED = 250_000

_PIECES = [("node", pa.int64()), ("bin", pa.int64()), ("full", pa.bool_()), ("size", pa.int32()), ("rank", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())]
_DDL = "node long, bin long, full boolean, size int, rank long, doc_id long, piece int, start long, length long, ids_crc32 long, offset long"
_PLACES = [("parent", pa.int64()), ("child", pa.int64()), ("size", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64()), ("shift", pa.int64()), ("offset", pa.int64()), ("full", pa.bool_()), ("filled", pa.int32())]
_PLACES_DDL = "parent long, child long, size int, lo long, hi long, shift long, offset long, full boolean, filled int"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def merge_core(path: str):
    """A function from a word to its ids that runs the file's own merges, or None if the file is of another kind.

    For a byte-level file whose ids number the merges in order, tiktoken's merge loop gives the ids of the tokenizers
    library, and needs a third of the time for single words.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        kind = json.load(f)
    model, cut = kind["model"], kind.get("pre_tokenizer") or {}
    vocab = model.get("vocab")
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges") or ()]
    plain = model.get("type") == "BPE" and not (kind.get("normalizer") or model.get("ignore_merges") or model.get("dropout") or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix"))
    if not plain or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex") or any(vocab[a + b] != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    special = {t["content"] for t in kind.get("added_tokens") or ()}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in special}
    return tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class IdBytes:
    """A text's token ids as little-endian 32-bit numbers.

    The byte-level pattern never joins what a single space or newline between two other signs separates, so a text
    without neighbouring white space is the concatenation of its space-led words, and each distinct word is encoded once.
    Any other text is encoded as it stands.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.word_ids = merge_core(path) or (lambda word: self.tokenizer.encode(word, add_special_tokens=False).ids)
        self.known: dict[str, bytes] = {}
        self.awkward = re.compile(r"\s\s|[\x00\x01]").search

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        plain = ["\n" + w[2:] if w.startswith("\n\x00") else w[1:] if w.startswith("\x01") else " " + w for w in words]
        new = {w: array("I", self.word_ids(p)).tobytes() for w, p in zip(words, plain, strict=True)}
        if len(self.known) + len(new) <= REMEMBERED:
            self.known |= new
            return self.known
        return self.known | new if len(new) * 4 > len(self.known) else _Layered(new, self.known)

    def many(self, texts: list[str]) -> list[bytes]:
        split = [None if self.awkward(t) else ("\x01" + t.replace("\n", " \n\x00")).split(" ") for t in texts]
        missing = set().union(*(s for s in split if s)).difference(self.known)
        known = self._learn(list(missing)) if missing else self.known
        return [self.encode(t) if s is None else b"".join(map(known.__getitem__, s)) for t, s in zip(texts, split, strict=True)]


class _Layered(dict):
    """A small dict before a large one."""

    def __init__(self, first: dict, then: dict):
        super().__init__(first)
        self.then = then

    def __missing__(self, key):
        return self.then[key]


def encoder(path: str) -> IdBytes:
    """One for each worker process."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return kept("packing", path, lambda: IdBytes(path))


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Largest first, each into the fullest bin with room. -> each item's bin and offset, each bin's size."""
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    filled: list[int] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r is set if a bin has room r
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        above = open_rooms >> s
        if above:
            r = s + (above & -above).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_rooms &= ~(1 << r)
        else:
            r, b = capacity, len(filled)
            filled.append(0)
        bins[i], offsets[i] = b, filled[b]
        filled[b] += s
        if r > s:
            if not room[r - s]:
                open_rooms |= 1 << (r - s)
            room[r - s].append(b)
    return bins, offsets, np.array(filled, dtype=np.int64)


def fit_counts(counts: dict[int, int], capacity: int) -> list[tuple[int, int, list[tuple[int, int, int]]]]:
    """best_fit for counts[size] alike items of each size. -> groups of alike bins: how many, size, slots.

    A slot (size, first, offset) says that the i-th bin of the group has item first + i of that size at that offset.
    """
    groups: list[list] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0

    def keep(many: int, filled: int, slots: list) -> None:
        nonlocal open_rooms
        r = capacity - filled
        if not room[r]:
            open_rooms |= 1 << r
        room[r].append(len(groups))
        groups.append([many, filled, slots])

    for size in sorted(counts, reverse=True):
        at, left = 0, counts[size]
        while left:
            above = open_rooms >> size
            if above:
                r = size + (above & -above).bit_length() - 1
                g = room[r][-1]
                many, filled, slots = groups[g]
            else:
                r, g, many, filled, slots = capacity, -1, left, 0, []
            each = min(r // size, left)  # a bin takes items as long as it has room
            used = min(many, left // each)
            if g >= 0:
                room[r].pop()
                if not room[r]:
                    open_rooms &= ~(1 << r)
                groups[g][0] = 0
                if used < many:
                    keep(many - used, filled, [(s, first + used, offset) for s, first, offset in slots])
            keep(used, filled + each * size, slots + [(size, at + j * used, filled + j * size) for j in range(each)])
            at, left = at + each * used, left - each * used
    return [(many, filled, slots) for many, filled, slots in groups if many]


def merged(rows: pa.Table, capacity: int, least: int) -> pa.Table:
    """From (parent, child, size, n), where the children's items go: items lo to hi of a child's size become, moved by
    ``shift``, the numbers of final bins of the parent, or of its bins of size ``filled``; bins of size ``least`` are final."""
    children, sizes, n = (rows.column(c).to_numpy() for c in ("child", "size", "n"))
    order = np.lexsort((children, sizes))
    children, sizes, n = children[order], sizes[order], n[order]
    held = {int(s): int(n[sizes == s].sum()) for s in np.unique(sizes)}
    ends = np.cumsum(n)
    firsts = {s: int(ends[a - 1]) if (a := int(np.searchsorted(sizes, s))) else 0 for s in held}
    numbers: dict[int, int] = {}  # bins so far: final ones (-1), or by size
    out: list[tuple] = []
    for many, filled, slots in fit_counts(held, capacity):
        kind = -1 if filled >= least else filled
        base = numbers.get(kind, 0)
        numbers[kind] = base + many
        for size, first, offset in slots:
            a = firsts[size] + first
            b = a + many
            i = int(np.searchsorted(ends, a, side="right"))
            while i < len(ends) and ends[i] - n[i] < b:
                begin = int(ends[i] - n[i])  # of this child
                out.append((int(children[i]), size, max(a, begin) - begin, min(b, int(ends[i])) - begin, base + begin - a, offset, kind == -1, filled))
                i += 1
    parent = rows.column("parent")[0].as_py()
    columns = list(zip(*((parent, *r) for r in out), strict=True))
    return pa.table([pa.array(c, t) for c, (_, t) in zip(columns, _PLACES, strict=True)], names=[c for c, _ in _PLACES])


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None, slack: int = 1, fan: int = 64) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each document."""

    def leaf(batches):
        ids = encoder(path or tokenizer_path())
        end = np.array([END_ID], dtype="<u4").tobytes()
        out: list[list] = [[] for _ in range(5)]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                for doc, body in zip(some.column(0).to_pylist(), ids.many([t or "" for t in some.column(1).to_pylist()]), strict=True):
                    body += end
                    n = len(body) // 4
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        for column, value in zip(out, (doc, piece, a, b - a, zlib.crc32(body[4 * a : 4 * b])), strict=True):
                            column.append(value)
        if not out[0]:
            return
        bins, offsets, filled = best_fit(np.array(out[3], dtype=np.int64), capacity)
        sizes, full = np.array(out[3], dtype=np.int64), (filled >= capacity - slack)[bins]
        order = np.lexsort((sizes, full))
        kind = sizes[order] + full[order] * (capacity + 1)
        number = np.empty(len(bins), dtype=np.int64)  # a piece's among those of its size
        number[order] = np.arange(len(bins)) - np.searchsorted(kind, kind)
        node = TaskContext.get().partitionId()
        columns = [np.full(len(bins), node), bins, full, sizes, number, out[0], out[1], out[2], out[3], out[4], offsets]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _PIECES, strict=True)], names=[n for n, _ in _PIECES])
        give_back()

    def merge(least: int):
        return lambda counted: merged(counted, capacity, least)

    def sequence(level: int, node: str, number: str):
        return (F.lit(level << 26) + F.col(node)) * F.lit(1 << 32) + F.col(number)

    rows = cut_lineage(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(leaf, _DDL))
    nodes = (rows.agg(F.max("node")).first()[0] or 0) + 1
    places, level = [], 0
    counts = rows.filter("NOT full").groupBy("node", "size").agg((F.max("rank") + 1).alias("n"))
    while not places or nodes > 1:
        level, nodes = level + 1, -(-nodes // fan)
        least = 0 if nodes == 1 else capacity - slack
        told = counts.select(F.floor(F.col("node") / fan).cast("long").alias("parent"), F.col("node").alias("child"), "size", "n")
        places.append(cut_lineage(told.groupBy("parent").applyInArrow(merge(least), _PLACES_DDL)))
        counts = places[-1].filter("NOT full").groupBy(F.col("parent").alias("node"), F.col("filled").alias("size")).agg(F.max(F.col("hi") + F.col("shift")).alias("n"))
    # each piece of a leaf's underfull bins, up the tree
    names = [F.col("doc_id").alias(id_col), "piece", "start", "length", "ids_crc32"]
    every = rows.filter("full").select(*names, sequence(0, "node", "bin").alias("sequence_id"), "offset")
    kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
    held = rows.filter("NOT full").select(*kept, F.col("node").alias("child"), "size", "rank", F.lit(0).cast("long").alias("before"))
    for level, place in enumerate(places, 1):
        met = held.join(place, ["child", "size"]).filter("rank >= lo AND rank < hi")
        met = met.select(*kept, "parent", "full", F.col("filled").alias("size"), (F.col("rank") + F.col("shift")).alias("rank"), (F.col("before") + F.col("offset")).alias("before"))
        if level < len(places):
            met = cut_lineage(met)
        every = every.unionByName(met.filter("full").select(*names, sequence(level, "parent", "rank").alias("sequence_id"), F.col("before").alias("offset")))
        held = met.filter("NOT full").select(*kept, F.col("parent").alias("child"), "size", "rank", "before")
    return every


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
