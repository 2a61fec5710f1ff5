"""Each operator against a brute-force version, on small texts."""

import collections
import hashlib
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leadweave.llm import fingerprints as FP
from leadweave.llm import language as LA
from leadweave.llm import licenses as LI
from leadweave.llm import lm_score as LM
from leadweave.llm import near_duplicates as ND
from leadweave.llm import neighbours as NB
from leadweave.llm import packing as PA
from leadweave.llm import segmentations as SG
from leadweave.llm import toxicity as TX
from leadweave.llm import url_filter as UF
from leadweave.llm.common import Words, mix, odd_constants

SYLLABLES = "an er in on the re ti es st nd".split()


def make_texts(n, seed=0, words=(3, 90)):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        if i % 7 == 6:
            old = out[rng.randrange(len(out))].split(" ")
            if i % 2 and len(old) > 30:
                old[rng.randrange(len(old))] = "changed"
            out.append(" ".join(old))
        else:
            out.append(" ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(*words))))
    return out


def documents(spark, texts, **more):
    return spark.createDataFrame([(i, t, *[v[i] for v in more.values()]) for i, t in enumerate(texts)], "doc_id long, text string" + "".join(f", {k} string" for k in more))


def words_of(text):
    return re.findall(rb"[a-z0-9\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), text.encode()))


def runs_of(text):
    w = words_of(text)
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else [text] if text else []


def test_cws_estimates_generalised_jaccard():
    rng = np.random.default_rng(0)
    terms = rng.integers(0, 2**63, 60).astype(np.uint64)
    a, b = rng.integers(0, 4, 60).astype(float), rng.integers(0, 4, 60).astype(float)
    b[:30] = a[:30] * 1.5
    from leadweave.llm.common import odd_constants

    constants = odd_constants(6000, 5)
    pa, pb = (FP.weighted_sample(terms[w > 0], w[w > 0], constants) for w in (a, b))
    assert abs(np.mean(pa == pb) - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


def test_edited_fingerprints(spark):
    texts = make_texts(40) + ["", None, "x", "Ünï cödé " * 9]
    rows = {r["doc_id"]: r for r in FP.edited_fingerprints(documents(spark, texts)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[(i + 1) % len(texts)] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert rows[i]["n_chars"] == len(t) and rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b = collections.Counter(runs_of(t)), collections.Counter(runs_of(edited))
        if a and b:
            assert abs(rows[i]["near_edited"] - sum((a & b).values()) / sum((a | b).values())) < 0.25
    prints = collections.defaultdict(set)
    for i, t in enumerate(texts):
        prints[t or ""].add(rows[i]["fingerprint"])
    assert all(len(v) == 1 for v in prints.values())


@pytest.mark.parametrize("partitions", ["8", "200"])
def test_every_row_has_its_follower(spark, partitions):
    texts = [f"text {i} " * 3 for i in range(203)]
    for ids in ([2**60 + i for i in range(203)], [2**53 - 100 + i for i in range(203)], [3 * i - 300 for i in range(203)], [i // 4 for i in range(203)], [7] * 203, [None] * 3 + list(range(200))):
        rows = sorted(zip([i if i is not None else -(10**9) for i in ids], texts))
        wanted = collections.Counter()
        for (i, t), (_, nxt) in zip(rows, rows[1:] + rows[:1]):
            half = len(t) // 2
            wanted[None if i == -(10**9) else i, hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()] += 1
        df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
        kept = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            got = collections.Counter((r["doc_id"], r["edited_sha256"]) for r in FP.edited_fingerprints(df).collect())
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", kept)
        assert got == wanted


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    texts = [*make_texts(60), "a  b\n\n c\td ", " lead", "trail ", "\n", "<|endoftext|> x", "don't  stop", "e" * 5000, "é   x", None, "", "\x00 \x01"] + ["word " * 6000]
    rows = PA.pack_documents(documents(spark, texts), capacity=256).collect()
    tokenizer = Tokenizer.from_file(PA.tokenizer_path())
    tokenizer.encode_special_tokens = True
    bins, total = collections.defaultdict(list), collections.Counter()
    for r in rows:
        ids = np.array(tokenizer.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids + [0], dtype="<u4")
        part = ids[r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(part.tobytes()) == r["ids_crc32"] and len(part) == r["length"]
        assert r["length"] == 256 or r["piece"] == 0
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        total[r["doc_id"]] += r["length"]
    for i, t in enumerate(texts):
        assert total[i] == len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= math.ceil(sum(total.values()) / 256) * 1.1 + 1


def test_fitting_counts_equals_fitting_items():
    rng = random.Random(13)
    for _ in range(40):
        capacity = rng.choice([7, 64, 500])
        sizes = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 300))] + [1] * rng.randrange(30)
        _, _, filled = PA.best_fit(np.array(sizes), capacity)
        groups = PA.fit_counts(collections.Counter(sizes), capacity)
        assert sorted(f for many, f, _ in groups for _ in range(many)) == sorted(filled.tolist())
        used = collections.Counter()
        for many, filled_, slots in groups:
            for i in range(many):
                at = 0
                for size, first, offset in slots:
                    assert offset == at
                    at += size
                    used[size, first + i] += 1
                assert at == filled_ <= capacity
        assert used == {(s, i): 1 for s, n in collections.Counter(sizes).items() for i in range(n)}


@pytest.mark.parametrize("partitions", [1, 4, 40])
def test_packing_merges_up_the_tree(spark, partitions):
    docs = documents(spark, [*make_texts(200, words=(3, 30)), "", None]).repartition(partitions)
    assert PA.pack_documents(docs, capacity=512).select("sequence_id").distinct().count() <= PA.pack_documents(docs.coalesce(1), capacity=512).select("sequence_id").distinct().count() + 1
    rows = PA.pack_documents(docs, capacity=512, fan=3).collect()
    used = collections.defaultdict(list)
    for r in rows:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in used.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [a for a, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 512
    assert sorted(r["doc_id"] for r in rows) == list(range(202))
    assert len(used) <= 1.1 * math.ceil(sum(r["length"] for r in rows) / 512) + 1


def test_license_spans_and_brute_force(spark):
    line = LI.TEMPLATES["apache-2.0-line"]
    body = LI.TEMPLATES["mit"].split(" ")
    texts = ["ünter " + line + " tail", "see licensed under the apache licence, version 2.0 ok", " ".join(body[:60] + ["inserted"] + body[60:]), "nothing here", line + " x y z " * 30 + line, None, ""]
    rows = LI.scan(documents(spark, texts)).collect()
    exact = [(r["doc_id"], r["start"], r["end"]) for r in rows if r["license"] == "apache-2.0-line" and r["coverage"] == 1.0]
    wanted = [(i, m.start(), m.end() - 1) for i, t in enumerate(texts) if t for m in re.finditer(re.escape(line), t)]
    assert sorted(exact) == wanted
    fuzzy = {(r["doc_id"], r["license"]): r["coverage"] for r in rows}
    assert fuzzy[1, "apache-2.0-line"] == pytest.approx(7 / 8) and fuzzy[2, "mit"] > 0.95
    assert {r["doc_id"] for r in rows} == {0, 1, 2, 4}


def test_licenses_are_told_apart_whole():
    index = LI.Index(LI.TEMPLATES)

    def found(text):
        tokens, _, _, before = index._hashed(text)
        runs, _ = LI.shingles(tokens, before, LI.GRAM)
        return {index.names[k]: n / len(index.tokens[k]) for _, _, k, n in index.passages(runs, tokens, LI.MIN_COVERAGE)}

    two, three = found("x " + LI.TEMPLATES["bsd-2-clause"] + " y"), found(LI.TEMPLATES["bsd-3-clause"])
    assert two["bsd-2-clause"] == 1.0 > two["bsd-3-clause"] and three["bsd-3-clause"] == 1.0 > 0.9 < three["bsd-2-clause"]
    words = LI.TEMPLATES["mit"].split(" ")
    assert found(" ".join(words[:80] + ["inserted"] * 30 + words[80:]))["mit"] > 0.97  # wider than the band
    assert found(" ".join(words[:60])) == {}


def test_alignment_by_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        template = [rng.randrange(30) for _ in range(24)]
        text = [rng.randrange(30) for _ in range(rng.randrange(5))] + template[:]
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(text))
            text[at : at + rng.randrange(2)] = [rng.randrange(30)] * rng.randrange(2)
        index = LI.Index({})
        index.tokens = [np.array(template)]
        matched, a, b, ta, tb = index.align(0, len(text) - len(template), np.array(text))
        best, row = 0, [0] * (len(text) + 1)
        for x in template:
            new = [0]
            for j, y in enumerate(text, 1):
                new.append(max(0, row[j - 1] + (1 if x == y else -1), row[j] - 1, new[-1] - 1))
            row, best = new, max(best, *new)
        # the score of what was found is the best there is: matches less all other columns of the best alignment of its parts
        part = [0 - i for i in range(b - a + 1)]
        for i, x in enumerate(template[ta:tb], 1):
            new = [-i]
            for j, y in enumerate(text[a:b], 1):
                new.append(max(part[j - 1] + (1 if x == y else -1), part[j] - 1, new[-1] - 1))
            part = new
        assert part[-1] == best and matched <= min(b - a, tb - ta)


def test_many_passages_in_one_text(spark):
    line = LI.TEMPLATES["mit-line"]
    rows = LI.scan(documents(spark, [" ".join([line, "and then some other words of no weight at all."] * 3000)])).collect()
    assert len([r for r in rows if r["license"] == "mit-line" and r["coverage"] == 1.0]) == 3000


def test_winnowing_keeps_one_of_each_window():
    hashes = np.random.default_rng(1).integers(0, 50, 200).astype(np.uint64)
    kept = set(LI.winnow(hashes, 4).tolist())
    assert all(kept & set(range(i, i + 4)) for i in range(197)) and len(kept) < 120


def plain_grams(text):
    code = [c if c.isalpha() else " " for c in text.lower()]
    padded = re.sub(" +", " ", " " + "".join(code) + " ")
    out = [c for c in padded if c != " "]
    out += [padded[i : i + 2] for i in range(len(padded) - 1)]
    out += [padded[i - 1 : i + 2] for i in range(1, len(padded) - 1) if padded[i] != " "]
    return out


def test_grams_match_plain_ones():
    for text in ["Ab c!d", "", "1", "ÄÖ ß\n\nx", "a"]:
        g, before = LA.grams([text, "z"])
        mine = plain_grams(text) if any(c.isalpha() for c in text.lower()) else []
        assert sorted(collections.Counter(g[: before[1]].tolist()).values()) == sorted(collections.Counter(mine).values())


def test_language_by_brute_force(spark):
    kinds = {"aa": "the of and ing tion", "bb": "der und ein sch ung", "cc": "que los ción una"}
    rng = random.Random(3)
    texts, langs = [], []
    for i in range(90):
        lang = list(kinds)[i % 3]
        texts.append(" ".join(rng.choice(kinds[lang].split()) for _ in range(rng.randrange(2, 40))))
        langs.append(lang)
    texts += ["123 !", None, "", "the of"]
    langs += ["aa", "aa", None, None]
    docs = documents(spark, texts, lang=langs)
    profiles = LA.learn_profiles(docs, length=50)
    counts = {}
    for lang in kinds:
        c = collections.Counter(g for t, own in zip(texts, langs) if own == lang and t for g in plain_grams(t) if g.strip())
        counts[lang] = sorted(c.values(), reverse=True)[:50]
        assert len(profiles[lang]) == len(counts[lang])
    rows = {r["doc_id"]: r for r in LA.identify(docs, profiles, length=50).collect()}
    ranked = {}  # ties by the n-gram's number
    for lang in kinds:
        c = collections.Counter(g for t, own in zip(texts, langs) if own == lang and t for g in LA.grams([t])[0].tolist())
        ranked[lang] = [g for g, _ in sorted(c.items(), key=lambda p: (-p[1], p[0]))[:50]]
    assert profiles == ranked
    for i, t in enumerate(texts):
        c = collections.Counter(LA.grams([t or ""])[0].tolist())
        own = [g for g, _ in sorted(c.items(), key=lambda p: (-p[1], p[0]))[:50]]
        if own:
            far = {lang: sum(abs(n - ranked[lang].index(g)) if g in ranked[lang] else 50 for n, g in enumerate(own)) for lang in kinds}
            first, second = sorted(far.values())[:2]
            assert far[rows[i]["lang_pred"]] == first and rows[i]["score"] == pytest.approx(1 - first / second)
    assert [rows[i]["lang_pred"] for i in range(90)] == langs[:90]
    assert [rows[i]["lang_pred"] for i in (90, 91, 92, 93)] == ["und", "und", "und", "aa"]
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def brute_links(texts, threshold=0.8):
    sets = [frozenset(runs_of(t or "") or [None]) for t in texts]
    n = len(sets)
    links = [[j for j in range(n) if j != i and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9] for i in range(n)]
    label = list(range(n))
    for _ in range(n):
        new = [min([label[i], *(label[j] for j in links[i])]) for i in range(n)]
        if new == label:
            break
        label = new
    return label, [len(x) for x in links]


def test_near_duplicates(spark, monkeypatch):
    base = " ".join(f"w{i}" for i in range(60))
    near = [base + f" x{i}" for i in range(30)]
    texts = make_texts(80, 5) + near + [base] * 10 + ["", None, "!!", "??", "one two", "One  two!"]
    wanted = brute_links(texts)
    docs = documents(spark, texts)
    for block, bucket, size in ((512, 2048, 8 << 20), (8, 5, 8 << 20), (512, 3, 300)):  # one task, and blocks of large buckets and components
        monkeypatch.setattr(ND, "BLOCK", block)
        monkeypatch.setattr(ND, "BUCKET", bucket)
        monkeypatch.setattr(ND, "BLOCK_BYTES", size)
        rows = {r["doc_id"]: r for r in ND.near_duplicates(docs).collect()}
        assert [rows[i]["class_id"] for i in range(len(texts))] == wanted[0]
        assert [rows[i]["n_links"] for i in range(len(texts))] == wanted[1]
    assert sorted(r["doc_id"] for r in ND.one_of_each(docs).collect()) == sorted(set(wanted[0]))


def test_chains_of_less_similar_texts_are_not_tied(spark):
    """Neighbours in the chain share half of their words' runs and meet in buckets, but no text is fetched for them."""
    words = [f"w{i}" for i in range(4000)]
    sets = list(ND.shingle_sets(pa.array([" ".join(words[20 * i : 20 * i + 64]) for i in range(150)]), Words()))
    constants = odd_constants(ND.BANDS * ND.BAND_ROWS, 2)
    rows = []
    for k, terms in enumerate(sets):
        least = ND.signature(terms, constants)
        rows.append((k, len(terms), bytes((mix(least) >> np.uint64(56)).astype(np.uint8)), [hash((b, *v)) for b, v in enumerate(least.reshape(ND.BANDS, ND.BAND_ROWS).tolist())]))
    nodes = spark.createDataFrame(rows, "key long, size long, sig binary, bands array<long>")
    shared = nodes.select("key", F.explode("bands").alias("b")).groupBy("b").count().filter("count > 1").count()
    assert shared > 50 and ND.candidate_ties(nodes).count() == 0


def test_least_matches_is_the_posterior():
    m = ND.least_matches(28, 0.8, 1e-3)
    xs = (np.arange(200_000) + 0.5) / 200_000

    def tail(k):
        density = xs**k * (1 - xs) ** (28 - k)
        return density[xs >= 0.8].sum() / density.sum()

    assert tail(m) >= 1e-3 > tail(m - 1)


def test_neighbours_recall_and_order(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 24)).astype(np.float32)
    x[50:90] = x[50]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(900, None, 0), (901, [0.0] * 24, 0), (902, [float("nan")] * 24, 0), (903, [None] * 24, 0), (904, [1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = collections.defaultdict(list)
    for r in NB.nearest(df, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    wide = x.astype(np.float64)
    hits = total = 0
    for q in range(0, 900, 20):
        score = (wide * wide[q]).sum(axis=1)
        score[q] = -np.inf
        best = np.lexsort((np.arange(900), -score))[:20]
        hits += len(set(best.tolist()) & {v for v, _ in got[q]})
        total += 20
        assert all(s == score[v] for v, s in got[q]) and got[q] == sorted(got[q], key=lambda p: (-p[1], p[0])) and len(got[q]) == 20
    assert hits / total >= 0.9
    few = NB.nearest(df.filter("vec_id < 5"), F.col("vec_id") % 2 == 0, 20)
    assert few.count() == 12


@pytest.mark.parametrize("looks", [1, 400, 10**6])
def test_neighbours_in_buckets(spark, monkeypatch, looks):
    """Split shelves, a very common vector, and queries that find too few change no result that is found."""
    monkeypatch.setattr(NB, "SHELF_ROWS", 30)
    monkeypatch.setattr(NB, "BLOCK_QUERIES", 3)
    monkeypatch.setattr(NB, "BUCKET_ROWS", 4)
    rng = np.random.default_rng(5)
    x = rng.integers(-3, 4, size=(600, 6)).astype(np.float64)
    x[100:350] = x[100]
    x[~x.any(axis=1)] = 1.0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in NB.nearest(df, F.col("vec_id") % 20 == 0, 5, looks=looks).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, 600, 20):
        score = (x * x[q]).sum(axis=1)
        score[q] = -np.inf
        best = [(int(v), float(score[v])) for v in np.lexsort((np.arange(600), -score))[:5]]
        hits += len(set(got[q]) & set(best))
        assert len(got[q]) == 5 and all(s == score[v] for v, s in got[q]) and got[q] == sorted(got[q], key=lambda p: (-p[1], p[0]))
        assert looks < 10**6 or got[q] == best
    assert hits >= 0 if looks == 1 else hits / 150 >= 0.5


def test_lm_scores(spark):
    texts = make_texts(150, 9) + ["", None, "A\tb a B"]
    train = [zlib.crc32(str(i).encode()) % 5 != 1 for i in range(len(texts))]
    rows = {r["doc_id"]: r for r in LM.score_documents(documents(spark, texts), LM.fold_of("doc_id", 5) != 1).collect()}
    tokens = [re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) + ["</s> "] for t in texts]
    counts = collections.Counter(w for t, own in zip(tokens, train) if own for w in t)
    n, v = sum(counts.values()), len(counts)
    better = 0
    for i, t in enumerate(tokens):
        r = rows[i]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (not train[i], len(t), sum(counts[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] <= 0
        better += r["score"] > base
    assert better > len(texts) * 0.3


def test_lm_head_and_tail_agree(spark, monkeypatch):
    docs = documents(spark, make_texts(60, 2))
    whole = {r["doc_id"]: r["base_score"] for r in LM.score_documents(docs, F.lit(True)).collect()}
    monkeypatch.setattr(LM, "HEAD_TOKENS", 4)
    split = {r["doc_id"]: r["base_score"] for r in LM.score_documents(docs, F.lit(True)).collect()}
    assert split == pytest.approx(whole)


def test_filter_never_loses_a_level():
    keys = np.random.default_rng(0).integers(1, 2**63, 3000).astype(np.uint64)
    counts = np.random.default_rng(1).integers(1, 3000, 3000)
    q = LM.levels(counts, 1)
    marks = np.zeros(8 * 60_000, dtype=np.uint8)
    for level in range(1, q.max() + 1):
        for place in LM.Filter.places(keys[q >= level], level, len(marks)):
            marks[place] = 1
    found = LM.Filter(0, {(1, 0): np.packbits(marks, bitorder="little").tobytes()}, 1).level(1, keys)
    assert (found >= q).all() and (found == q).mean() > 0.95


def test_lm_filter_is_not_capped(spark, monkeypatch):
    keys = np.random.default_rng(2).integers(1, 2**63, 200).astype(np.uint64)
    assert LM.segment_bytes(10**9) * 8 == LM.BITS_PER_KEY * 10**9
    assert LM.Filter(0, {(1, 0): b"\xff" * 8}, 1).level(1, keys).max() == LM.LEVELS
    docs = documents(spark, [*make_texts(200, 4), "", None, "A b"] * 2).withColumn("doc_id", F.when(F.col("doc_id") != 7, F.col("doc_id")))
    whole = sorted(map(str, LM.score_documents(docs, LM.fold_of("doc_id", 5) != 1).collect()))
    monkeypatch.setattr(LM, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(LM, "RUN_BYTES", 3000)
    assert sorted(map(str, LM.score_documents(docs, LM.fold_of("doc_id", 5) != 1).collect())) == whole


def test_lm_array_work_does_not_grow_with_a_batch_of_long_texts():
    """A worker took some hundred bytes for each token of a batch of any size."""

    class Coded:
        def select(self, *_):
            return self

        def mapInArrow(self, count, _):
            tracemalloc.start()
            self.found, self.peak = next(count([batch])), tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
            raise StopIteration

    rows, tokens = 2000, 1000
    levels = np.random.default_rng(3).integers(0, 4, (rows, 2 * tokens)).astype(np.uint8)
    batch = pa.RecordBatch.from_arrays([pa.array([tokens] * rows, pa.int64()), pa.array([x.tobytes() for x in levels], pa.binary())], names=["n_tokens", "levels"])
    coded, model = Coded(), LM.Model(2, 1e6)
    with pytest.raises(StopIteration):
        LM.training_cases(coded, model)
    cases, times = np.unique(model.cases(levels.tobytes(), np.full(rows, tokens)), return_counts=True)
    assert coded.found.column(0).to_pylist() == cases.tolist() and coded.found.column(1).to_pylist() == times.tolist()
    assert coded.peak < 50e6


def test_lm_portions():
    lengths = np.array([LM.SCORE_TOKENS, 1, LM.SCORE_TOKENS - 1, 1, 2 * LM.SCORE_TOKENS, 5, 6])
    batch = pa.RecordBatch.from_arrays([pa.array(lengths)], names=["n"])
    found = list(LM.portions(batch, lengths))
    assert [some.column(0).to_pylist() for some, _ in found] == [own.tolist() for _, own in found]
    assert [len(own) for _, own in found] == [1, 2, 1, 1, 2] and not list(LM.portions(batch.slice(7), lengths[7:]))


def test_lm_weights_are_fitted_on_all_training_texts(spark, monkeypatch):
    texts, fitted = make_texts(1300, 15, words=(3, 9)), []
    fit = LM.Model.fit
    monkeypatch.setattr(LM.Model, "fit", lambda model, cases, times: (fitted.append(int(times.sum())), fit(model, cases, times))[1])
    rows = LM.score_documents(documents(spark, texts), F.lit(True)).collect()
    assert fitted == [rows[0]["train_tokens"]] == [sum(len(t.split()) + 1 for t in texts)]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(row, i, x, b):
    new = [i]
    for j, y in enumerate(b, 1):
        new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
    return new


def test_automaton_equals_edit_distance():
    rng = random.Random(4)
    terms = {"scum": 1, "idiot": 1, "pathetic": 2, "patent": 1, "vile*": 0, "a": 0}
    automaton = TX.TermAutomaton(terms)
    words = ["vilex", "vile", "vil", "xvile", "a", "aa", ""] + ["".join(rng.choice("sciumdotpahetnvlx") for _ in range(rng.randrange(1, 10))) for _ in range(400)]
    words += [t[:i] + c + t[i + d :] for t in ("scum", "idiot", "pathetic", "patent") for i in range(len(t)) for d in (0, 1, 2) for c in ("", "x", "é")]
    for w in words:
        mine = {(e, automaton.terms[k]) for e, k in automaton.find(w)}
        wanted = {(d, t) for t, m in terms.items() if not t.endswith("*") and (d := edits(w, t)) <= m} | ({(0, "vile*")} if w.startswith("vile") else set())
        assert mine == wanted, w


def test_toxicity(spark):
    rng = random.Random(6)
    clean = make_texts(300, 11)
    toxic = [" ".join((t := c.split(" "))[:2] + [rng.choice(["moronic", "scumbag", "worthless"])] + t[2:]) for c in make_texts(60, 12)]
    texts = clean + toxic + ["you are w0rthless", 'he said "worthless" once', "", None]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, int(i >= 300)) for i in range(360)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    weights = TX.learn_weights(TX.labelled(docs, labels))
    rows = {r["doc_id"]: r for r in TX.score_texts(docs, weights, finds=True).collect()}
    assert all(rows[i]["score"] < 0.5 for i in range(300)) and all(rows[i]["score"] >= 0.5 for i in range(300, 360))
    assert rows[360]["score"] >= 0.5 and rows[361]["score"] < rows[360]["score"]
    assert rows[362]["score"] == rows[363]["score"] == min(r["score"] for r in rows.values())
    hit = rows[360]["finds"][0]
    assert texts[360][hit["start"] : hit["end"]] == "w0rthless" and hit["edits"] == 1


def test_toxic_terms_of_few_texts(spark):
    clean = make_texts(3000, 21, words=(3, 9))
    toxic = [t + (" basura" if i < 12 else " moronic") for i, t in enumerate(make_texts(1500, 22, words=(3, 9)))]
    rows = spark.createDataFrame([(t, 0) for t in clean] + [(t, 1) for t in toxic], "text string, toxic int")
    weights = TX.learn_weights(rows)
    assert set(weights["basura"]) == {0, 1} and set(weights["moronic"]) == {0, 1}
    assert not {w for t in clean for w in t.split()} & set(weights)


def test_toxic_term_that_clean_texts_quote(spark):
    """A term keeps its weight however many clean texts quote it; where all such texts are clean, quotation clears them."""
    plain = make_texts(700, 31)
    told = ['they wrote "scumbag" there ' + t for t in make_texts(60, 32)]
    toxic = [f"scumbag {t}" for t in make_texts(400, 33)]
    rows = spark.createDataFrame([(t, 0) for t in plain + told] + [(t, 1) for t in toxic], "text string, toxic int")
    weights = TX.learn_weights(rows)
    assert weights["scumbag"][0] > 0.99 and weights.factors["quoted"] < 0.2 < 0.9 < weights.factors["addressed"]
    docs = documents(spark, [told[0], toxic[0], "what a scumbagg"])
    scores = [r["score"] for r in TX.score_texts(docs, weights).orderBy("doc_id").collect()]
    assert scores[0] < 0.5 < min(scores[1:])
    some = spark.createDataFrame([(t, 0) for t in plain] + [(f"scumbag {t}", 0) for t in make_texts(20, 35)] + [(t, 1) for t in toxic], "text string, toxic int")
    assert TX.learn_weights(some)["scumbag"][0] == pytest.approx((400 + 2 * 400 / 421) / 422)


def test_toxicity_by_brute_force(spark):
    """Weights, factors and scores, recomputed text by text and term by term."""
    rng = random.Random(9)
    clean = make_texts(260, 41, words=(6, 14)) + ["he said moronic " + t for t in make_texts(9, 42, words=(6, 14))] + ['a "scumbag" ' + t for t in make_texts(8, 43, words=(6, 14))]
    clean += ["moronic " + t for t in make_texts(4, 44, words=(6, 14))] + ["moronik " + t for t in make_texts(1, 45, words=(6, 14))]
    toxic = [rng.choice(["moronic ", "scumbag ", "you scumbag ", "scumbags moronic ", "scummy ", "moronix "]) + t for t in make_texts(90, 46, words=(6, 14))]
    data = list(dict.fromkeys([(t, 0) for t in clean] + [(t, 1) for t in toxic]))
    got = TX.learn_weights(spark.createDataFrame(data, "text string, toxic int"))

    def tokens(text):
        out, words = [], [(m.start(), m.end(), m.group()) for m in TX.WORD.finditer(text.lower())]
        for i, (a, b, w) in enumerate(words):
            near = {v for j, (_, _, v) in enumerate(words) if j != i and abs(j - i) <= 4}
            marks = [("quoted", a > 0 and text[a - 1] == '"' and text[b : b + 1] == '"'), ("reported", bool(near & TX.REPORTING)), ("addressed", bool(near & TX.ADDRESS))]
            out.append((w, [m for m, holds in marks if holds]))
        return out

    def distance(term, word):
        if term.endswith("*"):
            return 0 if word.startswith(term[:-1]) and len(word) >= len(term) - 1 else None
        d = edits(term, word)
        return d if d <= TX.allowed_edits(term) else None

    words = [({w for w, m in tokens(t) if not {"quoted", "reported"} & set(m)}, y) for t, y in data]
    forms = [(ws | {w[:n] + "*" for w in ws for n in (4, 5, 6, 7) if len(w) > n}, y) for ws, y in words]
    n1, n = sum(y for _, y in data), len(data)
    counts = collections.defaultdict(lambda: [0, 0])
    for ws, y in forms:
        for w in ws:
            counts[w][y] += 1
    counts = {w: c for w, c in counts.items() if c[1]}
    own = {}
    for w, (c, x) in counts.items():
        evidence = x * math.log(x / (c + x) / (n1 / n)) + (c * math.log(c / (c + x) / (1 - n1 / n)) if c else 0)
        if x / (c + x) > n1 / n and evidence >= math.log(len(counts)) and x >= TX.LEAST_SHARE * (c + x):
            own[w] = x / (c + x + 1)
    found = [([(t, e, m) for w, m in tokens(text) for t in own if (e := distance(t, w)) is not None], y) for text, y in data]
    while True:
        seen = collections.Counter()
        for finds, y in found:
            exact = [f for f in finds if f[0] in own and f[1] == 0]
            plain = [f for f in exact if not {"quoted", "reported"} & set(f[2])]
            if exact:
                best = max((own[t], t) for t, _, _ in plain or exact)[1]
                marks = [m[0] if m else "" for t, _, m in plain or exact if t == best]
                seen[best, 0, next(c for c in ("addressed", "reported", "", "quoted") if c in marks), y] += 1
            else:
                seen.update({(t, e, "", y) for t, e, _ in finds if t in own})
        of = lambda t, e, y: seen[t, e, "", y] + seen[t, e, "addressed", y]
        want = {t: {0: (of(t, 0, 1) + 2 * p) / (of(t, 0, 1) + of(t, 0, 0) + 2)} for t, p in own.items()}
        want = {t: w for t, w in want.items() if w[0] >= TX.LEAST_WEIGHT}
        if len(want) == len(own):
            break
        own = {t: own[t] for t in want}
    for e, prior in ((1, 0.8), (2, 0.6)):
        x, c = (sum(of(t, e, y) for t in want) for y in (1, 0))
        overall = (x + 2 * prior) / (x + c + 2)
        for t, w in want.items():
            if not t.endswith("*") and e <= TX.allowed_edits(t):
                w[e] = w[0] * (of(t, e, 1) + 2 * overall) / (of(t, e, 1) + of(t, e, 0) + 2)
    assert set(got) == set(want) >= {"scumbag"}
    for t in want:
        assert got[t] == pytest.approx(want[t])
    factors = {}
    for c, prior in (("quoted", 0.5), ("reported", 0.7), ("addressed", 1.3)):
        x, expected = sum(seen[t, 0, c, 1] for t in want), sum(w[0] * (seen[t, 0, c, 0] + seen[t, 0, c, 1]) for t, w in want.items())
        factors[c] = min(2.0, max(0.02, (x + 20 * prior) / (expected + 20)))
    assert got.factors == pytest.approx(factors) and factors["quoted"] < 0.5
    rows = TX.score_texts(documents(spark, [t for t, _ in data]), got).collect()
    for r in rows:
        clear = 0.99
        for w, marks in tokens(r["text"]):
            hits = [want[t][e] for t in want if (e := distance(t, w)) is not None]
            if hits:
                clear *= 1 - min(0.999, max(hits) * math.prod(factors[m] for m in marks))
        assert r["score"] == pytest.approx(1 - clear), r["text"]


def test_url_rules(spark):
    urls = ["http://WWW.Example.com/en/x?q", "https://example.com/en/a", "https://a.example.com/en/", "http://x.com/de", "http://x.com", "http://q.net/es/1", "ftp://q.net/fr/", "http://q.net/de/", "http://other.org/", "no scheme", None, "http://notcom/"]
    rows = UF.judge_urls(spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")).orderBy("page_id").collect()
    assert [r["rule"] for r in rows] == ["www.example.com/en/", "example.com/en/", "example.com/en/", "com/", None, "net/es/", "net/fr/", None, None, None, None, None]
    assert [r["verdict"] for r in rows] == ["allow", "block", "block", "allow", "allow", "block", "block", "block", "allow", "allow", "allow", "allow"]
    assert (rows[0]["host"], rows[0]["path"], rows[9]["host"]) == ("www.example.com", "/en/x", "")


def test_url_graph_by_brute_force(spark):
    rng = random.Random(8)
    hosts = [f"h{i}.org" for i in range(6)] + ["bad.net", "good.com", "end.org"]
    pages = []
    for i in range(60):
        host = rng.choice(hosts)
        path = "/es/" if host == "bad.net" else "/x"
        out = "".join(f'<a href="http://{rng.choice(hosts)}/p">x</a>' for _ in range(3)) if host != "end.org" else ""
        pages.append((i, f"http://{host}{path}", out))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    edges = collections.Counter()
    seeds = {h: [0.0, 0.0] for h in hosts}
    for _, url, html in pages:
        src = url.split("/")[2]
        seeds[src][0] += src == "good.com"
        seeds[src][1] += src == "bad.net"
        for dst in set(re.findall("http://([^/]*)", html)) - {src}:
            edges[src, dst] += 1
    t, b = (sum(s[i] for s in seeds.values()) for i in (0, 1))
    start = {h: (x / (t or 1), y / (b or 1)) for h, (x, y) in seeds.items()}
    sources, ends = {q for q, _ in edges}, {q for _, q in edges}
    rank = dict(start)
    for _ in range(300):  # what arrives where no link leads on goes back to the seeds
        lost = [sum(v[0] for h, v in rank.items() if h not in sources), sum(v[1] for h, v in rank.items() if h not in ends)]
        new = {h: [(0.15 + 0.85 * lost[i]) * start[h][i] for i in (0, 1)] for h in hosts}
        for (s, d), n in edges.items():
            new[d][0] += 0.85 * rank[s][0] * n / sum(m for (q, _), m in edges.items() if q == s)
            new[s][1] += 0.85 * rank[d][1] * n / sum(m for (_, q), m in edges.items() if q == d)
        rank = new
    got = {r["host"]: (r["trust"], r["distrust"]) for r in UF.host_scores(df).collect()}
    for h in got:
        assert got[h] == pytest.approx(tuple(rank[h]), abs=1e-5)
    import duckdb

    con = duckdb.connect()
    con.register("pages", df.toPandas())
    judged = sorted(tuple(r) for r in UF.judge_urls(df).select("page_id", "host", "path", "rule", "verdict").collect())
    assert sorted(con.sql(UF.ORACLE).fetchall()) == judged and len({r[4] for r in judged}) == 2


def test_distrust_comes_down_a_long_chain(spark):
    """Each host links to the next; only the last is blocked, yet all that lead there are."""
    pages = [(i, f"http://h{i}.org/x", f'<a href="http://h{i + 1}.org/">x</a>') for i in range(29)] + [(29, "http://h29.org/x", '<a href="http://bad.net/es/">x</a>'), (30, "http://bad.net/es/", "")]
    rows = UF.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).orderBy("page_id").collect()
    assert [r["verdict"] for r in rows] == ["block"] * 31 and all(r["distrust"] > r["trust"] for r in rows)


def all_segmentations(own, word):
    out = []

    def walk(at, ids, log):
        if at == len(word):
            out.append((tuple(ids), log))
        for end in range(at + 1, min(len(word), at + own.longest) + 1):
            if word[at:end] in own.pieces:
                i, v = own.pieces[word[at:end]]
                walk(end, [*ids, i], log + v)
        if at < len(word) and word[at] not in own.pieces:
            spelled = [own.spelled[b] for b in word[at].encode()]
            walk(at + 1, ids + spelled, log + own.byte_log * len(spelled))

    walk(0, [], 0.0)
    return out


def test_segmentations_follow_gumbel_top_k():
    own = SG.segmenter(None)
    text = "the an"
    every = all_segmentations(own, "▁the▁an")
    whole = math.log(sum(math.exp(v) for _, v in every))
    p = {ids: math.exp(v - whole) for ids, v in every}
    n = 4000
    drawn = own.sample([text] * n, 2, list(range(n)))
    first, second = (collections.Counter(tuple(d[r][0].tolist()) for d in drawn) for r in (0, 1))
    for ids in sorted(p, key=p.get)[-3:]:
        after = sum(p[a] * p[ids] / (1 - p[a]) for a in p if a != ids)
        assert abs(first[ids] / n - p[ids]) < 0.03 and abs(second[ids] / n - after) < 0.03
    for d in drawn:
        assert d[0][0].tobytes() != d[1][0].tobytes() and d[0][2] >= d[1][2]
        assert math.exp(d[0][1]) == pytest.approx(p[tuple(d[0][0].tolist())])
    assert sum(math.exp(log) / inc for d in drawn for _, log, _, inc in d) / n == pytest.approx(1, abs=0.02)


def test_near_certain_words_give_all_segmentations():
    own = SG.segmenter(None)
    for text in ("of", "a", ".", "the", "A?"):
        every = {ids: log for ids, log in all_segmentations(own, "▁" + text)}
        [drawn] = own.sample([text], len(every) + 2, [3])
        assert {tuple(ids.tolist()) for ids, *_ in drawn} == set(every) and len(drawn) == len(every) >= 2
        assert all(0 <= inclusion <= 1 for *_, inclusion in drawn)


def test_words_that_no_piece_crosses():
    own = SG.segmenter(None)
    for text in ["a", " a", "a b", "a  b", "a\nb", "a \n b\n", "\n\n a", "▁a b", "x\n\n\ny z "]:
        assert own.words(text) == own.units("▁" + text.replace(" ", "▁")) and "".join(own.words(text)) == "▁" + text.replace(" ", "▁")


def test_kept_lattices_change_nothing(monkeypatch):
    texts = [t + " of a\nx  y" for t in make_texts(60, 31)]
    own = SG.Segmenter(SG.vocabulary_path())
    whole = own.sample(texts, 3, list(range(60)))
    monkeypatch.setattr(SG, "KEPT_LETTERS", 100)  # all anew for each text
    for i, drawn in enumerate(whole):
        [alone] = own.sample(texts[i : i + 1], 3, [i])
        assert [d[0].tolist() for d in alone] == [d[0].tolist() for d in drawn]
        assert [d[1:] for d in alone] == [pytest.approx(d[1:], rel=1e-9) for d in drawn]


def test_segmentations_of_rows(spark):
    texts = ["Hello  wörld\nfoo ☃ 漢", "", None, "a", " lead", "x" * 300, "  tab\t"]
    df = SG.sampled_segmentations(documents(spark, texts), samples=3)
    rows = SG.decoded(df).collect()
    for r in rows:
        assert r["decoded"] == (texts[r["doc_id"]] or "") and r["round_trip"]
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) and 0 <= r["inclusion"] <= 1
    by = collections.Counter(r["doc_id"] for r in rows)
    assert by[0] == by[5] == 3 and by[1] == by[2] == 1
    assert len({(r["doc_id"], tuple(r["ids"])) for r in rows}) == len(rows)
    alone = SG.sampled_segmentations(documents(spark, texts).filter("doc_id = 5"), samples=3).collect()
    assert sorted(r["ids_crc32"] for r in alone) == sorted(r["ids_crc32"] for r in rows if r["doc_id"] == 5)


def test_words_are_those_of_a_regex():
    texts = ["Hello, wörld 12a", "", "...", "A", "a-b  c"]
    import pyarrow as pa

    from leadweave.llm.common import byte_chunks

    [(_, data, offsets)] = byte_chunks(pa.array(texts))
    hashes, first, last, before = Words()(data, offsets)
    body = data.tobytes()
    assert [body[a:b] for a, b in zip(first, last)] == [w for t in texts for w in re.findall(rb"[A-Za-z0-9\x80-\xff]+", t.encode())]
    assert np.diff(before).tolist() == [3, 0, 0, 1, 3]
    assert len(set(hashes.tolist())) == 6  # "A" and "a" are one


def test_round_trips_at_once_are_those_of_each():
    from leadweave.llm.segmentations import segmenter

    own = segmenter(None)
    texts = ["", "a plain text", " starts with a space", "two  spaces\nand a line", "caf\u00e9 \u6f22\u5b57 \U0001f600 \u00fc", "\ufffd"]
    ids = [found[0][0] for found in own.sample(texts, 1, list(range(len(texts))))]
    ids += [ids[1], np.array([own.spelled[0xC3]]), ids[0], np.array([own.spelled[0xC3]])]
    texts += ["a plain texT", "\ufffd", "x", "\u00c3"]
    assert own.round_trips(ids, texts) == [own.decode(i.tolist()) == t for i, t in zip(ids, texts, strict=True)] == [True] * 6 + [False, True, False, False]
    assert own.round_trips([], []) == [] and own.round_trips([ids[0]], [""]) == [True]
