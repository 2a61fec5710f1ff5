"""Quality, spelling variants and the conversation trie against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leadweave.llm import conversations as CV
from leadweave.llm import licenses as LI
from leadweave.llm import quality as QU
from leadweave.llm import spelling as SP
from leadweave.llm.common import U64, mix

# Spelling


def counted(rows, dropped=97):
    counts = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % dropped == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 3}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(words):
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


def spelling_rows(seed):
    rng = random.Random(seed)
    kinds = ["aabbccé"[i % 7] * (i % 3) + "".join(rng.choice("abé") for _ in range(5)) for i in range(60)] + ["hello", "helo", "hallo", "hellos", "helllo"]
    return [(i if i % 50 else None, " ".join(w.upper() if rng.random() < 0.1 else w for w in rng.choices(kinds, weights=[1 + (j % 13) ** 2 for j in range(len(kinds))], k=30))) for i in range(200)]


@pytest.mark.parametrize(("seed", "dropped"), [(1, 97), (2, 3)])
def test_spelling_by_brute_force(spark, seed, dropped):
    rows = [*spelling_rows(seed), (7, None), (8, ""), (9, "ab " * 9)]
    got = SP.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(1)), dropped=dropped).collect()
    want = variants(counted(rows, dropped))
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == want and len(got) == len(want)
    assert any(f for f, *_ in want.values()) and any(r not in (w, f) for w, (f, r, *_) in want.items())


def test_spelling_chain_of_forms(spark):
    """Each form has a form of its own: roots are several pointers away."""
    words = ["aaaaa" + "b" * i for i in range(12)]
    forms = spark.createDataFrame(list(zip(words, words[1:], strict=False)), "word string, form string")
    assert {r["word"]: r["root"] for r in SP.roots(forms).collect()} == dict.fromkeys(words[:-1], words[-1])


def test_spelling_of_nothing(spark):
    assert SP.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_words_write_no_pairs(spark):
    """A place that many letters fit: rows grow with the words, not with their pairs."""
    words = spark.createDataFrame([("abc" + chr(0x4E00 + i) + "de", 5 + i) for i in range(600)], "word string, n long")
    got = SP.near_words(words).collect()
    assert len(got) == 600 and {r["n_near"] for r in got} == {599}
    assert {(r["best"]["m"], r["best"]["other"][3]) for r in got} == {(-604, chr(0x4E00 + 599)), (-603, chr(0x4E00 + 598))}


# Conversations


def trie(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    members = collections.defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = collections.Counter(n[:-1] for n in members if n)
    leaves, saved = collections.Counter(), collections.Counter()
    for node, cs in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += (len(cs) - 1) * words
    out = []
    for node, cs in members.items():
        ended = ",".join(str(c) for c in sorted(cs) if len(built[c]) == len(node))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), kids[node], leaves[node], saved[node], hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversation_rows(seed, convs=70, most=5, ids=range(0, 130)):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(list(ids), convs):
        for t in range(rng.randrange(1, most)):
            rows.append((c, t if t or rng.random() < 0.7 else None, rng.choice(["user", "assistant", None]), rng.choice(["a b", "c\td  e", None, "", "ü " * 3])))
    rng.shuffle(rows)
    return rows


def found(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("key", F.lit("clash")).withColumn("depth", F.lit(3))
    return sorted((tuple(r[c] for c in COLUMNS) for r in CV.prefix_trie(df).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_by_brute_force(spark, seed):
    rows = [*conversation_rows(seed, most=6), (None, 0, "user", "lost")]
    assert found(spark, rows) == trie(rows)


def test_trie_of_long_conversations(spark):
    """Deep and shared: lengths on either side of powers of two, two copies of one, one that leaves another half way."""
    rows = [(20 * c, t, "user", f"t{t}" if c % 3 or t < 40 else f"u{t}") for c, n in enumerate([1, 2, 3, 4, 7, 8, 9, 65, 65, 63, 64, 90]) for t in range(n)]
    assert found(spark, rows) == trie(rows)


def test_trie_of_branches_on_branches(spark):
    """Each conversation leaves the one before a turn later, the longest begin with the same turns."""
    rows = [(20 * c, t, "user", f"t{t} x" if t < c else f"own {c}") for c in range(9) for t in range(12 - c % 3)]
    assert found(spark, rows) == trie(rows)


def test_plans_do_not_grow_with_the_longest_conversation(spark, monkeypatch):
    """Each plan costs the driver memory, so that one long conversation must not add any."""
    cuts = []
    monkeypatch.setattr(CV, "cut_lineage", lambda df, cut=CV.cut_lineage: (cuts.append(1), cut(df))[1])
    rows = [(20 * c, t, "user", f"t{t}" if t < 2 else f"own {c}") for c in range(4) for t in range(3)]
    assert found(spark, rows) == trie(rows)
    few = len(cuts)
    rows += [(60, t, "user", "more") for t in range(3, 300)]
    assert found(spark, rows) == trie(rows)
    assert len(cuts) == 2 * few


def test_trie_of_one_crowd(spark, monkeypatch):
    """A third of the conversations are copies: their ids go to the hash in several texts."""
    monkeypatch.setattr(CV, "RUN", 7)
    rows = [(c, t, "user", "same" if c % 3 else f"own {c}") for c in range(0, 4000, 20) for t in range(3)]
    assert found(spark, rows) == trie(rows)


@pytest.mark.parametrize("rows", [[], [(5, 0, "user", "x")], [(5, 1, None, None)] * 3, [(41, t, "user", "y") for t in range(2)], [(-3, 0, "user", "z"), (-20, 0, "user", "q")]], ids=["empty", "one", "repeated", "headless", "negative"])
def test_odd_tries(spark, rows):
    assert found(spark, rows) == trie(rows)


# Quality


def plain_tokens(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9\x80-\U0010ffff]+|[^A-Za-z0-9\x80-\U0010ffff\s]+", text):
        out.append(m.group())
    return out


def plain_hash(token, signs):
    value = [int(mix(np.array([b + (1009 if signs else 7)], dtype=U64))[0]) | 1 for b in token.encode()]
    base = 0x9E3779B97F4A7C15 | 1
    total = sum(v * pow(base, i, 1 << 64) for i, v in enumerate(value)) % (1 << 64)
    return int(mix(np.array([total], dtype=U64))[0])


def plain_index(h):
    v = np.zeros(QU.DIMS)
    for g in range(QU.GROUPS):
        bits = (h >> (4 * g)) & 15
        v[g * QU.WIDE + (bits >> 1)] = 1 if bits & 1 else -1
    return v


def plain_form(token):
    letters = [c for c in token if c.isascii() and c.isalpha() or "À" <= c <= "ÿ"]
    up = sum(c.isascii() and c.isupper() or "À" <= c <= "Þ" for c in letters)
    kind = 0 if not re.match(r"[A-Za-z0-9\x80-\U0010ffff]", token) else 1 if re.search("[0-9]", token) else 2 if up > 1 and up == len(letters) else 3 if up == 1 and token[0] in letters and (token[0].isupper()) else 4 if up else 5
    size = len(token.encode())
    return kind * 3 + (size > 3) + (size > 7)


TEXTS = ["An er in, AN ER!! on the Re2 ñandú", "on on on on on", "", None, "x", "?? !! ??", "ÉTÉ été Été aÉ É " * 5, "the re an er " * 60, "a　b 漢字"]


def features_by_hand(texts, vocabulary):
    rows = [[(t, plain_hash(t, not re.match(r"[A-Za-z0-9\x80-\U0010ffff]", t))) for t in plain_tokens(x or "")] for x in texts]
    slot = {h: QU.FORMS + i for i, h in enumerate(int(v) for v in vocabulary)}
    place = [[slot.get(h, plain_form(t)) for t, h in row] for row in rows]
    near = [[sum((plain_index(row[j][1]) for j in range(max(0, i - 2), min(len(row), i + 3)) if j != i), np.zeros(QU.DIMS)) for i in range(len(row))] for row in rows]
    total = np.zeros((QU.FORMS + len(vocabulary), QU.DIMS))
    for p, n in zip(place, near, strict=True):
        for a, b in zip(p, n, strict=True):
            total[a] += b
    vectors = QU.unit(total)
    out = []
    for row, p, n in zip(rows, place, near, strict=True):
        k = max(len(row), 1)
        around = [QU.unit(v) for v in n]
        index = [plain_index(h) for _, h in row]
        mean = sum((vectors[a] for a in p), np.zeros(QU.DIMS)) / k
        own = sum(float(i @ a) for i, a in zip(index, around, strict=True)) / np.sqrt(QU.GROUPS) / k
        used = sum(float(vectors[a] @ b) for a, b in zip(p, around, strict=True)) / k
        spread = np.log1p((sum(index, np.zeros(QU.DIMS)) ** 2).sum() / QU.GROUPS) - np.log1p(len(row))
        out.append([*mean, own, used, spread, np.log1p(len(row))])
    return vectors, np.array(out)


@pytest.mark.parametrize("block", [1 << 16, 3])
def test_word_vectors_and_pooling_by_hand(spark, monkeypatch, block):
    monkeypatch.setattr(QU, "BLOCK", block)
    words = ["an", "er", "on", "the", "re", "??", "été"]
    vocabulary = np.sort(np.array([plain_hash(w, w == "??") for w in words], dtype=U64))
    vectors, want = features_by_hand(TEXTS, vocabulary)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    got = QU.word_vectors(docs, vocabulary)
    assert np.allclose(got, vectors)
    assert np.allclose(QU.pooled(pa.array(TEXTS, pa.string()), vocabulary, got), want, atol=1e-5)


def test_temperature_is_the_best():
    rng = np.random.default_rng(3)
    z = rng.normal(0, 4, 3000)
    y = (rng.random(3000) < QU.sigmoid(z / 3)).astype(int)
    best = QU.fit_temperature(z, y)
    assert all(QU.log_loss(z / best, y) <= QU.log_loss(z / t, y) + 1e-9 for t in np.linspace(0.5, 9, 200)) and 2.5 < best < 3.6


def test_network_gradient_learns_what_is_not_linear():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 2))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    net = QU.fit_network(x, y)
    fresh = rng.normal(size=(1000, 2))
    assert ((net.probabilities(fresh) > 0.5) == (fresh[:, 0] * fresh[:, 1] > 0)).mean() > 0.93
    again = QU.fit_network(x, y)
    assert np.array_equal(net.w1, again.w1) and net.temperature == again.temperature


def quality_corpus(spark, n=260, seed=5):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("an er in on the re ti".split()) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(10, 80))]
        bad = i % 4 == 0
        rows.append((i, " ".join(w + rng.choice(["***", "$$$"]) if bad else w for w in words)))
        labels.append((i, int(not bad), 0))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_holds_out(spark):
    docs, labels = quality_corpus(spark)
    model = QU.learn(docs, labels.filter("doc_id % 3 <> 1"))
    rows = QU.score_texts(docs, model).join(labels, "doc_id").filter("doc_id % 3 = 1").collect()
    assert sum((r["score"] >= 0.5) == r["quality"] for r in rows) / len(rows) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


ODD = [(0, "an er"), (0, "an er"), (1, None), (2, ""), (3, "?? !!"), (None, "null id"), (4, "word " * 40_000), (5, "x" * 60_000), (6, "\u0000� 漢字 \U0001f600")]


@pytest.mark.parametrize("kinds", [[(0, 1), (2, 0), (0, 0), (None, 1), (3, None), (4, 7)], [(0, 1)], []], ids=["both", "one", "none"])
def test_quality_of_odd_rows(spark, kinds):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("label", "digest", "score", "slot", "x")})
    model = QU.learn(docs, spark.createDataFrame(kinds, "doc_id long, quality int"))
    rows = QU.score_texts(docs, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] == 0}) == 1
    assert QU.score_texts(docs.limit(0), model).count() == 0


# Licenses whose words drift


@pytest.mark.parametrize("name", ["mit", "bsd-3-clause", "apache-2.0-notice", "gpl-3.0-notice"])
def test_licenses_with_insertions(spark, name):
    """1 to 12 foreign words after every 8th, 12th, 20th and 40th: the whole passage is one, with nearly all of its words."""
    words, texts, cases = LI.TEMPLATES[name].split(), [], []
    for every in (8, 12, 20, 40):
        for n in range(1, 13):
            out = []
            for i, word in enumerate(words):
                out += [word] + [f"foreign{i}w{j}" for j in range(n)] * (i % every == every - 1)
            texts.append(" ".join(["before it", *out, "after it"]))
            cases.append((every, n))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = collections.defaultdict(list)
    for r in LI.scan(docs).filter(F.col("license") == name).collect():
        found[r["doc_id"]].append(r)
    for i, (every, n) in enumerate(cases):
        assert len(found[i]) == 1, (every, n)
        assert found[i][0]["coverage"] >= (0.9 if n < min(8, every) else 0.7), (every, n)
