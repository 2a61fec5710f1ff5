"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for each operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leadweave.llm import fingerprints, language, licenses, lm_score, near_duplicates, neighbours, packing, segmentations, toxicity, url_filter

TEXT = "the idiot an on st. Released under the MIT License. of and in é"
ROWS = [(0, TEXT, "en"), (0, TEXT, "en"), (1, TEXT, "en"), (2, None, None), (3, "", "en"), (4, "!!", None), (None, "null id text", "de"), (5, "word " * 40_000, "en"), (6, "x" * 60_000, "de"), (7, "\u0000� 漢字 \U0001f600", None)]
CLASH = ["id", "key", "block", "place", "score", "lang_pred", "finds", "_text", "row", "bands", "node", "bin", "n", "ids", "verdict"]
LABELS = [(0, 1), (1, 1), (3, 0), (None, 1), (4, None), (0, 0)]


def scored(docs):
    labels = docs.sparkSession.createDataFrame(LABELS, "doc_id long, toxic int")
    return toxicity.score_texts(docs, toxicity.learn_weights(toxicity.labelled(docs, labels)))


OPERATORS = {
    "fingerprints": fingerprints.fingerprint_documents,
    "edited": fingerprints.edited_fingerprints,
    "packing": packing.pack_documents,
    "licenses": licenses.scan,
    "language": lambda docs: language.identify(docs, language.learn_profiles(docs)),
    "near_duplicates": near_duplicates.near_duplicates,
    "one_of_each": near_duplicates.one_of_each,
    "lm": lambda docs: lm_score.score_documents(docs, lm_score.fold_of("doc_id", 5) != 1),
    "toxicity": scored,
    "segmentations": segmentations.sampled_segmentations,
}
#: Rows that come of ROWS: one for each, or as many as the docstring says.
COUNTS = {"packing": None, "licenses": 3, "one_of_each": None, "segmentations": None}


def make(spark, rows, clash=False):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return df.withColumns({c: F.lit("clash") for c in CLASH}) if clash else df


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(spark, name):
    found = OPERATORS[name](make(spark, ROWS, clash=True)).collect()
    if (wanted := COUNTS.get(name, len(ROWS))) is not None:
        assert len(found) == wanted
    ids = {r["doc_id"] for r in found}
    if name not in ("licenses", "one_of_each"):
        assert ids == {0, 1, 2, 3, 4, 5, 6, 7, None}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, name):
    assert OPERATORS[name](make(spark, [])).count() == 0


def test_single_row(spark):
    row = fingerprints.edited_fingerprints(make(spark, [(9, "ab cd", "en")])).first()
    assert row["near_next"] == 1.0 and row["n_chars"] == 5


def test_repeated_rows_agree(spark):
    rows = [r for r in near_duplicates.near_duplicates(make(spark, ROWS)).collect() if r["doc_id"] in (0, 1)]
    assert {(r["class_id"], r["n_links"]) for r in rows} == {(0, 2)}
    kept = [r["doc_id"] for r in near_duplicates.one_of_each(make(spark, ROWS)).collect()]
    assert 1 not in kept and 3 not in kept and 2 in kept and None in kept and kept.count(0) == 1


def test_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, v string")
    assert neighbours.nearest(empty, F.col("vec_id") % 2 == 0, 3).count() == 0
    same = spark.createDataFrame([(i % 6, [1.0, 0.0, 2.0], "x") for i in range(12)] + [(None, [1.0, 0.0, 2.0], "x")], "vec_id long, embedding array<float>, v string")
    rows = neighbours.nearest(same, F.col("vec_id") == 2, 3).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in rows] == [(0, 5.0), (1, 5.0), (3, 5.0)]


def test_vectors_of_different_lengths(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "vec_id long, embedding array<float>")
    best = neighbours.nearest(rows, F.col("vec_id") == 3, 2).orderBy("rank").collect()
    assert [r["vec_id"] for r in best] == [39, 38]


def test_pages(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string, trust string")
    assert url_filter.judge_urls(empty).count() == 0
    odd = spark.createDataFrame([(None, None, None, "x"), (1, "://", "<a href='//b.net/'>", "x"), (1, "://", "", "x")], "page_id long, url string, html string, trust string")
    assert {r["verdict"] for r in url_filter.judge_urls(odd).collect()} == {"allow"}


def data(spark, folder, rows):
    make(spark, rows).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(LABELS, "doc_id long, toxic int").withColumn("quality", F.lit(1)).write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.mark.parametrize("rows", [ROWS, []], ids=["odd", "empty"])
def test_stages(spark, tmp_path, rows):
    folder = data(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if i < 3:
            assert out.columns == columns
        out.write.parquet(f"{folder}/out{i}")
        docs = spark.read.parquet(f"{folder}/out{i}")
    assert docs.count() == corpus_pipeline.run(spark, folder).count()


def test_pipeline_by_brute_force(spark, tmp_path):
    """Language and toxicity leave what they should; one of each class stays; what stays is packed whole."""
    from .test_operators import brute_links, make_texts

    clean = make_texts(120, 21)
    toxic = [f"a scumbag {t}" for t in make_texts(40, 22, words=(20, 60))]
    texts = clean + toxic + ["123 456", "???"]
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    folder = str(tmp_path)
    make(spark, rows).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(120 <= i < 160), 1) for i in range(160)], "doc_id long, toxic int, quality int").write.parquet(f"{folder}/labels.parquet")
    label, _ = brute_links(clean)
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in packed} == set(label)
