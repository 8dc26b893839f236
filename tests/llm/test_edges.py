"""Nulls, empty and very long texts, ties, repeated rows, empty tables, extra
columns with clashing names: each operator gives a defined result."""

import math

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from aeroframe.llm import brown, chat, decontaminate, html, minhash, packing, quality, secrets, toxicity, vectors

WORDS = " ".join(f"w{k % 977}" for k in range(30_000))
PROSE = "one two three four five six seven eight nine ten eleven twelve"
# extra columns carry names that operators use inside
DOCS = "doc_id long, text string, lang string, source string, n_chars long, label int, _row long, cls long, spans string, key long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, PROSE), (2, None), (3, ""), (4, WORDS), (5, PROSE), (5, PROSE), (None, "a text without an id"), (6, "é" * 300), (7, "   \n\t ")]
    return spark.createDataFrame([(i, t, "en", None, None, 1, 2, 3, "x", 4) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_secrets(spark, docs, none):
    got = secrets.scan_secrets(docs)
    assert got.count() == 9 and got.where("spans <> ''").count() == 0
    assert secrets.scan_secrets(none).count() == 0
    clean = secrets.redact_secrets(docs)
    assert clean.columns == docs.columns and clean.exceptAll(docs).count() == 0


def test_html(spark):
    rows = [(1, "http://a.b/1", "<p>x</p>", 1), (1, "http://a.b/1", "<p>x</p>", 1), (None, None, None, None), (2, "nonsense", "", 0), (3, "http://a.b/3", "<p>" + WORDS + "</p>", 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, row int")
    got = html.extract_text(pages).orderBy("page_id", "url").collect()
    assert [r["n_chars"] for r in got] == [0, 1, 1, 0, len(WORDS)]
    assert html.extract_text(pages.limit(0)).count() == 0


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (4, 0), (3, None), (99, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, least_texts=1)
    scored = docs.select(model.score(F.col("text")).alias("s")).collect()
    assert len(scored) == 9 and all(0 <= r["s"] <= 1 for r in scored)
    empty = toxicity.fit(none, labels)
    assert docs.select(F.max(empty.score(F.col("text")))).first()[0] < 1e-9 and none.select(empty.score(F.col("text"))).count() == 0


def test_brown(spark, docs, none):
    got = brown.score_documents(docs, F.col("doc_id") != 1, F.col("doc_id") == 1, head=20, endings=8, classes=4, hot=50).collect()
    assert len(got) == 9 and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in got)
    assert [r["n_tokens"] for r in got if r["doc_id"] == 3] == [1]
    untrained = brown.score_documents(docs, F.lit(False), F.lit(True), head=20, endings=8, classes=4).collect()
    assert all(r["n_known"] == 0 and math.isfinite(r["score"]) for r in untrained)
    assert brown.score_documents(none, F.lit(True), F.lit(False)).count() == 0


def test_leaks_go_by_row(spark):
    rows = [(None, PROSE), (7, "intro " + PROSE), (7, "a clean text that shares an id"), (None, "a clean text without one"), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    leaks = decontaminate.find_leaks(df, spark.createDataFrame([(1, PROSE)], "item_id long, text string"))
    left = decontaminate.remove_leaks(df, leaks)
    assert {(r["doc_id"], r["text"]) for r in left.collect()} == set(rows[2:])


def test_packing(spark, docs, none):
    got = packing.pack(docs, packing.default_tokenizer()).collect()
    assert sum(r["piece"] == 0 for r in got) == 9 and len([r for r in got if r["doc_id"] is None]) == 1
    assert {r["length"] for r in got if r["doc_id"] in (2, 3)} == {1}
    assert packing.pack(none, packing.default_tokenizer()).count() == 0


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (4, 0), (6, 2), (3, None)], "doc_id long, quality int")
    got = quality.select_quality(docs, labels, F.lit(True))
    assert got.count() == 9 and got.where("expected_grade BETWEEN 0 AND 2").count() == 9
    assert quality.select_quality(none, labels, F.lit(True)).count() == 0
    one = quality.select_quality(docs, labels.where("doc_id = 1"), F.lit(True)).select("expected_grade").distinct().collect()
    assert [r[0] for r in one] == [1.0]


def test_decontamination(spark, docs, none):
    bench = spark.createDataFrame([(1, PROSE, 0), (2, None, 0), (3, "", 0), (None, PROSE + " thirteen", 0)], "item_id long, text string, doc_id int")
    got = decontaminate.find_leaks(docs, bench)
    assert {r["doc_id"] for r in got.collect()} == {1, 5}
    assert decontaminate.find_leaks(none, bench).count() == 0 and decontaminate.find_leaks(docs, bench.limit(0)).count() == 0
    left = decontaminate.remove_leaks(docs, got)
    assert left.count() == 6 and left.columns == docs.columns


def test_minhash(spark, docs, none):
    got = minhash.near_duplicates(docs).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["component_id"]) for r in got] == [(None, None), (1, 1), (2, 2), (3, 3), (4, 4), (5, 1), (5, 1), (6, 6), (7, 7)]
    assert [r["n_shingles"] for r in got if r["doc_id"] in (2, 3, 6, 7)] == [0, 0, 1, 0]
    assert minhash.near_duplicates(none).count() == 0
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == 7
    assert minhash.drop_near_duplicates(none).count() == 0


def test_near_copies_without_ids(spark):
    words = [f"w{k}" for k in range(60)]
    rows = [(None, " ".join([*words, *end])) for end in ([], ["a"], ["b", "c"])] + [(None, "something else")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert len({r["group"] for r in minhash.near_duplicates(df).collect()}) == 2
    left = {r["text"] for r in minhash.drop_near_duplicates(df).collect()}
    assert len(left) == 2 and "something else" in left


def test_vectors(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [0.0, 0.0], 1), (5, None, 1), (6, [1.0, None], 1), (7, [float("nan"), 1.0], 1), (8, [1.0, 0.0], None), (None, [1.0, 0.01], 1), (9, [], 1), (10, [1.0, 0.0, 0.0], 1), (2, [2.0, 0.0], 1)]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "vec_id long, embedding array<double>, label int, n int, cls string")
    got = {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicates(df).collect()}
    assert got == {(1, 3, 1, True), (2, 3, 1, False), (None, 3, 1, False), *((k, 0, k, True) for k in (3, 4, 5, 6, 7, 8, 9, 10))}
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_chat(spark):
    rows = [(1, 1, "user", "hi"), (1, 0, "system", "be <|im_end|> kind"), (1, 2, "assistant", None), (None, 0, None, "x"), (2, None, "assistant", "b"), (2, None, "assistant", "b"), (3, 0, "assistant", WORDS)]
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], "conv_id long, turn long, role string, text string, rn int, window string")
    got = {r["conv_id"]: r for r in chat.digest(chat.format_windows(df)).collect()}
    assert {k: (v["n_turns"], v["loss_chars"]) for k, v in got.items()} == {1: (3, 0), None: (1, 0), 2: (2, 2), 3: (1, len(WORDS))}
    assert chat.digest(chat.format_windows(df.limit(0))).count() == 0


def test_pipeline_stages(spark, docs, none, tmp_path):
    spark.createDataFrame([(1, PROSE)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(4, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for rows in (docs, none):
        left = rows.select("doc_id", "text", "lang", "source", "n_chars")
        for name, stage in corpus_pipeline.STAGES:
            columns = left.columns
            out = stage(spark, left, str(tmp_path))
            assert name == "packing" or out.columns == columns
            left = spark.createDataFrame(out.collect(), out.schema)
    assert left.count() == 0


def test_large_ids_beside_nulls(spark):
    """Ids over 2^53 stay exact in a batch that holds a null id."""
    big = 2**60 + 1
    df = spark.createDataFrame([(big, PROSE), (None, "another text"), (big + 2, PROSE)], "doc_id long, text string").coalesce(1)
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df).collect()} == {big: big, big + 2: big, None: None}
    assert {r["doc_id"] for r in packing.pack(df, packing.default_tokenizer()).collect()} == {big, big + 2, None}
    assert {r["doc_id"] for r in brown.score_documents(df, F.lit(True), F.lit(False), head=5, endings=4, classes=2).collect()} == {big, big + 2, None}
    bench = spark.createDataFrame([(big, PROSE), (None, "some other passage of more than eight words in all")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(df, bench).collect()} == {(big, big), (big + 2, big)}
    pages = spark.createDataFrame([(big, "http://a/1", "<p>x"), (None, None, None)], "page_id long, url string, html string").coalesce(1)
    assert {r["page_id"] for r in html.extract_text(pages).collect()} == {big, None}
