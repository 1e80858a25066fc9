"""Bounded draws of rows and of pieces of texts."""

import numpy as np
from pyspark.sql import functions as F
from skewline.llm import common, langid, pii, quality, urls


def test_a_frequent_row_is_one_row_with_its_weight(spark):
    rows = spark.range(30_000).selectExpr("if(id % 3 = 0, -1, id) a", "cast(if(id % 3 = 0, null, id) as string) b")
    got = common.draw(rows, 500).collect()
    assert 380 < len(got) < 500 and {r.weight for r in got if r.a != -1} == {1}
    every = common.draw(rows, 40_000).collect()
    assert len(every) == 20_001 and [r.weight for r in every if r.a == -1] == [10_000]
    assert common.draw(rows.limit(0), 5).collect() == []


def test_windows_come_from_whole_texts(spark):
    text = "".join(f"{i:05d}" for i in range(2000))
    rows = [("a", text), ("a", text), ("b", "short"), ("b", None), ("c", ""), ("b", "x" * 25)]
    df = spark.createDataFrame(rows, "k string, text string")
    got = {}
    for r in common.draw_windows(df, 10_000, 10, "k").collect():
        got.setdefault(r.k, []).append(r.window)
    assert sorted(got["a"]) == [text[i:i + 10] for i in range(0, 10_000, 10)] and sorted(got["b"]) == ["short", "x" * 5, "x" * 10]
    few = [r.window for r in common.draw_windows(df, 200, 10, "k").collect() if r.k == "a"]
    at = np.array([text.index(w) for w in few])
    assert 60 < len(few) < 140 and at.min() < 2000 and at.max() > 8000


def test_hot_url_is_collected_once(spark):
    pages = spark.range(9000).selectExpr("id page_id", "if(id % 3 = 0, 'http://shop.com/hot', if(id % 3 = 1, "
                                         "concat('http://a', id, '.com/x', id), concat('http://b.example.com/en/', id))) url")
    out = urls.judge(pages, train_rows=300)
    assert out.groupBy("verdict").count().count() == 2 and out.count() == 9000


def test_hot_labels_and_spans(spark):
    """A third of the rows share a doc_id (and text): they count, but as one learned row."""
    docs = spark.range(3000).selectExpr("if(id % 3 = 0, -7, id) doc_id", "if(id % 3 = 0, 'same words. mail x@y.org', "
                                        "concat('text ', id, ' has words ', repeat('and more ', cast(id % 40 as int)), id, '@y', id, '.org')) text")
    labels = spark.range(3000).selectExpr("id doc_id", "cast(id % 40 > 20 as int) quality").union(spark.sql("select -7L, 0"))
    out = quality.classify(docs, labels, train_rows=400)
    held = out.where("held_out and doc_id >= 0").join(labels, "doc_id")
    assert out.count() == 3000 and held.where("predicted = quality").count() / held.count() > 0.9
    assert pii.find(docs, train_spans=100).where("n_email = 1").count() == 3000


def test_every_language_is_learned(spark):
    """More labels than an earlier limit of 200, and texts that start in another language."""
    names = [f"l{i:03d}" for i in range(260)]
    rows = [(n, " ".join(f"{n}w{j}" for j in range(8 + k)), n) for n in names for k in range(4)]
    df = spark.createDataFrame([(i, t, n) for i, (n, t, _) in enumerate(rows)], "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert model["langs"] == names and model["weights"].size <= langid.WEIGHTS
    assert langid.feature_buckets(4) == langid.FEATURES


def test_texts_with_a_head_in_another_language(spark):
    rng = np.random.default_rng(1)
    words = {"en": "the of and to in that was his for with".split(), "de": "der die und nicht ein ist das auch von mit".split()}
    prose = lambda lang, n: " ".join(rng.choice(words[lang], n))
    rows = [(i, prose("en", 1200) + " " + prose("de", 4000), "de") for i in range(60)] + [(100 + i, prose("en", 2000), "en") for i in range(60)]
    out = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").union(
        spark.createDataFrame([(900, "the of and the was his", None), (901, "der und nicht das auch", None)], "doc_id long, text string, lang string")))
    got = {r.doc_id: r.lang_pred for r in out.where(F.col("doc_id") >= 900).collect()}
    assert got == {900: "en", 901: "de"}
