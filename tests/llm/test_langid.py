"""Language ID: held-out accuracy, a hand-made distance and odd rows."""

from pyspark.sql import functions as F

from quarry.llm.langid import _top, identify, learn, predict
import numpy as np


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 250 and right > 0.98


def test_top_order():
    assert _top(np.array([5, 3, 3, 9, 9, 1]), 3).tolist() == [3, 9, 1]


def test_distance_by_hand(spark):
    p = learn(spark.createDataFrame([("aab", "x"), ("b", "y"), ("q", None), (None, "x")], "text string, lang string"))
    assert set(p) == {"x", "y"} and p["x"][0] == ord("a") and p["y"][0] == ord("b")
    docs = spark.createDataFrame([(1, "B!")], "doc_id long, text string")
    r = predict(docs, p).first()
    assert (r.lang_pred, r.score) == ("y", 1.0)          # the same n-grams in the same order


def test_odd_rows(make_docs):
    train = [(100 + i, "the cat and the dog", "en") for i in range(9)] + [(200 + i, "le chat et le chien", "fr") for i in range(9)]
    rows = [(1, None), (2, ""), (3, "12 ... 9"), (4, "The Cat " * 40_000), (5, "le chien", "en"), (5, "le chien"), (None, "the dog"),
            (6, "𝒳 ß İ 漢字")]
    got = identify(make_docs([*train, *rows]).withColumn("score", F.lit(3)).withColumn("code", F.lit("x"))).collect()
    by = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert len(got) == len(train) + len(rows)
    assert by[1] == by[2] == by[3] == ("und", 0.0)
    assert by[4][0] == "en" and by[5][0] == "fr" and by[None][0] == "en"
    assert all(0 <= r.score <= 1 for r in got)
    assert identify(make_docs([])).count() == 0
    assert {r.lang_pred for r in identify(make_docs([(1, "words"), (2, "more")])).collect()} == {"und"}


def test_long_text_in_stretches(make_docs, monkeypatch):
    import quarry.llm.langid as m
    text = "Ab cd, éfg 12 " * 500 + "x" * 300 + " end. " + "q" * 50
    values, n = m._counts(np.concatenate([c for c, _ in m._codes([text])]))
    for size in (7, 64, 1000):
        monkeypatch.setattr(m, "STRETCH", size)
        assert "".join(m._stretches(text)) == text
        v, k = m._long_counts(text)
        assert v.tolist() == values.tolist() and k.tolist() == n.tolist()
    assert m._long_counts("")[0].tolist() == []
