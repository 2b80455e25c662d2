"""The end-to-end evaluation over rows made here: texts that have no sentence stop nothing and ask nothing."""

import pytest

from quarry.plans import evaluation, pipeline


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("rag"))
    texts = {0: "The red fox runs. It rests.", 7: "A blue whale swims! Far.", 14: "...", 21: "", 28: " \n!", 35: None, 63: "Green frogs jump. High."}
    rows = {"documents": ([(i, t) for i, t in texts.items()], "doc_id long, text string"),
            "benchmark": ([(i, f"passage {i}") for i in range(10)], "item_id long, text string"),
            "embeddings": ([(i, [1.0, i / 10, 0.5]) for i in texts], "vec_id long, embedding array<float>"),
            "labels": ([(0, 1), (7, 0)], "doc_id long, quality int"),
            "pages": ([(1, "u", "<title>Fox</title><article>Red fox. Blue whale.</article>"), (2, "v", "<article>...</article>")], "page_id long, url string, html string")}
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{sf}/{name}.parquet")
    return sf


def test_final_summary_of_texts_without_sentences(spark, made):
    r = evaluation.final_summary(spark, made).collect()[0]
    assert (r.dataset_size, r.processed_items, r.n_failed) == (10, 2, 1) and 0 < r.rouge1_fmeasure <= 1


def test_rag_eval_of_texts_without_sentences(spark, made):
    got = {r.id: r for r in pipeline.rag_eval(spark, made).collect()}
    assert {i: r.status for i, r in got.items()} == {0: "correct", 1: "correct", 9: "error"}
    assert got[0].long_answer == "the red fox runs." and got[0].is_exact_match == 1 and got[9].long_answer is None
