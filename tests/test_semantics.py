"""One failing case of each named fault, and operators without a query of their own."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import results as RS
from quarry.operators import routing as R
from quarry.operators import sessions as K
from quarry.operators import vectors as V
from quarry.sources import tables as TB
from quarry.streaming import jobs as X


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def test_pages_past_fifty(spark):
    s = spark.createDataFrame([(i, "u", day(i)) for i in range(60)], "session_id long, user_email string, created_at timestamp")
    page = K.list_sessions(s, 10, 50).orderBy("position").collect()
    assert [r.session_id for r in page] == list(range(9, -1, -1)) and page[0].total == 60
    assert K.newest_sessions(s).count() == 50


def test_mixed_lengths_and_zero_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [0.6, 0.8]), (4, [0.0, 0.0]), (5, None)], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(9, [1.0, 0.0]), (8, [0.0, 0.0, 1.0])], "query_id long, embedding array<float>")
    got = {(r.query_id, r.vec_id) for r in V.knn(v, q, 3).collect()}
    assert got == {(9, 1), (9, 3), (8, 2)}
    assert {r.vec_id: r.reason for r in V.unsearchable(v, [2, 3]).collect()} == {4: "zero", 5: "null"}


def test_ties_beyond_six_places(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0009]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert V.knn(v, q, 1).first().vec_id == 2


def test_dot_and_l2(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [3.0, 3.0]), (3, [0.5, 0.5])], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(9, [1.0, 1.0])], "query_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in V.knn(v, q, 3, metric="dot").orderBy("rank").collect()] == [(2, 6.0), (1, 1.0), (3, 1.0)]
    got = [(r.vec_id, round(r.score, 6)) for r in V.knn(v, q, 3, metric="l2").orderBy("rank").collect()]
    assert got == [(3, -0.707107), (1, -1.0), (2, -2.828427)]


def test_approximate_search(spark):
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(20, 16)) * 3
    rows = [(i, [float(x) for x in centre[i % 20] + rng.normal(size=16)]) for i in range(1000)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = v.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = {(r.query_id, r.vec_id) for r in V.knn(v, q, 10).collect()}
    some = {(r.query_id, r.vec_id) for r in V.ann(v, q, 10, cells=32, probes=8, split=300).collect()}
    full = {(r.query_id, r.vec_id) for r in V.ann(v, q, 10, cells=32, probes=32, split=300).collect()}
    assert full == exact and len(some & exact) >= 0.9 * len(exact)


def test_surplus_contexts(spark):
    a, b = spark.range(3).withColumnRenamed("id", "x"), spark.range(10, 14).withColumnRenamed("id", "y")
    with pytest.raises(ValueError):
        TB.attach_by_position(a, "x", b, "y")
    got = TB.attach_by_position(a, "x", b.where("y < 13"), "y").collect()
    assert {(r.x, r.y) for r in got} == {(0, 10), (1, 11), (2, 12)}


def test_queries_without_hits_and_stripped_labels(spark):
    hits = spark.createDataFrame([(1, 7, 1, 0.1), (1, 8, 2, 0.9), (2, 9, 1, None)], "query_id long, vec_id long, rank int, score double")
    judge = spark.createDataFrame([(7, " Yes\n"), (9, "NO")], "vec_id long, answer string")
    lab = R.judge_relevance(hits, judge, 0.7)
    assert {r.vec_id: r.label for r in lab.collect()} == {7: "yes", 8: "yes", 9: "no"}
    asked = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    got = {r.query_id: (r.n_hits, r.relevancy_score, r.s) for r in R.relevancy(lab, queries=asked).withColumn("s", R.status(F.col("relevancy_score"))).collect()}
    assert got == {1: (2, 1.0, "correct"), 2: (1, 0.0, "incorrect"), 3: (0, None, "incorrect")}
    texts = spark.createDataFrame([(7, "seven"), (8, "eight"), (9, "nine")], "vec_id long, text string")
    assert {r.query_id: r.relevant_text for r in R.relevant_text(lab, texts, queries=asked).collect()} == {1: "seven\neight", 2: "", 3: ""}


def test_owner_before_latest(spark):
    s = spark.createDataFrame([(1, "me", "old", day(0))], "session_id long, user_email string, title string, updated_at timestamp")
    u = spark.createDataFrame([(1, "stranger", "stolen", day(9)), (1, "me", "mine", day(2)), (1, "me", "older", day(1))],
                              "session_id long, user_email string, title string, updated_at timestamp")
    r = K.update_sessions(s, u).first()
    assert (r.title, r.updated_at) == ("mine", day(2))


RES = "id string, query string, answer array<string>, long_answer string, short_answer string, is_exact_match int, is_substring_match int, status string, error string, n int"


def row(i, status, n, text=None):
    return (i, f"q{n}", None, text, text, 1, 1, status, None, n)


def test_first_error_only(spark):
    results = spark.createDataFrame([row("a", "error", 2), row("a", "error", 1), row("b", "correct", 3)], RES)
    rerun = spark.createDataFrame([row("a", "correct", 9, "late"), row("a", "correct", 5, "early")], RES)
    got = sorted((r.n, r.status, r.long_answer) for r in RS.merge_rerun(results, rerun, order=["n"]).collect())
    assert got == [(1, "correct", "early"), (2, "error", None), (3, "correct", None)]
    data = spark.createDataFrame([("a", 2, "second"), ("a", 1, "first")], "id string, n int, x string")
    assert RS.lookup_items(results.where("n = 1"), data, order=["n"]).first().x == "first"


def test_result_files(spark, tmp_path):
    path = tmp_path / "r.jsonl"
    path.write_text('{"id": "1", "status": "correct"}\n\nnot json\n')
    got = RS.read_results(spark, str(path)).collect()
    assert [r.id for r in got] == ["1", None] and got[1]["_corrupt_record"] == "not json"
    assert RS.read_results(spark, str(tmp_path / "missing")).count() == 0
    RS.write_results(spark.createDataFrame([("1", "x")], "id string, status string"), str(tmp_path / "out"))
    lines = [x for f in (tmp_path / "out").glob("part-*.json") for x in f.read_text().splitlines()]
    assert [json.loads(x) for x in lines] == [{"id": "1", "status": "x"}]
    RS.write_summary(spark.range(1), str(tmp_path / "s"))
    assert len(list((tmp_path / "s").glob("part-*.json"))) == 1


def test_retry_stops_and_merges(spark):
    calls = []

    def process(items):
        calls.append(1)
        ok = F.col("n") < len(calls) * 2
        return items.select("id", F.lit("q").alias("query"), F.lit(None).cast("array<string>").alias("answer"), *[F.lit(None).cast("string").alias(c) for c in ("long_answer", "short_answer")],
                            F.lit(0).alias("is_exact_match"), F.lit(0).alias("is_substring_match"), F.when(ok, "correct").otherwise("error").alias("status"), F.lit(None).cast("string").alias("error"))
    merged, again = RS.retry(spark.createDataFrame([("a", 0), ("b", 2), ("c", 99)], "id string, n int"), process, attempts=2, order=["query"])
    assert {r.id: r.status for r in merged.collect()} == {"a": "correct", "b": "correct", "c": "error"} and {r.id for r in again.collect()} == {"b"}


def test_process_safely(spark):
    @F.pandas_udf("value string, error string")
    def risky(s):
        import pandas as pd
        return pd.DataFrame([(None, "empty") if not x else (x.upper(), None) for x in s], columns=["value", "error"])
    df = spark.createDataFrame([("a",), ("",)], "s string")
    assert {(r.s, r.value, r.error) for r in RS.process_safely(df, risky(F.col("s"))).collect()} == {("a", "A", None), ("", None, "empty")}


def test_default_embedder(spark):
    df = spark.createDataFrame([(1, "red cat"), (2, "red cat"), (3, "blue dog")], "id long, text string")
    e = {r.id: np.array(r.embedding) for r in V.hashed_tfidf(df, "text", num_features=64).collect()}
    assert np.allclose(e[1], e[2]) and abs(np.linalg.norm(e[3]) - 1) < 1e-6 and e[1] @ e[3] < 0.9


def test_late_rows_and_exempt_route(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long, event_type string"
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(seconds=i), 1, "call") for i in range(13)] + [(50, base, 1, "health")]
    (tmp_path / "in").mkdir()
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / "a"))
    src = str(tmp_path / "in" / "a")
    got = X.rate_limit_stream(spark, src, spark.createDataFrame([], schema).schema, 10, "1 minute", exempt=("health",)).collect()
    twin = X.rate_limit_batch(spark.read.parquet(src), 10, "1 minute", exempt=("health",)).collect()
    assert [(r.user_id, r.n_requests, r.n_limited) for r in got] == [(1, 13, 3)] == [(r.user_id, r.n_requests, r.n_limited) for r in twin]


def test_positions_of_null_keys(spark):
    rows = TB.row_position(spark.createDataFrame([(5, "b"), (None, "n"), (1, "a"), (70000, "c")], "k long, x string"), "k").orderBy("pos").collect()
    assert [(r.pos, r.x) for r in rows] == [(0, "n"), (1, "a"), (2, "b"), (3, "c")]
