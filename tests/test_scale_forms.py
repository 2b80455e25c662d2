"""Forms that scale give what the plain ones give."""

import numpy as np
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import chunking as C
from quarry.operators import vectors as V


def test_normalized_ascii_rows(spark):
    texts = ["The  a_an the\tcat's\x0b end", "a\x1cb An x", "été the À la", "", None, "the", "I-beam a the b", "x theé a"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    want = {r.id: r.n for r in df.select("id", T.normalize_answer(F.col("text")).alias("n")).collect()}
    assert {r.id: r.n for r in T.with_normalized(df, "text", "n").collect()} == want


def test_chunks_carry_no_document(spark):
    """Sentence arrays do not go through the explode: a chunk's row holds its own text only."""
    docs = spark.createDataFrame([(1, "One two. Three four five six seven! Eight."), (2, None), (3, " . "), (4, "\n")], "doc_id long, text string")
    got = C.chunk_sentences(docs, 4, 2)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    line = next(x for x in plan.splitlines() if "Generate" in x)
    assert "_s" not in line.split("[")[-1] and plan.count("regexp_extract_all") <= 4
    assert sorted(map(tuple, got.where("doc_id = 1").collect()))[0][1:3] == (0, 3)
    assert got.where("doc_id = 3").count() == 1 and not got.where("doc_id in (2, 4)").count()


def test_parents_need_few_children(spark):
    """Most queries stop early; one whose parents have many children goes on to the whole fetch."""
    rng = np.random.default_rng(5)
    near = [([1.0, 0.001 * i, 0.0], 0) for i in range(40)]                   # 40 children of one parent around one direction
    rows = [(i, v, p) for i, (v, p) in enumerate(near + [(rng.standard_normal(3).tolist(), 1 + i % 30) for i in range(90)])]
    emb = spark.createDataFrame(rows, "vec_id long, embedding array<double>, parent_id long")
    q, cp = emb.select(F.col("vec_id").alias("query_id"), "embedding"), emb.select("vec_id", "parent_id")
    for fetch in (20, 60, 500):
        want = V.top_parents(V.knn(emb, q, fetch, exclude_self=True), cp, 4)
        got = V.search_parents(emb, q, cp, 4, fetch, first=8, exclude_self=True)
        assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_scan_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    v = np.round(rng.standard_normal((9000, 4)), 1)                          # many ties, some copies
    ids = np.r_[np.arange(8000), np.arange(1000)]
    for metric in V.METRICS:
        row, vid, sc = V.cell_topk(ids[:30], v[:30], ids, v, 5, metric, 6, True)
        p = V._prepare(v, metric)
        for r in range(30):
            s = np.round(V._score(p, p[r:r + 1], metric)[:, 0], 6)
            s[(ids == ids[r]) | ~np.isfinite(s)] = -np.inf
            best = np.lexsort((ids, -s))[:5]
            assert np.allclose(sc[row == r], s[best], atol=1.1e-6)
            assert sorted(vid[row == r]) == sorted(ids[best])
