"""Embedders, and sparse search against all products."""

import random

import numpy as np
import pytest

from quarry.operators import sparse as S


def test_embedder_loads_once_a_task_and_skips_nulls(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else "x" * i) for i in range(200)], "id long, text string").repartition(2)
    loads = spark.sparkContext.accumulator(0)

    def embedder():
        loads.add(1)
        return lambda texts: np.array([[len(t), len(texts) <= 64] for t in texts], float)
    got = {r.id: r.embedding for r in S.embed(df, "text", embedder).collect()}
    assert got == {i: None if i % 5 == 0 else [float(i), 1.0] for i in range(200)} and loads.value == 2


@pytest.mark.parametrize("first", [0.0, 0.3, 0.7, 2.0])
def test_search_is_exact(spark, first):
    """For any first cut: dimensions of all lengths, copies, queries with few partners."""
    rnd = random.Random(8)
    common = [1 / (j + 1) for j in range(120)]

    def vector():
        some = {rnd.choices(range(120), common)[0]: rnd.random() + 0.01 for _ in range(rnd.randrange(1, 12))}
        size = sum(x * x for x in some.values()) ** 0.5
        return {d: x / size for d, x in some.items()}
    rows = {i: vector() for i in range(250)}
    rows |= {300 + i: rows[3] for i in range(6)}
    asked = {i: rows[i] for i in range(0, 60, 2)} | {900: {119: 0.6, 500: 0.8}, 901: {777: 1.0}}
    flat = lambda t: spark.createDataFrame([(i, d, w) for i, x in t.items() for d, w in x.items()], "id long, dim long, w double")
    got = {}
    for r in S.search(flat(rows), flat(asked), 4, first=first).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    want = {}
    for q, x in asked.items():
        s = [(-round(sum(w * y[d] for d, w in x.items() if d in y), 9), i) for i, y in rows.items() if x.keys() & y.keys()]
        if s:
            want[q] = [i for _, i in sorted(s)[:4]]
    assert got == want


def test_tfidf(spark):
    docs = spark.createDataFrame([(1, "The cat"), (2, "the dog the"), (3, ""), (4, None)], "doc_id long, text string")
    v, idf = S.tfidf(docs, "doc_id", "text")
    assert {r.dim: round(r.idf, 6) for r in idf.collect()} == {"the": round(np.log(5 / 3), 6), "cat": round(np.log(5 / 2), 6), "dog": round(np.log(5 / 2), 6)}
    by = {}
    for r in v.collect():
        by.setdefault(r.id, []).append(r.w)
    assert by.keys() == {1, 2} and all(abs(sum(w * w for w in x) - 1) < 1e-12 for x in by.values())
