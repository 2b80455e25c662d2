"""Product-quantised search against the exact one."""

import numpy as np
from pyspark.sql import functions as F

from quarry.operators import compressed as C
from quarry.operators import vectors as V


def test_tables_add_up_to_products_with_decoded_vectors():
    rng = np.random.default_rng(1)
    m, q = rng.normal(size=(400, 10)), rng.normal(size=(7, 10))
    books = C.code_books(m)
    codes = C.encode(m, books)
    decoded = np.stack([books[s][codes[:, s]] for s in range(books.shape[0])], axis=1).reshape(400, -1)[:, :10]
    unit = q / np.linalg.norm(q, axis=1, keepdims=True)
    assert np.allclose(C.approximate(q, codes, books), unit @ decoded.T, atol=1e-5) and codes.dtype == np.uint8


def test_recall_over_many_cells(spark):
    """Unclustered vectors of two lengths, blocks and strips: recall of 0.9 with under a tenth of the pairs compared exactly."""
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=16 if i % 4 else 7).tolist()) for i in range(3000)]
    rows += [(3000, [0.0] * 16), (3001, None), (3002, [float("nan")] * 16), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = df.where("vec_id % 20 = 1 or vec_id % 20 = 0 or vec_id > 2999").withColumnRenamed("vec_id", "query_id")
    got = {(r.query_id, r.vec_id): r.score for r in C.search(df, q, 5, exclude_self=True, block_bytes=8000, strip_bytes=2000).collect()}
    want = {(r.query_id, r.vec_id): r.score for r in V.knn(df, q, 5, exclude_self=True).collect()}
    same = got.keys() & want.keys()
    assert len(want) == 300 * 5 == len(got) and len(same) >= 0.9 * len(want)
    assert all(abs(got[p] - want[p]) < 1e-12 for p in same)


def test_recall_of_registered_search(spark, sf):
    from quarry.plans import registry
    of = registry.queries()
    exact = {(r.query_id, r.vec_id) for r in of["knn_top8"](spark, sf).collect()}
    some = {(r.query_id, r.vec_id) for r in of["compressed_top8"](spark, sf).collect()}
    assert len(some & exact) >= 0.9 * len(exact)


def test_without_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert C.search(none, none.select(F.col("vec_id").alias("query_id"), "embedding"), 3).count() == 0
