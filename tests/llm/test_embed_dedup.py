"""Embedding near-duplicates against all pairs by numpy."""

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import embed_dedup
from quarry.llm.embed_dedup import deduplicate

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute_force(rows):
    ok = {}
    for k, (i, v) in enumerate(rows):
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(np.array(v, np.float32), np.float64)
            ok[k] = x / np.linalg.norm(x)
    up = {i: i for i, _ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    n = dict.fromkeys(range(len(rows)), 0)
    for k, x in ok.items():
        for j, y in ok.items():
            if j != k and len(x) == len(y) and (rows[j][1] == rows[k][1] or x @ y >= 0.95):
                n[k] += 1
                a, b = sorted((top(rows[k][0]), top(rows[j][0])))
                up[b] = a
    return sorted(((i, n[k], top(i) if i is not None else None, i is None or top(i) == i) for k, (i, _) in enumerate(rows)), key=str)


def check(df):
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert sorted(map(tuple, deduplicate(df).collect()), key=str) == brute_force(rows)


def test_whole_table(spark, sf):
    check(spark.read.parquet(f"{sf}/embeddings.parquet"))


def test_many_small_cells(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "UNIT", 16)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in centres[rng.integers(6)] + rng.normal(size=8) * rng.choice([0.05, 0.2, 1.5])], 0) for i in range(300)]
    rows += [(400 + i, rows[0][1], 1) for i in range(30)]
    check(spark.createDataFrame(rows, SCHEMA))


def test_odd_rows(spark):
    one = [1.0, 0.0, 2.0]
    rows = [(1, one, 0), (2, [2.0, 0.0, 4.0], 0), (3, None, 0), (4, [], 0), (5, [0.0, 0.0, 0.0], 0), (6, [1.0, None, 2.0], 0), (7, [1.0, float("nan"), 2.0], 0),
            (8, [float("inf"), 0.0, 1.0], 0), (9, [1.0, 2.0], 0), (10, [1e-30, 0.0, 2e-30], 0), (None, one, 0), (11, [2.0, 0.0, -1.0], 0), (12, one, 0), (13, [3.0, 6.0], 1)]
    check(spark.createDataFrame(rows, SCHEMA).withColumn("node", F.lit(1)).withColumn("v", F.lit("x")))
    assert deduplicate(spark.createDataFrame([], SCHEMA)).count() == 0
