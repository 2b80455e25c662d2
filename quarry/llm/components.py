"""Connected components by alternating large-star and small-star steps.

Edges are first dealt into parts of about ``PART`` and each part is replaced by a star forest of the
same components, so the rounds work on one edge a node and part. Every step is a grouped minimum (partially aggregated before the shuffle) and a join; a hub's rows
may be split by AQE because the other side of the join has one row a node. The edge table of each
round is written to the shared folder, so lineage stays one round long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored

#: Edges of one part.
PART = 1 << 20


def join_labels(labels: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Join the trees of the edges (u, v) in a forest whose nodes point at the smallest of their tree."""
    while True:
        a, b = labels[u], labels[v]
        apart = a != b
        if not apart.any():
            return labels
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while (up := labels[labels]).tobytes() != labels.tobytes():
            labels = up


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not got:
        return
    u, v = (np.concatenate(x) for x in zip(*got))
    nodes = np.unique(np.concatenate([u, v]))
    low = join_labels(np.arange(len(nodes)), np.searchsorted(nodes, u), np.searchsorted(nodes, v))
    some = low != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(nodes[low[some]])], ["u", "v"])


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (both.where("v > u").join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())


def _small_star(e: DataFrame) -> DataFrame:
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def _mark(e: DataFrame):
    r = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r.n, r.x


def components(edges: DataFrame, name: str = "components", rounds: int = 64) -> DataFrame:
    """(u, component) for every node with an edge, component the smallest node reachable.

    ``edges``: columns u, v, any order, repeats allowed; nulls and self-loops are ignored. An empty
    table gives an empty result.
    """
    first = stored(edges.where("u is not null and v is not null and u <> v")
                   .select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).distinct(), name)
    parts = 1 + first.count() // PART
    e = stored(first.repartition(parts).mapInArrow(_forest, "u long, v long"), name)
    forget(first)
    mark = _mark(e)
    for _ in range(rounds):
        if not mark[0]:
            break
        new = stored(_small_star(_large_star(e)), name)
        seen, mark = mark, _mark(new)
        forget(e)
        e = new
        if mark == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    low = e.groupBy("v").agg(F.count("*")).select(F.col("v").alias("u"), F.col("v").alias("component"))
    return e.select("u", F.col("v").alias("component")).union(low)
