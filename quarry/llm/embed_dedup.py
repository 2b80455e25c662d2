"""Embedding near-duplicates: an exact metric range join by cosine.

Vectors are put on the unit sphere, where cosine >= c means a distance of at most eps = sqrt(2 - 2c).
Pivots partition them: a vector is at home with its nearest pivot. If x at home with p and y at home
with q are within eps, the triangle inequality puts y within eps of the plane halfway between p and q,
so y is replicated to every cell whose plane is that near; x then meets all its links in its own cell.
Cells join independently. A cell is dealt into units of about ``UNIT`` home and ``UNIT`` other
vectors, so a crowded cell (a third of all vectors alike) is many tasks. A unit multiplies blocks, counts
links and passes on a forest of its links, never the pairs. Equal vectors are one row with a count.

Pivots: the vectors of the lowest hash, one for each ``UNIT`` vectors, ``MAX_PIVOTS`` at most; their
number only sets how finely the work is cut, not what is compared.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .components import components, join_labels

UNIT = 4096
MAX_PIVOTS = 512
#: Distinct lengths of vectors, each with pivots of its own.
MAX_DIMS = 64
_STRIP = 512


def _unit(rows) -> np.ndarray:
    x = np.array([np.asarray(r, dtype=np.float64) for r in rows], dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)          # so that squares neither vanish nor overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _assign(pivots: dict[int, np.ndarray], eps: float):
    def run(batches):
        for batch in batches:
            dim = batch.column("dim").to_numpy()
            for d in np.unique(dim):
                at = np.flatnonzero(dim == d)
                part = batch.take(pa.array(at))
                p = pivots[int(d)]
                gap = np.linalg.norm(p[:, None] - p[None], axis=2)
                dots = _unit(part.column("v").to_pylist()) @ p.T
                home = dots.argmax(axis=1)
                i = np.arange(len(at))
                # distance to the plane halfway: (x.home - x.other) / |home - other|
                near = dots[i, home][:, None] - dots <= eps * gap[home] + 1e-9
                row, cell = np.nonzero(near)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(row), d, np.int32)), pa.array(cell.astype(np.int32)), pa.array(home[row] == cell),
                     part.column("node").take(pa.array(row)), part.column("copies").take(pa.array(row)), part.column("v").take(pa.array(row))],
                    ["dim", "cell", "home", "node", "copies", "v"])
    return run


def _join(threshold: float):
    def run(key: tuple, home: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"node": [], "n": [], "root": []}).astype("int64")
        if home.empty or other.empty:
            return none
        x, y = _unit(home["v_a"]), _unit(other["v_b"])
        xs, ys = x.astype(np.float32), y.astype(np.float32)
        a, b, copies = home["node_a"].to_numpy(), other["node_b"].to_numpy(), other["copies_b"].to_numpy()
        nodes = np.unique(np.concatenate([a, b]))
        ia, ib = np.searchsorted(nodes, a), np.searchsorted(nodes, b)
        labels, n = np.arange(len(nodes)), np.zeros(len(a), np.int64)
        for s in range(0, len(a), _STRIP):
            rough = xs[s:s + _STRIP] @ ys.T >= np.float32(threshold - 1e-4)
            rows, cols = np.flatnonzero(rough.any(axis=1)), np.flatnonzero(rough.any(axis=0))
            if not len(rows):
                continue
            link = x[s + rows] @ y[cols].T >= threshold
            link &= ia[s + rows][:, None] != ib[cols][None]
            n[s + rows] += link @ copies[cols]
            r, c = np.nonzero(link)
            labels = join_labels(labels, ia[s + rows][r], ib[cols][c])
        root = nodes[labels]
        far = np.setdiff1d(np.flatnonzero(root != nodes), ia)
        return pd.DataFrame({"node": np.concatenate([a, nodes[far]]), "n": np.concatenate([n, np.zeros(len(far), np.int64)]),
                             "root": np.concatenate([root[ia], root[far]])})
    return run


def deduplicate(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Per row: vec_id, n_links (other rows linked directly), component_id (smallest id reachable), kept.

    Rows link where their vectors have the same length and a cosine of ``threshold`` or more in double
    precision; equal vectors do. Vectors that are null, empty, zero or hold null or non-finite parts link
    with nothing. Rows of one id are one node; their links add up. A null id links with nothing, has a
    null component and is kept. Other columns are ignored.
    """
    eps = float(np.sqrt(2 - 2 * threshold))
    v = F.col("v")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    good = (F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)
            & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False))).withColumn("dim", F.size("v")).withColumn(
        "h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v"))
    classes = rows.where("good").groupBy("dim", "h1", "h2").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    classes = stored(classes, "embed-classes")
    key = ["dim", "h1", "h2"]
    heads = rows.where("good").join(classes, key).where("vec_id = node").dropDuplicates(key).select("dim", "node", "copies", "v")
    heads = stored(heads, "embed-nodes")

    first = Window.partitionBy("dim").orderBy(F.xxhash64(F.lit(2), "node"), "node")
    wanted = F.least(F.ceil(F.col("size") / UNIT), F.lit(MAX_PIVOTS))
    sizes = heads.groupBy("dim").agg(F.count("*").alias("size"))
    picked = (heads.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= MAX_PIVOTS).join(sizes, "dim")
              .where(F.col("rank") <= wanted).select("dim", "v").limit(MAX_DIMS * MAX_PIVOTS + 1).collect())
    if len({r.dim for r in picked}) > MAX_DIMS:
        raise ValueError(f"vectors of more than {MAX_DIMS} lengths")
    pivots = {d: _unit([r.v for r in picked if r.dim == d]) for d in {r.dim for r in picked}}

    kind = heads.schema["v"].dataType.simpleString()
    dealt = stored(heads.select("dim", "node", "copies", "v").mapInArrow(
        _assign(pivots, eps), f"dim int, cell int, home boolean, node long, copies long, v {kind}"), "embed-cells")
    cells = dealt.groupBy("dim", "cell").agg(F.ceil(F.count_if("home") / UNIT).cast("int").alias("units_i"),
                                             F.ceil(F.count("*") / UNIT).cast("int").alias("units_j"))
    dealt = dealt.join(F.broadcast(cells), ["dim", "cell"])      # MAX_DIMS * MAX_PIVOTS rows at most
    mine = F.xxhash64(F.lit(3), "node")
    home = dealt.where("home").withColumn("i", F.pmod(mine, F.col("units_i"))).withColumn("j", F.explode(F.expr("sequence(0, units_j - 1)")))
    other = dealt.where("units_i > 0").withColumn("j", F.pmod(mine, F.col("units_j"))).withColumn("i", F.explode(F.expr("sequence(0, units_i - 1)")))

    def unit(df, mark):
        return (df.select(*[F.col(c).cast("long").alias(c + mark) for c in ("dim", "cell", "i", "j")], *[F.col(c).alias(c + mark) for c in ("node", "copies", "v")])
                .groupBy(*[c + mark for c in ("dim", "cell", "i", "j")]))
    found = stored(unit(home, "_a").cogroup(unit(other, "_b"))
                   .applyInPandas(_join(threshold), "node long, n long, root long"), "embed-links")
    comp = components(found.where("root <> node").select(F.col("node").alias("u"), F.col("root").alias("v")), "embed-components")
    links = found.groupBy("node").agg(F.sum("n").alias("n")).join(comp.withColumnRenamed("u", "node"), "node", "left")

    named = rows.join(classes, key, "left").withColumn("node", F.when(F.col("good"), F.col("node"))).join(links, "node", "left")
    component = F.when(F.col("good"), F.coalesce("component", "node")).otherwise(F.col("vec_id"))
    return named.select("vec_id", F.when(F.col("good"), F.coalesce("n", F.lit(0)) + F.col("copies") - 1).otherwise(F.lit(0)).cast("long").alias("n_links"),
                        component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
e AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95),
r AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
c AS (SELECT x AS vec_id, min(y) AS component_id FROM r GROUP BY x),
n AS (SELECT x AS vec_id, count(*) AS n FROM e GROUP BY x)
SELECT c.vec_id, coalesce(n, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n ON n.vec_id = c.vec_id
"""
