"""Vector retrieval: exact top-k (V2, V3, J9), child -> parent ranking (V4, V5, J2), context
assembly (V7-V9) and the hashed TF-IDF default embedder (V1).

Physical shape of ``knn``
-------------------------
Both sides may be large, so the theta join is a grid on the executors: vectors are dealt into strips
and queries into blocks, both of bounded bytes, and a cogroup by (length, block, strip) brings each
pair of them to one task. Nothing passes through the driver and nothing is broadcast. A cell scores
chunk after chunk by a BLAS matmul; the k-th score that a query has so far is its threshold, and a chunk
whose ball (centre and radius) cannot reach it is not scored for that query. A cell emits at most
``k`` rows a query; one shuffle of those by query id and ``row_number() <= k`` give the exact answer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from quarry.sources.tables import written

# Bytes (as doubles) of a block of queries and of a strip of vectors that meet in one task.
QUERY_BLOCK_BYTES = 16 << 20
VECTOR_STRIP_BYTES = 32 << 20
# Queries of a block at least, where blocks are made only to have work for all cores.
_MIN_BLOCK = 512
# Query columns scored per matmul (bounds the score matrix to 4096 x 1024 doubles = 32 MB).
_Q_CHUNK = 1024
_V_CHUNK = 4096
# Vectors of the sample that a cell's centre is the mean of, on average.
_SAMPLE = 64
# Bytes, as they travel, of a block of queries and of a strip of vectors that meet in one task of ``ann``.
ANN_BYTES = 32 << 20

METRICS = ("cosine", "dot", "l2")


def _vectors_from_arrow(col: pa.ChunkedArray | pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(valid_mask, matrix float64) of the vectors of ``dim`` parts in an Arrow list<float> column."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    valid = ~np.asarray(col.is_null().to_numpy(zero_copy_only=False), dtype=bool)
    if n == 0 or not valid.any():
        return valid, np.zeros((0, 0))
    lens = np.asarray(col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    valid &= lens == dim
    sub = col.filter(pa.array(valid))
    flat = np.asarray(sub.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    return valid, flat.reshape(len(sub), dim)


def _prepare(m: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        norms = np.linalg.norm(m, axis=1, keepdims=True)
        norms[norms == 0] = np.nan
        return m / norms
    return m


def _score(v: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":
        d2 = (v * v).sum(1)[:, None] + (q * q).sum(1)[None, :] - 2.0 * (v @ q.T)
        return -np.sqrt(np.maximum(d2, 0.0))
    return v @ q.T


def _reduce_topk(qi: np.ndarray, vid: np.ndarray, sc: np.ndarray, k: int):
    """Keep the best k per query under the total order (score desc, vec_id asc)."""
    order = np.lexsort((vid, -sc, qi))
    qi, vid, sc = qi[order], vid[order], sc[order]
    if len(qi) == 0:
        return qi, vid, sc
    starts = np.r_[0, np.flatnonzero(np.diff(qi)) + 1]
    group_start = np.repeat(starts, np.diff(np.r_[starts, len(qi)]))
    keep = (np.arange(len(qi)) - group_start) < k
    return qi[keep], vid[keep], sc[keep]


def _by_neighbourhood(m: np.ndarray, chunks: int) -> np.ndarray:
    """An order of the rows in which those near one pivot row follow each other."""
    if chunks < 2:
        return np.arange(len(m))
    pivots = m[np.linspace(0, len(m) - 1, min(4 * chunks, 256)).astype(int)]
    near = np.concatenate([np.argmin((pivots * pivots).sum(1) - 2 * (m[i:i + _V_CHUNK] @ pivots.T), axis=1)
                           for i in range(0, len(m), _V_CHUNK)])
    return np.argsort(near, kind="stable")


def _reach(chunk: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """An upper bound of every query's score with any row of the chunk, by the chunk's centre and radius."""
    centre = chunk.mean(axis=0)
    radius = np.sqrt(((chunk - centre) ** 2).sum(axis=1).max())
    if metric == "l2":
        return radius - np.linalg.norm(q - centre, axis=1)
    return q @ centre + radius * np.linalg.norm(q, axis=1)


def cell_topk(qids: np.ndarray, q: np.ndarray, vids: np.ndarray, v: np.ndarray, k: int, metric: str = "cosine",
              digits: int | None = None, exclude_self: bool = False):
    """The k best rows of ``v`` for each row of ``q``: (query row, vec_id, score), ties to the smaller id."""
    q, v = _prepare(q, metric), _prepare(v, metric)
    some = np.isfinite(v).all(axis=1)
    vids, v = vids[some], v[some]
    order = _by_neighbourhood(v, -(-len(v) // _V_CHUNK))
    vids, v = vids[order], v[order]
    slack = 1e-9 + (10.0 ** -digits if digits is not None else 0.0)     # of rounding
    out = []
    for c0 in range(0, len(q), _Q_CHUNK):
        rows = np.arange(c0, min(c0 + _Q_CHUNK, len(q)))
        rows = rows[np.isfinite(q[rows]).all(axis=1)]
        least = np.full(len(q), -np.inf)
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for r0 in range(0, len(v), _V_CHUNK):
            chunk, ids = v[r0:r0 + _V_CHUNK], vids[r0:r0 + _V_CHUNK]
            reach = _reach(chunk, q[rows], metric)
            live = rows[reach + slack * (1 + np.abs(reach)) >= least[rows]] if r0 else rows
            if not len(live):
                continue
            row, at, sc = reaching(_score(q[live], chunk, metric), least[live], k, ids, qids[live] if exclude_self else None, slack)
            if digits is not None:
                sc = np.round(sc, digits)
            best, least = merged(best, live[row], ids[at], sc, k, least)
        out.append(best)
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def reaching(s: np.ndarray, least: np.ndarray, k: int, ids: np.ndarray, own: np.ndarray | None, slack: float = 0.0):
    """(row, column, score) of the scores (queries x vectors) that may be among the k best: those that reach the k-th score so far
    or, where there is none, the k-th of these; without the queries' ``own`` ids. Only these are looked at one by one."""
    cut = least - slack * (1 + np.abs(np.where(np.isfinite(least), least, 0)))
    fresh = np.flatnonzero(~np.isfinite(least))
    most = k if own is None or not len(ids) else k + int(np.unique(ids, return_counts=True)[1].max())
    if len(fresh) and most < len(ids):
        part = s if len(fresh) == len(s) else s[fresh]
        cut[fresh] = np.partition(part, len(ids) - most, axis=1)[:, len(ids) - most]
        cut[fresh] -= slack * (1 + np.abs(cut[fresh]))
    row, at = np.divmod(np.flatnonzero(s >= cut[:, None].astype(s.dtype)), max(len(ids), 1))
    sc = s[row, at]
    some = np.isfinite(sc) if own is None else np.isfinite(sc) & (ids[at] != own[row])
    return row[some], at[some], sc[some]


def merged(best: tuple, row: np.ndarray, ids: np.ndarray, sc: np.ndarray, k: int, least: np.ndarray) -> tuple[tuple, np.ndarray]:
    """The k best of each query with more of its scores, and the k-th scores where there are k."""
    if not len(row):
        return best, least
    best = _reduce_topk(np.concatenate([best[0], row]), np.concatenate([best[1], ids]), np.concatenate([best[2], sc]), k)
    last = np.flatnonzero(np.r_[best[0][1:] != best[0][:-1], True])
    full = last[np.diff(np.r_[-1, last]) == k]
    least[best[0][full]] = best[2][full]
    return best, least


def _matrix(tbl: pa.Table, ids: str, vecs: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a group, all of one length."""
    col = tbl.column(vecs).combine_chunks()
    flat = np.asarray(col.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    return np.asarray(tbl.column(ids).to_numpy(), dtype=np.int64), flat.reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def unsearchable(vectors: DataFrame, dims: list[int], vec_id: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Vectors that no query of the given lengths can meet, with the reason: null, of another length,
    or zero (which has no cosine)."""
    v = F.col(vec_col)
    reason = (F.when(v.isNull(), "null").when(~F.size(v).isin(*dims), "length")
              .when(F.forall(v, lambda x: x == 0), "zero"))
    return vectors.select(vec_id, reason.alias("reason")).filter("reason is not null")


GRID = ["dim", "block", "strip"]


def usable(df: DataFrame, key: str, col: str, name: str, vec: str) -> DataFrame:
    """(name, vec, dim): rows with an id and a vector without nulls."""
    df = df.select(F.col(key).cast("long").alias(name), F.col(col).cast("array<double>").alias(vec))
    return df.where(F.col(name).isNotNull() & (F.size(vec) > 0) & ~F.exists(vec, lambda x: x.isNull())).withColumn("dim", F.size(vec))


def deal(q: DataFrame, v: DataFrame, block_bytes: int, strip_bytes: int, width: float = 8) -> tuple[DataFrame, DataFrame] | None:
    """Both sides (with dim) dealt onto the grid's cells (dim, block, strip): a query goes to every strip of its
    length and a vector, of ``width`` bytes a part, to every block; None where no lengths meet."""
    count = lambda df: {r.dim: r.n for r in df.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # noqa: E731 - a row a length
    nq, nv = count(q), count(v)
    both = sorted(nq.keys() & nv.keys())
    if not both:
        return None
    cores = v.sparkSession.sparkContext.defaultParallelism
    strips = {d: 1 + int(nv[d] * d * width // strip_bytes) for d in both}
    blocks = {d: max(1 + nq[d] * d * 8 // block_bytes, min(nq[d] // _MIN_BLOCK, -(-cores // strips[d]))) for d in both}
    of = lambda m: F.element_at(F.create_map(*[F.lit(int(x)) for d in both for x in (d, m[d])]), F.col("dim"))
    every = lambda m: F.explode(F.sequence(F.lit(0), (of(m) - 1).cast("int")))
    dealt = lambda col, m: F.pmod(F.xxhash64(col), of(m)).cast("int")
    return (q.where(F.col("dim").isin(both)).withColumn("block", dealt("qid", blocks)).withColumn("strip", every(strips)),
            v.where(F.col("dim").isin(both)).withColumn("strip", dealt("vid", strips)).withColumn("block", every(blocks)))


def knn(vectors: DataFrame, queries: DataFrame, k: int, *, vec_id: str = "vec_id",
        vec_col: str = "embedding", query_id: str = "query_id", query_col: str = "embedding",
        metric: str = "cosine", exclude_self: bool = False, digits: int | None = None,
        block_bytes: int = QUERY_BLOCK_BYTES, strip_bytes: int = VECTOR_STRIP_BYTES) -> DataFrame:
    """Exact top-k vectors per query -> (query_id, vec_id, score, rank).

    Ranking is by full double precision, ties by ``vec_id``; ``digits``, where given, rounds scores
    before ranking (so that two engines agree). ``metric`` is cosine, dot or l2 (score = -distance).
    Queries search the vectors of their own length; ``unsearchable`` lists what no query can meet.
    ``exclude_self`` drops the pair whose ids are equal (a table searched against itself). Rows of a null
    id, and vectors that hold null or non-finite parts, are in no result. Blocks of queries and strips of
    vectors hold about ``block_bytes`` and ``strip_bytes``, whatever the number of either.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")

    grid = deal(usable(queries, query_id, query_col, "qid", "qvec"), usable(vectors, vec_id, vec_col, "vid", "vvec"), block_bytes, strip_bytes)
    if grid is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    q, v = grid

    def cell(key: tuple, qs: pa.Table, vs: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not (qs.num_rows and vs.num_rows):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        (qids, qm), (vids, vm) = _matrix(qs, "qid", "qvec"), _matrix(vs, "vid", "vvec")
        row, vid, score = cell_topk(qids, qm, vids, vm, k, metric, digits, exclude_self)
        return pa.table([pa.array(qids[row]), pa.array(vid), pa.array(score)], names=names)
    cand = q.groupBy(*GRID).cogroup(v.groupBy(*GRID)).applyInArrow(cell, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    return (cand.withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= k))


def closeness(distance: Column) -> Column:
    """V3: a distance as a similarity in (0, 1], ``exp(-d^2)``."""
    return F.exp(-distance * distance)


def ann(vectors: DataFrame, queries: DataFrame, k: int, *, cells: int = 64, probes: int = 8, vec_id: str = "vec_id",
        vec_col: str = "embedding", query_id: str = "query_id", query_col: str = "embedding", exclude_self: bool = False,
        split: int | None = None, block_bytes: int = ANN_BYTES, strip_bytes: int = ANN_BYTES) -> DataFrame:
    """V6: approximate top-k by cosine -> (query_id, vec_id, score, rank).

    ``cells`` centres (means of a bounded sample, the vectors of the lowest hash) cut the table into cells by the
    nearest centre; every vector is indexed. A query is compared exactly with all vectors of its
    ``probes`` nearest cells; with ``probes = cells`` the result is exact. Vectors are dealt into strips and queries into
    blocks of about ``strip_bytes`` (or ``split`` vectors) and ``block_bytes``, whatever their cells, and each pair of them meets in one task: a query is
    sent once a strip with the numbers of its cells, not once a cell. Neither side is broadcast or collected.
    Queries search the vectors of their own length, which have centres of their own.
    """
    kind = lambda df, col: "float" if df.schema[col].dataType.elementType == FloatType() else "double"  # noqa: E731 - floats travel as they are
    vk, qk = kind(vectors, vec_col), kind(queries, query_col)
    v = vectors.select(F.col(vec_id).cast("long").alias("vid"), F.col(vec_col).cast(f"array<{vk}>").alias("vec")).where("vec is not null")
    q = queries.select(F.col(query_id).cast("long").alias("qid"), F.col(query_col).cast(f"array<{qk}>").alias("qvec")).where("qvec is not null")
    out = vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    for dim in sorted(r.dim for r in q.select(F.size("qvec").alias("dim")).distinct().collect() if r.dim):
        out = out.union(_ann_of_length(v.where(F.size("vec") == dim), q.where(F.size("qvec") == dim), dim, k, cells, probes, exclude_self,
                                       split, block_bytes, strip_bytes))
    return out


def _centres(m: np.ndarray, cells: int, rounds: int = 12) -> np.ndarray:
    """Directions of means of the rows, from the first rows on (spherical k-means)."""
    c = m[:cells]
    for _ in range(rounds):
        near = np.argmax(m @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, m)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 1e-12, total / np.maximum(size, 1e-12), c)
    return c


def _ann_of_length(v: DataFrame, q: DataFrame, dim: int, k: int, cells: int, probes: int, exclude_self: bool,
                   split: int | None, block_bytes: int, strip_bytes: int) -> DataFrame:
    """:func:`ann` for vectors (vid, vec) and queries (qid, qvec) of one length."""
    sample = [r.vec for r in v.orderBy(F.xxhash64("vid"), "vid").select("vec").limit(cells * _SAMPLE).collect()]
    if not sample:
        return v.sparkSession.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    c = _centres(np.nan_to_num(_prepare(np.array(sample, dtype=np.float64), "cosine")), cells)

    def assign(n):
        def run(batches):
            for b in batches:
                valid, m = _vectors_from_arrow(b.column(1), dim)
                if len(m):
                    cell = np.argsort(-(np.nan_to_num(_prepare(m, "cosine")) @ c.T), axis=1, kind="stable")[:, :n].astype(np.int32)
                    part = b.filter(pa.array(valid))
                    ends = pa.array(np.arange(len(cell) + 1, dtype=np.int32) * cell.shape[1])
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(ends, pa.array(cell.reshape(-1)))], [*part.schema.names, "cells"])
        return run

    def assigned(df, n, names):
        return df.mapInArrow(assign(n), f"{names[0]} long, {names[1]} {df.schema[names[1]].dataType.simpleString()}, cells array<int>")
    nv, nq = v.count(), q.count()
    wide = lambda df, col: dim * (4 if df.schema[col].dataType.elementType == FloatType() else 8)
    strips = 1 + (nv // split if split else nv * wide(v, "vec") // strip_bytes)
    blocks = max(1 + nq * wide(q, "qvec") // block_bytes, min(nq // _MIN_BLOCK, -(-v.sparkSession.sparkContext.defaultParallelism // strips)))
    dealt = lambda col, n: F.pmod(F.xxhash64(col), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(int(n) - 1)))
    vc = assigned(v, 1, ("vid", "vec")).withColumn("strip", dealt("vid", strips)).withColumn("block", every(blocks))
    qc = assigned(q, probes, ("qid", "qvec")).withColumn("block", dealt("qid", blocks)).withColumn("strip", every(strips))

    def search(key: tuple, qs: pa.Table, vs: pa.Table) -> pa.Table:
        row, vid, score = _search_cells(qs, vs, dim, k, len(c), exclude_self)
        return pa.table([qs.column("qid").combine_chunks().take(pa.array(row)), vid, pa.array(score)], names=["query_id", "vec_id", "score"])
    got = qc.groupBy("block", "strip").cogroup(vc.groupBy("block", "strip")).applyInArrow(search, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    return got.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _search_cells(qs: pa.Table, vs: pa.Table, dim: int, k: int, cells: int, exclude_self: bool) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(query row, vec_id, score): of each query (qid, qvec, cells) the k best vectors (vid, vec, cells) of its cells, ties to the smaller id, null last."""
    flat = lambda t, col: np.asarray(t.column(col).combine_chunks().flatten().to_numpy(zero_copy_only=False))
    unit = lambda t, col: _prepare(flat(t, col).astype(np.float64).reshape(len(t), dim), "cosine")
    if not (len(qs) and len(vs)):
        return np.zeros(0, np.int64), pa.array([], pa.int64()), np.zeros(0)
    ids = lambda t, col: (np.asarray(t.column(col).combine_chunks().fill_null(0).to_numpy()), np.asarray(t.column(col).combine_chunks().is_valid()))
    (vid, known), (qid, named) = ids(vs, "vid"), ids(qs, "qid")
    names = np.unique(vid[known])                                              # ids by their place, a null id comes after all
    place = np.where(known, np.searchsorted(names, vid), len(names))
    own = np.searchsorted(names, qid)
    own = np.where(named & np.isin(qid, names), own, -1)
    v, cell = unit(vs, "vec"), flat(vs, "cells")
    some = np.flatnonzero(np.isfinite(v).all(axis=1))
    some = some[np.argsort(cell[some], kind="stable")]
    v, place, cell = v[some], place[some], cell[some]
    starts = np.searchsorted(cell, np.arange(cells + 1))
    asks = flat(qs, "cells").reshape(len(qs), -1)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for c0 in range(0, len(qs), _Q_CHUNK):
        q = unit(qs.slice(c0, _Q_CHUNK), "qvec")
        fine = np.isfinite(q).all(axis=1)
        least, best = np.full(len(q), -np.inf), out[0]
        for at in np.flatnonzero(np.diff(starts)):
            live = np.flatnonzero(fine & (asks[c0:c0 + _Q_CHUNK] == at).any(axis=1))
            for r0 in range(starts[at], starts[at + 1], _V_CHUNK) if len(live) else ():
                chunk = slice(r0, min(r0 + _V_CHUNK, starts[at + 1]))
                row, col, sc = reaching(q[live] @ v[chunk].T, least[live], k, place[chunk], own[c0:c0 + _Q_CHUNK][live] if exclude_self else None)
                best, least = merged(best, live[row], place[chunk][col], sc, k, least)
        out.append((best[0] + c0, best[1], best[2]))
    row, at, score = (np.concatenate([o[i] for o in out]) for i in range(3))
    return row, pa.array(names, pa.int64()).take(pa.array(at, pa.int64(), mask=at == len(names))), score


def top_parents(hits: DataFrame, child_parent: DataFrame, k: int, *, child_id: str = "vec_id",
                parent_id: str = "parent_id") -> DataFrame:
    """Walk each query's ranked children, keep the first hit per parent with that
    child's score, stop at k parents -> (query_id, parent_id, score, first_rank, rank).

    An ordinary join on the child id: queries x child over-fetch rows grow with the queries, so the
    side to broadcast, if any, is Catalyst's choice.
    """
    m = child_parent.select(F.col(child_id).alias("vec_id"), F.col(parent_id).alias("parent_id"))
    j = m.join(hits.select("query_id", "vec_id", "score", "rank"), "vec_id")
    first = (j.groupBy("query_id", "parent_id")
             .agg(F.min(F.struct("rank", "score")).alias("f"))
             .select("query_id", "parent_id", F.col("f.score").alias("score"),
                     F.col("f.rank").alias("first_rank")))
    w = Window.partitionBy("query_id").orderBy("first_rank")
    return first.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def search_parents(vectors: DataFrame, queries: DataFrame, child_parent: DataFrame, k: int, fetch: int, *, first: int | None = None,
                   child_id: str = "vec_id", parent_id: str = "parent_id", query_id: str = "query_id", **options) -> DataFrame:
    """V4 over the ``fetch`` nearest children of every query, as :func:`top_parents` of :func:`knn`, with the same rows.

    The walk stops at the k-th parent, which for most queries comes early: the ``first`` (8 k) children are ranked for all
    queries, all ``fetch`` only for those that have more children and met fewer than k parents. ``options`` go to ``knn``.
    """
    few = min(fetch, first or 8 * k)
    near = knn(vectors, queries, few, query_id=query_id, **options)
    if few == fetch:
        return top_parents(near, child_parent, k, child_id=child_id, parent_id=parent_id)
    near = written(near, "near-children")
    done = written(top_parents(near, child_parent, k, child_id=child_id, parent_id=parent_id), "near-parents")
    short = near.where(F.col("rank") == few).select("query_id").distinct().join(done.where(F.col("rank") == k).select("query_id"), "query_id", "left_anti")
    short = written(short, "short-queries")
    again = queries.join(short.withColumnRenamed("query_id", query_id), query_id, "left_semi")
    rest = top_parents(knn(vectors, again, fetch, query_id=query_id, **options), child_parent, k, child_id=child_id, parent_id=parent_id)
    return done.join(short, "query_id", "left_anti").unionByName(rest)


def parent_recall(parents: DataFrame, n_groups: Column | int, k: int) -> DataFrame:
    """V5: per query, number of parents returned versus min(k, number of groups)."""
    expected = F.least(F.lit(k), n_groups if isinstance(n_groups, Column) else F.lit(n_groups))
    return (parents.groupBy("query_id").agg(F.count("*").alias("n_parents"))
            .withColumn("expected", expected.cast("long"))
            .withColumn("recall_ok", (F.col("n_parents") == F.col("expected")).cast("int")))


def concat_context(parts: DataFrame, key: str = "query_id", order: str = "rank", text: str = "text",
                   sep: str = "\n\n", out: str = "context") -> DataFrame:
    """Texts of each key joined by ``sep`` in ``order``."""
    return parts.groupBy(key).agg(ordered_join(order, text, sep).alias(out))


def ordered_join(order: str, text: str, sep: str) -> Column:
    """Ordered string aggregation independent of shuffle order (sorts (order, text) pairs)."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"),
                                                                          F.col(text).alias("t")))),
                                    lambda x: x["t"]), sep)


def merge_context(relevant: Column, search: Column) -> Column:
    """V9: relevant text and search text as one summary document, newline separated."""
    return F.concat(relevant, F.lit("\n"), search)


def hashed_tfidf(df: DataFrame, text_col: str, out_col: str = "embedding", num_features: int = 1 << 12):
    """V1 default embedder: hashed term frequencies -> IDF -> L2-normalised dense array<float>.

    Uses the MLlib feature transformers (JVM). A user embedder plugs in as a pandas UDF
    returning array<float> instead.
    """
    from pyspark.ml.feature import IDF, HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    from quarry.functions.text import tokenize

    toks = df.withColumn("_tok", tokenize(F.col(text_col), uncased=True))
    tf = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features).transform(toks)
    idf = IDF(inputCol="_tf", outputCol="_idf").fit(tf).transform(tf)
    normed = Normalizer(inputCol="_idf", outputCol="_n", p=2.0).transform(idf)
    return (normed.withColumn(out_col, vector_to_array("_n", "float32"))
            .drop("_tok", "_tf", "_idf", "_n"))
