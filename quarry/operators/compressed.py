"""Approximate search over compressed vectors (V6): product-quantisation codes, distance tables, exact rerank.

A unit vector is cut into sections of ``SECTION`` parts, and each section is stored as the number of its nearest
word in that section's code book (at most 256 words, one byte). Every vector is encoded; only the code
books are learned from a bounded sample. A query has a product with every word of every section, so
its approximate cosine with a vector is a sum of one entry a section (taken in blocks, as one matrix product with the words). Codes meet queries on the grid of
``vectors.knn``; the best ``shortlist`` of each query are then ranked by their full vectors, which are
joined by id: only ids and codes travel before that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import vectors as V

#: Parts of a vector that one byte stands for, and words of a code book.
SECTION = 4
WORDS = 256
#: Vectors of the sample that the code books of a length are learned from.
SAMPLE = 16384
_ROUNDS = 12
_CHUNK = 4096


def _sections(m: np.ndarray) -> np.ndarray:
    """Rows x sections x parts of unit rows, the last section filled up with zeros; rows without direction are zero."""
    m = np.nan_to_num(V._prepare(m, "cosine"), posinf=0.0, neginf=0.0)
    m = np.pad(m, ((0, 0), (0, -m.shape[1] % SECTION)))
    return m.reshape(len(m), m.shape[1] // SECTION, SECTION)


def _nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.argmin((words * words).sum(1) - 2 * (x @ words.T), axis=1)


def code_books(sample: np.ndarray) -> np.ndarray:
    """Sections x words x parts: k-means of every section, from words spread over the sample."""
    cut = _sections(sample)
    start = np.linspace(0, len(cut) - 1, min(WORDS, len(cut))).astype(int)
    books = []
    for s in range(cut.shape[1]):
        x = np.ascontiguousarray(cut[:, s])
        words = x[start].copy()
        for _ in range(_ROUNDS):
            near = _nearest(x, words)
            size = np.bincount(near, minlength=len(words))
            total = np.stack([np.bincount(near, x[:, p], len(words)) for p in range(SECTION)], axis=1)
            words[size > 0] = total[size > 0] / size[size > 0, None]
        books.append(words)
    return np.stack(books)


def encode(m: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Rows x sections bytes."""
    cut = _sections(m)
    return np.stack([_nearest(cut[:, s], books[s]) for s in range(cut.shape[1])], axis=1).astype(np.uint8)


def approximate(q: np.ndarray, codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Approximate cosines, queries x codes: the queries' products with the words that the codes stand for."""
    words = books.astype(np.float32)[np.arange(codes.shape[1]), codes].reshape(len(codes), codes.shape[1] * SECTION)
    return _sections(q).reshape(len(q), codes.shape[1] * SECTION).astype(np.float32) @ words.T


def _learn(v: DataFrame) -> dict[int, np.ndarray]:
    """Code books of every length, of at most ``SAMPLE`` vectors each (those of the lowest hashes)."""
    books = {}
    for dim in sorted(r.dim for r in v.select("dim").distinct().collect()):
        rows = v.where(F.col("dim") == dim).orderBy(F.xxhash64("vid"), "vid").select("vvec").limit(SAMPLE).toArrow()
        books[dim] = code_books(np.asarray(rows.column(0).combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(-1, dim))
    return books


def search(vectors: DataFrame, queries: DataFrame, k: int, *, shortlist: int | None = None, vec_id: str = "vec_id",
           vec_col: str = "embedding", query_id: str = "query_id", query_col: str = "embedding", exclude_self: bool = False,
           block_bytes: int = V.QUERY_BLOCK_BYTES, strip_bytes: int = V.VECTOR_STRIP_BYTES) -> DataFrame:
    """Approximate top-k by cosine -> (query_id, vec_id, score, rank); scores are exact.

    A query is compared exactly with its ``shortlist`` (12 k) best vectors by code, all others by code only. Ids
    are taken as distinct. Queries search the vectors of their own length; rows of a null id and vectors that are
    null, zero or hold null or non-finite parts are in no result.
    """
    few = shortlist or 12 * k
    good = lambda df, vec: df.where(F.forall(vec, lambda x: F.abs(x) < float("inf")) & F.exists(vec, lambda x: x != 0))  # noqa: E731 - NaN is no less
    v = good(V.usable(vectors, vec_id, vec_col, "vid", "vvec"), "vvec")
    q = good(V.usable(queries, query_id, query_col, "qid", "qvec"), "qvec")
    books = _learn(v)

    def codes(batches):
        for b in batches:
            dims = b.column(2).to_numpy()
            for dim in np.unique(dims):
                some = b.filter(pa.array(dims == dim))
                m = np.asarray(some.column(1).flatten().to_numpy(zero_copy_only=False)).reshape(-1, dim)
                code = encode(m, books[int(dim)])
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([c.tobytes() for c in code], pa.binary()), some.column(2)], ["vid", "code", "dim"])
    grid = V.deal(q, v.mapInArrow(codes, "vid long, code binary, dim int"), block_bytes, strip_bytes, 1 / SECTION)
    if grid is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score double, rank int")

    def cell(key: tuple, qs: pa.Table, vs: pa.Table) -> pa.Table:
        ids, rows, near = [], [], []
        if qs.num_rows and vs.num_rows:
            book = books[key[0].as_py()]
            qids, qm = V._matrix(qs, "qid", "qvec")
            vids = vs.column("vid").to_numpy()
            code = np.frombuffer(b"".join(vs.column("code").to_pylist()), np.uint8).reshape(len(vids), -1)
            for c0 in range(0, len(qids), V._Q_CHUNK):
                best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
                some = qids[c0:c0 + V._Q_CHUNK]
                least = np.full(len(some), -np.inf, np.float32)
                for r0 in range(0, len(vids), _CHUNK):
                    mine = vids[r0:r0 + _CHUNK]
                    s = approximate(qm[c0:c0 + V._Q_CHUNK], code[r0:r0 + _CHUNK], book)
                    row, at, sc = V.reaching(s, least, few, mine, some if exclude_self else None)
                    best, least = V.merged(best, row, mine[at], sc, few, least)
                ids.append(some[best[0]])
                rows.append(best[1])
                near.append(best[2])
        join = lambda x, t: pa.array(np.concatenate(x) if x else [], t)
        return pa.table([join(ids, pa.int64()), join(rows, pa.int64()), join(near, pa.float32())], names=["qid", "vid", "near"])
    cand = grid[0].groupBy(*V.GRID).cogroup(grid[1].groupBy(*V.GRID)).applyInArrow(cell, "qid long, vid long, near float")
    best = Window.partitionBy("qid").orderBy(F.desc("near"), "vid")
    listed = cand.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= few).select("qid", "vid")

    def exact(batches):
        for b in batches:
            a, c = (np.asarray(b.column(i).flatten().to_numpy(zero_copy_only=False)) for i in (2, 3))
            cut = b.column(2).value_lengths().to_numpy()
            begin = np.cumsum(cut) - cut
            if len(begin):
                dot = np.add.reduceat(a * c, begin) / np.sqrt(np.add.reduceat(a * a, begin) * np.add.reduceat(c * c, begin))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(dot)], ["query_id", "vec_id", "score"])
    pairs = listed.join(v.select("vid", "vvec"), "vid").join(q.select("qid", "qvec"), "qid").select("qid", "vid", "qvec", "vvec")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (pairs.mapInArrow(exact, "query_id long, vec_id long, score double").withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k))
