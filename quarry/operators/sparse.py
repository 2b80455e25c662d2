"""Text to vectors (V1, F1): sparse TF-IDF rows and their search by posting lists, or vectors of the caller's embedder.

A sparse vector is a set of rows (id, dim, w), never a dense array. The search is an exact top k by cosine that
does not read all posting lists of a query: its dimensions are taken from the rarest on, and what the others can still
add is at most the norm of the query's remaining part (the vectors are of length 1).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import tokenize
from quarry.sources.tables import written

#: Texts that an embedder gets at once.
BATCH = 64
#: Of rounding, in bounds of scores.
_SLACK = 1e-9


def embed(df: DataFrame, text: str, embedder: Callable[[], Callable[[list[str]], np.ndarray]], out: str = "embedding", batch: int = BATCH) -> DataFrame:
    """V1/F1: the table with a column ``out`` of array<float>: ``embedder()`` is called once a task (it loads
    the model) and gives a function from a list of texts to a row each. A null text has a null vector."""
    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = embedder()
        for part in parts:
            vectors = pd.Series([None] * len(part), dtype=object)
            known = np.flatnonzero(part.notna().to_numpy())
            for s in range(0, len(known), batch):
                some = known[s:s + batch]
                for i, v in zip(some, np.asarray(model([part.iloc[i] for i in some]), dtype=np.float32)):
                    vectors.iloc[i] = v
            yield vectors
    return df.withColumn(out, run(F.col(text)))


def term_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, dim, tf): the distinct lower-case tokens of every text."""
    return (docs.select(F.col(key).alias("id"), F.explode(tokenize(F.col(text), True)).alias("dim"))
            .groupBy("id", "dim").agg(F.count("*").alias("tf")))


def weights(counts: DataFrame, idf: DataFrame) -> DataFrame:
    """(id, dim, w) of length 1 from (id, dim, tf) and (dim, idf); dimensions without idf, or of idf 0, count for nothing."""
    raw = counts.join(idf, "dim").select("id", "dim", (F.col("tf") * F.col("idf")).alias("raw")).where("raw <> 0")
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("id")))     # the terms of one text
    return raw.select("id", "dim", (F.col("raw") / norm).alias("w"))


def tfidf(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Sparse unit vectors (id, dim, w) of all texts, and (dim, idf) = ln((n + 1) / (df + 1)) to weigh other texts by.

    Ids are taken as distinct. Texts without tokens have no row.
    """
    counts = written(term_counts(docs, key, text), "tfidf-counts")
    n = docs.count()
    idf = written(counts.groupBy("dim").agg(F.log(F.lit(n + 1) / (F.count("*") + 1)).alias("idf")), "tfidf-idf")
    return weights(counts, idf), idf


def _sums(q: DataFrame, v: DataFrame) -> DataFrame:
    return q.join(v, "dim").groupBy("query_id", "id").agg(F.sum(F.col("qw") * F.col("w")).alias("part"))


def search(vectors: DataFrame, queries: DataFrame, k: int, *, first: float = 0.7, digits: int = 9) -> DataFrame:
    """(query_id, id, score, rank): exact top k by cosine of unit vectors (id, dim, w) with non-negative parts.

    Ranked by scores rounded to ``digits``, ties to the smaller id; ids without a common dimension are not
    returned. A query's dimensions go from the rarest on. The posting lists of those before which its remaining norm is
    above ``first`` are read, and the k-th sum is a lower bound of its k-th score. Next, only lists before
    which the remaining norm still reaches that bound are read: an id that is in none of them cannot enter. Ids whose
    sum and the remaining norm reach the bound are completed by their own vectors. No list is cut.
    """
    v = written(vectors.select("id", "dim", "w"), "sparse-vectors")
    length = v.groupBy("dim").agg(F.count("*").alias("n"))
    q = queries.select(F.col("id").alias("query_id"), "dim", F.col("w").alias("qw")).join(length, "dim")
    ahead = Window.partitionBy("query_id").orderBy("n", "dim").rowsBetween(0, Window.unboundedFollowing)
    q = written(q.withColumn("rest", F.sqrt(F.sum(F.col("qw") * F.col("qw")).over(ahead))).drop("n"), "sparse-queries")
    head = written(_sums(q.where(F.col("rest") > first), v), "sparse-head")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("part"), "id"))
    least = head.withColumn("nth", nth).where(F.col("nth") == k).select("query_id", (F.col("part") - _SLACK).alias("least"))
    q = written(q.join(least, "query_id", "left").fillna(0.0, ["least"]), "sparse-bounds")
    near = q.where((F.col("rest") <= first) & (F.col("rest") >= F.col("least")))
    far = q.where((F.col("rest") <= first) & (F.col("rest") < F.col("least")))
    open_ = far.groupBy("query_id").agg(F.max("rest").alias("open"))
    bound = q.select("query_id", "least").distinct().join(open_, "query_id", "left").fillna(0.0, ["open"])
    part = head.union(_sums(near, v)).groupBy("query_id", "id").agg(F.sum("part").alias("part"))
    some = written(part.join(bound, "query_id").where(F.col("part") + F.col("open") >= F.col("least")).select("query_id", "id", "part"), "sparse-candidates")
    late = (some.select("query_id", "id").join(v, "id").join(far.select("query_id", "dim", "qw"), ["query_id", "dim"])
            .select("query_id", "id", (F.col("qw") * F.col("w")).alias("part")))
    total = some.union(late).groupBy("query_id", "id").agg(F.round(F.sum("part"), digits).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return total.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
