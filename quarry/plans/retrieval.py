"""Registered retrieval / routing queries over the fixture tables.

Fixture mapping: every ``embeddings`` row is both a stored vector and a query (searched against
the whole table, self excluded); parent proxy ``vec_id div 5``; the relevance judge's answer
for a hit is ``labels.quality`` of ``doc_id = vec_id`` (1 -> yes, else / missing -> no); hit
text is ``documents.text`` of ``doc_id = vec_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators import compressed, routing, vectors
from quarry.sources.tables import table

# ---- fixture parameters (measured on the test tables; operator defaults keep reference values)
THRESHOLD = 0.36
TOP_K = 8
CHILD_FETCH = 500
PARENT_DIV = 5
# ---------------------------------------------------------------------------------------------


def hits(spark: SparkSession, sf: str, k: int = TOP_K) -> DataFrame:
    emb = table(spark, sf, "embeddings")
    q = emb.select(F.col("vec_id").alias("query_id"), "embedding")
    return vectors.knn(emb, q, k, exclude_self=True, digits=6)   # as the oracle's scores


def asked(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"))


def knn_top8(spark, sf):
    return hits(spark, sf).select("query_id", "vec_id", "score", F.col("rank").cast("long").alias("rank"))


def ann_top8(spark, sf):
    """V6: the nearest cells' vectors only; three quarters of the cells, as these vectors have no clusters."""
    emb = table(spark, sf, "embeddings")
    got = vectors.ann(emb, emb.select(F.col("vec_id").alias("query_id"), "embedding"), TOP_K, cells=16, probes=12, exclude_self=True)
    return got.select("query_id", "vec_id", "score", F.col("rank").cast("long").alias("rank"))


def compressed_top8(spark, sf):
    """V6: all vectors as product-quantised codes, a short list by distance tables, ranked by full vectors."""
    emb = table(spark, sf, "embeddings")
    got = compressed.search(emb, emb.select(F.col("vec_id").alias("query_id"), "embedding"), TOP_K, exclude_self=True)
    return got.select("query_id", "vec_id", "score", F.col("rank").cast("long").alias("rank"))


def parent_topk(spark, sf):
    emb = table(spark, sf, "embeddings")
    cp = emb.select("vec_id", F.expr(f"vec_id div {PARENT_DIV}").alias("parent_id"))
    q = emb.select(F.col("vec_id").alias("query_id"), "embedding")
    p = vectors.search_parents(emb, q, cp, TOP_K, CHILD_FETCH, exclude_self=True, digits=6)
    return p.select("query_id", "parent_id", "score", F.col("first_rank").cast("long").alias("first_rank"),
                    F.col("rank").cast("long").alias("rank"))


def parent_recall(spark, sf):
    emb = table(spark, sf, "embeddings")
    n_groups = emb.select(F.expr(f"vec_id div {PARENT_DIV}").alias("p")).distinct().count()
    return vectors.parent_recall(parent_topk(spark, sf), n_groups, TOP_K)


def labelled(spark, sf, threshold=THRESHOLD):
    h = hits(spark, sf)
    ans = routing.quality_answers(table(spark, sf, "labels"))
    return routing.judge_relevance(h, ans, threshold)


def relevance_labels(spark, sf):
    return labelled(spark, sf).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"),
                                      "score", F.coalesce("label", F.lit("no")).alias("label"))


def _per_query(spark, sf, threshold=THRESHOLD):
    return routing.relevancy(labelled(spark, sf, threshold), queries=asked(spark, sf))


def status_ratios(spark, sf):
    r = _per_query(spark, sf).withColumn("status", routing.status(F.col("relevancy_score")))
    total = F.sum("n_queries").over(Window.partitionBy())      # over the three statuses
    return (r.groupBy("status").agg(F.count("*").alias("n_queries"))
            .withColumn("share", F.round(F.col("n_queries") / total, 6)))


def route_search(spark, sf):
    r = _per_query(spark, sf)
    return r.select("query_id", F.round("relevancy_score", 6).alias("relevancy_score"),
                    routing.status(F.col("relevancy_score")).alias("status"),
                    routing.route_search(F.col("relevancy_score")).alias("search"))


def judge_all_routes(spark, sf):
    h = hits(spark, sf)
    ans = routing.quality_answers(table(spark, sf, "labels"))
    r = routing.relevancy(routing.judge_relevance(h, ans, None), queries=asked(spark, sf))
    return r.select("query_id", F.col("n_yes").cast("long").alias("n_yes"),
                    F.col("any_no").cast("int").alias("search"))


def relevant_text(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    return routing.relevant_text(labelled(spark, sf), docs, queries=asked(spark, sf))


def flagship(spark, sf):
    """entry(): top-8 search -> relevance (threshold + judge) -> score -> status counts."""
    return status_ratios(spark, sf)


_PAIRS = """
  s AS (SELECT q.vec_id AS query_id, v.vec_id AS vec_id,
               round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score
        FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id),
  h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)"""

_LABELLED = _PAIRS + f""",
  t AS (SELECT * FROM h WHERE rank <= {TOP_K}),
  l AS (SELECT t.*, CASE WHEN t.score >= {THRESHOLD} THEN 'yes'
                         WHEN lb.quality = 1 THEN 'yes' ELSE 'no' END AS label
        FROM t LEFT JOIN labels lb ON lb.doc_id = t.vec_id),
  r AS (SELECT query_id, count(*) AS n_hits, sum(CASE WHEN label = 'yes' THEN 1 ELSE 0 END) AS n_yes,
               sum(CASE WHEN label = 'yes' THEN 1 ELSE 0 END) / count(*) AS rs FROM l GROUP BY query_id)"""

_STATUS = "CASE WHEN rs IS NULL THEN 'incorrect' WHEN rs > 0.5 THEN 'correct' WHEN rs = 0 THEN 'incorrect' ELSE 'ambiguous' END"

SQL = {
    "knn_top8": f"WITH {_PAIRS} SELECT query_id, vec_id, score, rank FROM h WHERE rank <= {TOP_K}",
    "parent_topk": f"""WITH {_PAIRS},
  c AS (SELECT * FROM h WHERE rank <= {CHILD_FETCH}),
  p AS (SELECT query_id, vec_id // {PARENT_DIV} AS parent_id, min(rank) AS first_rank, arg_min(score, rank) AS score
        FROM c GROUP BY query_id, vec_id // {PARENT_DIV}),
  pr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first_rank) AS rank FROM p)
SELECT query_id, parent_id, score, first_rank, rank FROM pr WHERE rank <= {TOP_K}""",
    "parent_recall": f"""WITH {_PAIRS},
  c AS (SELECT * FROM h WHERE rank <= {CHILD_FETCH}),
  p AS (SELECT query_id, vec_id // {PARENT_DIV} AS parent_id, min(rank) AS first_rank FROM c GROUP BY ALL),
  pr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first_rank) AS rank FROM p),
  g AS (SELECT count(DISTINCT vec_id // {PARENT_DIV}) AS n FROM embeddings)
SELECT query_id, count(*) AS n_parents, least({TOP_K}, max(g.n)) AS expected,
       CAST(count(*) = least({TOP_K}, max(g.n)) AS INTEGER) AS recall_ok
FROM pr, g WHERE rank <= {TOP_K} GROUP BY query_id""",
    "relevance_labels": f"WITH {_LABELLED} SELECT query_id, vec_id, rank, score, coalesce(label, 'no') AS label FROM l",
    "status_ratios": f"""WITH {_LABELLED}, st AS (SELECT {_STATUS} AS status FROM r)
SELECT status, count(*) AS n_queries, round(count(*) / (SELECT count(*) FROM st), 6) AS share FROM st GROUP BY status""",
    "route_search": f"""WITH {_LABELLED}
SELECT query_id, round(rs, 6) AS relevancy_score, {_STATUS} AS status,
       CAST(coalesce(rs < 0.5, true) AS INTEGER) AS search FROM r""",
    "judge_all_routes": f"""WITH {_PAIRS},
  t AS (SELECT * FROM h WHERE rank <= {TOP_K}),
  l AS (SELECT t.*, CASE WHEN lb.quality = 1 THEN 'yes' ELSE 'no' END AS label
        FROM t LEFT JOIN labels lb ON lb.doc_id = t.vec_id)
SELECT query_id, CAST(sum(CASE WHEN label = 'yes' THEN 1 ELSE 0 END) AS BIGINT) AS n_yes,
       max(CASE WHEN label = 'no' THEN 1 ELSE 0 END) AS search FROM l GROUP BY query_id""",
    "relevant_text": f"""WITH {_LABELLED},
  y AS (SELECT l.query_id, string_agg(d.text, chr(10) ORDER BY l.rank) AS relevant_text
        FROM l JOIN documents d ON d.doc_id = l.vec_id WHERE l.label = 'yes' GROUP BY l.query_id)
SELECT q.query_id, coalesce(y.relevant_text, '') AS relevant_text
FROM (SELECT DISTINCT query_id FROM l) q LEFT JOIN y ON y.query_id = q.query_id""",
}

QUERIES = {
    "ann_top8": ann_top8,
    "compressed_top8": compressed_top8,
    "knn_top8": knn_top8,
    "parent_topk": parent_topk,
    "parent_recall": parent_recall,
    "relevance_labels": relevance_labels,
    "status_ratios": status_ratios,
    "route_search": route_search,
    "judge_all_routes": judge_all_routes,
    "relevant_text": relevant_text,
}
