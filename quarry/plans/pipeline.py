"""The evaluation pipeline end to end (R15): retrieval, judge, score, relevant text, route, search text,
context, answers, matches, status.

Fixture: one item for each ``benchmark`` row whose document doc_id = 7 * item_id exists. The query is the
first sentence of that document, its vector the embedding of that id (withheld where item_id mod 10 = 9, so
that these items find nothing and are errors); gold answers are the passage and, where item_id mod 3 = 0,
that first sentence. Judge: ``labels.quality`` of the hit.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import answering as A
from quarry.operators import routing as R
from quarry.operators import search as S
from quarry.operators import vectors as V
from quarry.plans.retrieval import THRESHOLD, TOP_K
from quarry.plans.search import TERM
from quarry.sources.tables import table, written

PAGE_HITS = 10


def items(spark, sf):
    first = F.try_element_at(A.sentences(F.col("text")), F.lit(1))             # null where a text has no sentence
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), first.alias("query")).where("query is not null")
    b = table(spark, sf, "benchmark").select("item_id", (F.col("item_id") * 7).alias("vec_id"), F.col("text").alias("passage"))
    gold = F.when(F.col("item_id") % 3 == 0, F.array("passage", "query")).otherwise(F.array("passage"))
    return b.join(docs, "vec_id").select(F.col("item_id").alias("query_id"), "vec_id", "query", gold.alias("answer"))


def evaluate(spark, sf):
    """One row an item: status, answers and matches."""
    q = written(items(spark, sf), "rag-items")                                 # read by many branches; the documents are cut once
    emb = table(spark, sf, "embeddings")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    asked = q.where("query_id % 10 <> 9").select("query_id", "vec_id").join(emb.select("vec_id", "embedding"), "vec_id")
    hits = written(V.knn(emb, asked.select("query_id", "embedding"), TOP_K, digits=6), "rag-hits")    # read by three branches
    labelled = R.judge_relevance(hits, R.quality_answers(table(spark, sf, "labels")), THRESHOLD)
    score = R.relevancy(labelled, queries=q.select("query_id"))
    relevant = R.relevant_text(labelled, docs, queries=q.select("query_id"))
    per = q.join(score, "query_id").join(relevant, "query_id").withColumn("search", R.route_search(F.col("relevancy_score")))
    corpus = S.pages_corpus(table(spark, sf, "pages"))
    wanted = per.where("search = 1 and n_hits > 0").select("query_id", "query")
    found = S.bm25(corpus, wanted, PAGE_HITS, digits=6).join(corpus.select("doc_id", "content"), "doc_id")
    per = per.join(S.search_text(found), "query_id", "left").withColumn("search_text", F.coalesce("search_text", F.lit("")))
    per = per.withColumn("context", A.rank_parts(F.col("query"), F.col("relevant_text"), F.col("search_text")))
    per = per.join(A.best_sentence(per, "query_id", "query", "context"), "query_id")
    return per.withColumn("short_answer", A.short_answer(F.col("long_answer")))


def rag_eval(spark, sf):
    return scored(evaluate(spark, sf))


def scored(e, *more):
    """The result rows of :func:`evaluate`, with ``more`` of its columns."""
    e = T.with_nfd(e, {"_nfd_long": "long_answer", "_nfd_gold": "answer"})
    ok = F.col("n_hits") > 0
    return e.select(
        F.col("query_id").alias("id"), F.when(ok, R.status(F.col("relevancy_score"))).otherwise("error").alias("status"),
        F.when(ok, F.lower(T.strip(F.col("long_answer")))).alias("long_answer"), F.when(ok, F.lower(T.strip(F.col("short_answer")))).alias("short_answer"),
        F.when(ok, T.single_ans_em(F.col("short_answer"), F.col("answer"))).alias("is_exact_match"),
        F.when(ok, T.has_correct_answer(F.col("_nfd_long"), F.col("_nfd_gold"))).alias("is_substring_match"),
        F.md5(R.attributed_context(F.col("relevant_text"), F.col("search_text"))).alias("context_md5"), *more)


def _sql():
    from quarry.plans.evaluation import TOK, _norm_sql, _strip, _tokstr
    from quarry.plans.search import _PAGES
    tok = lambda x: f"list_distinct(list_transform(regexp_extract_all({x}, {TOK}, 0), lambda t: lower(t)))"
    sent = lambda x: f"list_filter(list_transform(regexp_extract_all({x}, '[^.!?\\n]+[.!?]*'), lambda s: {_strip('s')}), lambda s: s <> '')"
    return f"""WITH {_PAGES},
  it AS (SELECT b.item_id AS query_id, d.doc_id AS vec_id, {sent('d.text')}[1] AS query, b.text AS passage FROM benchmark b JOIN documents d ON d.doc_id = b.item_id * 7
         WHERE len({sent('d.text')}) > 0),
  p AS (SELECT it.query_id, v.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score
        FROM it JOIN embeddings e ON e.vec_id = it.vec_id AND it.query_id % 10 <> 9, embeddings v),
  h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= {TOP_K}),
  l AS (SELECT h.*, CASE WHEN h.score >= {THRESHOLD} OR lb.quality = 1 THEN 1 ELSE 0 END AS yes FROM h LEFT JOIN labels lb ON lb.doc_id = h.vec_id),
  r AS (SELECT query_id, sum(yes) / count(*) AS rs FROM l GROUP BY query_id),
  rel AS (SELECT l.query_id, string_agg(d.text, chr(10) ORDER BY l.rank) AS relevant FROM l JOIN documents d ON d.doc_id = l.vec_id WHERE yes = 1 GROUP BY 1),
  q AS (SELECT it.query_id, unnest(list_distinct(regexp_extract_all(lower(query), {TERM}, 0))) AS term FROM it JOIN r ON r.query_id = it.query_id AND rs < 0.5),
  d AS (SELECT doc_id, regexp_extract_all(lower(text), {TERM}, 0) AS tok FROM pages_corpus),
  st AS (SELECT count(*) AS N, avg(len(tok)) AS avgdl FROM d),
  tf AS (SELECT doc_id, len(tok) AS dl, term, count(*) AS tf FROM (SELECT doc_id, tok, unnest(tok) AS term FROM d) GROUP BY ALL),
  df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  sc AS (SELECT q.query_id, tf.doc_id, round(sum(ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * {S.K1 + 1} / (tf + {S.K1} * (1 - {S.B} + {S.B} * dl / avgdl))), 6) AS score
         FROM q JOIN tf USING (term) JOIN df USING (term), st GROUP BY 1, 2),
  top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= {PAGE_HITS}),
  se AS (SELECT query_id, string_agg(content, chr(10) ORDER BY rank) AS search FROM top JOIN pages_corpus USING (doc_id) GROUP BY 1),
  c AS (SELECT it.*, rs, coalesce(relevant, '') AS relevant, coalesce(search, '') AS search, {tok('query')} AS qt
        FROM it LEFT JOIN r USING (query_id) LEFT JOIN rel USING (query_id) LEFT JOIN se USING (query_id)),
  x AS (SELECT *, CASE WHEN len(list_intersect(qt, {tok('search')})) > len(list_intersect(qt, {tok('relevant')})) THEN search || chr(10) || relevant
                       ELSE relevant || chr(10) || search END AS context FROM c),
  s AS (SELECT query_id, qt, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM (SELECT query_id, qt, {sent('context')} AS ss FROM x)),
  b AS (SELECT query_id, arg_max(s, len(list_intersect(qt, {tok('s')})) * 1000000000 - i) AS best FROM s GROUP BY query_id),
  a AS (SELECT x.*, coalesce(best, '') AS la, regexp_replace(coalesce(best, ''), '[.!?]+$', '') AS sa FROM x LEFT JOIN b USING (query_id))
SELECT query_id AS id, CASE WHEN rs IS NULL THEN 'error' WHEN rs > 0.5 THEN 'correct' WHEN rs = 0 THEN 'incorrect' ELSE 'ambiguous' END AS status,
  CASE WHEN rs IS NOT NULL THEN lower({_strip('la')}) END AS long_answer, CASE WHEN rs IS NOT NULL THEN lower({_strip('sa')}) END AS short_answer,
  CASE WHEN rs IS NOT NULL THEN CAST({_norm_sql('sa')} = {_norm_sql('passage')} OR (query_id % 3 = 0 AND {_norm_sql('sa')} = {_norm_sql('query')}) AS INTEGER) END AS is_exact_match,
  CASE WHEN rs IS NOT NULL THEN CAST(contains({_tokstr('la')}, {_tokstr('passage')}) OR (query_id % 3 = 0 AND contains({_tokstr('la')}, {_tokstr('query')})) AS INTEGER) END AS is_substring_match,
  md5('[Document]: ' || relevant || chr(10) || chr(10) || '[Web Search]: ' || search) AS context_md5 FROM a"""


SQL = {"rag_eval": _sql()}
QUERIES = {"rag_eval": rag_eval}
