"""Registered search queries (R10, R11, P7, P8): BM25 over documents and over web pages, with
every benchmark passage as a query."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import search as S
from quarry.operators import sparse as V
from quarry.sources.tables import table

TOP_N = 5


def _queries(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def bm25_top5(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    r = S.bm25(docs, _queries(spark, sf), TOP_N, digits=6)
    return r.select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def _page_hits(spark, sf):
    corpus = S.pages_corpus(table(spark, sf, "pages"))
    r = S.bm25(corpus, _queries(spark, sf), TOP_N, digits=6)
    hits = r.join(corpus.select("doc_id", "url", "title", "content"), "doc_id")
    return S.normalize_hits(hits)


def search_hits(spark, sf):
    h = _page_hits(spark, sf)
    return h.select("query_id", F.col("rank").cast("long").alias("rank"), F.col("doc_id").alias("page_id"),
                    "title", "url", "score")


def search_text(spark, sf):
    return S.search_text(_page_hits(spark, sf))


def search_records(spark, sf):
    h = _page_hits(spark, sf).withColumn("score", F.round(F.col("score") * 1000).cast("long"))
    return S.search_records(h).select("query_id", F.length("search_records").alias("n_chars"),
                                      (F.size(F.split("search_records", "\n"))).alias("n_records"))


def format_hits(spark, sf):
    return S.format_hits(_page_hits(spark, sf), _queries(spark, sf))


def tfidf_top5(spark, sf):
    """V1: TF-IDF vectors of all documents, searched with those of all benchmark passages by posting lists."""
    vectors, idf = V.tfidf(table(spark, sf, "documents"), "doc_id", "text")
    asked = V.weights(V.term_counts(table(spark, sf, "benchmark"), "item_id", "text"), idf)
    return V.search(vectors, asked, TOP_N).select("query_id", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


TERM = r"'[\p{L}\p{N}\p{M}]+'"


def _bm25_sql(corpus: str) -> str:
    return f"""q AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), {TERM}, 0))) AS term FROM benchmark),
  d AS (SELECT doc_id, regexp_extract_all(lower(text), {TERM}, 0) AS tok FROM {corpus}),
  st AS (SELECT count(*) AS N, avg(len(tok)) AS avgdl FROM d),
  h AS (SELECT doc_id, len(tok) AS dl, unnest(tok) AS term FROM d),
  tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM h WHERE term IN (SELECT term FROM q) GROUP BY doc_id, dl, term),
  dft AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  idf AS (SELECT term, ln(1 + (N - df + 0.5) / (df + 0.5)) AS idf, avgdl FROM dft, st),
  sc AS (SELECT q.query_id, tf.doc_id, round(sum(idf.idf * tf.tf * {S.K1 + 1} / (tf.tf + {S.K1} * (1 - {S.B} + {S.B} * tf.dl / idf.avgdl))), 6) AS score
         FROM tf JOIN idf ON idf.term = tf.term JOIN q ON q.term = tf.term GROUP BY q.query_id, tf.doc_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc),
  top AS (SELECT * FROM r WHERE rank <= {TOP_N})"""


def _unescape_sql(x: str) -> str:
    for entity, char in S.ENTITIES:
        x = f"replace({x}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return x


_TITLE = _unescape_sql(r"regexp_extract(html, '(?s)<title(?:\s[^>]*)?>(.*?)</title>', 1)")
_CONTENT = _unescape_sql(r"regexp_replace(regexp_extract(html, '(?s)<article(?:\s[^>]*)?>(.*)</article>', 1), '<[^>]*>', ' ', 'g')")
_PAGES = rf"""pc AS (SELECT page_id AS doc_id, url, {_TITLE} AS title, trim(regexp_replace({_CONTENT}, '\s+', ' ', 'g')) AS content
       FROM pages),
  pages_corpus AS (SELECT doc_id, url, title, content, concat_ws(' ', title, content) AS text FROM pc)"""

_HITS = f"""{_PAGES}, {_bm25_sql('pages_corpus')},
  hits AS (SELECT top.query_id, top.rank, top.doc_id, top.score,
                  coalesce(nullif(p.title, ''), 'No title') AS title, coalesce(nullif(p.content, ''), 'No content') AS content,
                  coalesce(nullif(p.url, ''), 'No URL') AS url
           FROM top JOIN pages_corpus p ON p.doc_id = top.doc_id)"""

SQL = {
    "bm25_top5": f"WITH {_bm25_sql('documents')} SELECT query_id, doc_id, score, rank FROM top",
    "search_hits": f"WITH {_HITS} SELECT query_id, rank, doc_id AS page_id, title, url, score FROM hits",
    "search_text": f"WITH {_HITS} SELECT query_id, string_agg(content, chr(10) ORDER BY rank) AS search_text FROM hits GROUP BY query_id",
    "format_hits": f"""WITH {_HITS},
  f AS (SELECT query_id, string_agg('[' || rank || '] ' || title || chr(10) || 'Source: ' || url || chr(10) || 'Content: ' || content,
                                   chr(10) || chr(10) ORDER BY rank) AS formatted FROM hits GROUP BY query_id)
SELECT b.item_id AS query_id, coalesce(f.formatted, 'No search results found.') AS formatted
FROM benchmark b LEFT JOIN f ON f.query_id = b.item_id""",
    "tfidf_top5": r"""WITH d AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}]+|[^\p{Z}\p{C}]')) AS dim FROM documents),
  dt AS (SELECT id, dim, count(*) AS tf FROM d GROUP BY ALL),
  idf AS (SELECT dim, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) AS idf FROM dt GROUP BY dim),
  b AS (SELECT item_id AS id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}]+|[^\p{Z}\p{C}]')) AS dim FROM benchmark),
  bt AS (SELECT id, dim, count(*) AS tf FROM b GROUP BY ALL),
  dr AS (SELECT id, dim, tf * idf AS w FROM dt JOIN idf USING (dim)), dn AS (SELECT id, sqrt(sum(w * w)) AS n FROM dr GROUP BY id),
  br AS (SELECT id, dim, tf * idf AS w FROM bt JOIN idf USING (dim)), bn AS (SELECT id, sqrt(sum(w * w)) AS n FROM br GROUP BY id),
  s AS (SELECT br.id AS query_id, dr.id AS doc_id, round(sum(br.w * dr.w / (bn.n * dn.n)), 9) AS score
        FROM br JOIN dr ON dr.dim = br.dim JOIN bn ON bn.id = br.id JOIN dn ON dn.id = dr.id WHERE br.w <> 0 AND dr.w <> 0 GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5""",
}

QUERIES = {
    "bm25_top5": bm25_top5,
    "search_hits": search_hits,
    "search_text": search_text,
    "format_hits": format_hits,
    "search_records": search_records,
    "tfidf_top5": tfidf_top5,
}
