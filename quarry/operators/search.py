"""Fallback search re-aimed as a table job (R10, R11, P7, P8): BM25 over a term table, HTML
title/content extraction, hit normalisation and formatting.

Plan shape of ``bm25``: the corpus is tokenised and exploded and each token row meets the
distinct query terms (Catalyst broadcasts them where they are small), so only tokens that occur in
some query go on, and a partial count turns them into (doc, term, tf) before any exchange. Two passes: the first
counts document frequencies, of query terms only; N and the mean length come from one global
aggregate. For the second, texts are dealt by document once, so a document's terms, its part of every query's
score and the first cut of the ranking are made in one task: rows for (query, term, document) or
(query, document), many times the corpus where queries share words, are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.vectors import ordered_join
from quarry.sources.tables import written

# ---- fixed values ----------------------------------------------------------------------------
K1, B = 1.2, 0.75          # BM25 parameters (common defaults)
TERM_PATTERN = r"[\p{L}\p{N}\p{M}]+"
NO_TITLE, NO_CONTENT, NO_URL = "No title", "No content", "No URL"
NO_RESULTS = "No search results found."
# ---------------------------------------------------------------------------------------------


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM_PATTERN), 0)


def html_title(html: Column) -> Column:
    return unescape(F.regexp_extract(html, r"(?s)<title(?:\s[^>]*)?>(.*?)</title>", 1))


def html_content(html: Column) -> Column:
    """Text of the <article> element: tags replaced by a space, the basic entities decoded, white
    space collapsed."""
    art = F.regexp_extract(html, r"(?s)<article(?:\s[^>]*)?>(.*)</article>", 1)
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(art, r"<[^>]*>", " ")), r"\s+", " "))


# ---- fixed values: the basic entities; the ampersand comes last ---------------------------------
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")]
# ------------------------------------------------------------------------------------------------


def unescape(text: Column) -> Column:
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def pages_corpus(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> (doc_id, url, title, content, text)."""
    return (pages.select(F.col("page_id").alias("doc_id"), "url", html_title(F.col("html")).alias("title"),
                         html_content(F.col("html")).alias("content"))
            .withColumn("text", F.concat_ws(" ", "title", "content")))


def bm25(corpus: DataFrame, queries: DataFrame, n: int = 5, *, doc_key: str = "doc_id", text: str = "text",
         query_key: str = "query_id", query_text: str = "query", k1: float = K1, b: float = B,
         digits: int | None = None) -> DataFrame:
    """Top ``n`` documents per query by BM25 -> (query_id, doc_id, score, rank).

    Documents are ranked by full double sums, added up in the order of the terms, ties by key; with ``digits`` the
    scores are rounded first, so that what differs beyond is a tie.
    """
    qt = (queries.select(F.col(query_key).alias("query_id"), F.explode(F.array_distinct(terms(F.col(query_text))))
                         .alias("term")))
    qt = written(qt, "bm25-queries")                                            # its size is known to the planner then
    qterms = qt.select("term").distinct()
    docs = corpus.select(F.col(doc_key).alias("doc_id"), F.col(text).alias("_text"))
    stats = docs.agg(F.count("*").alias("N"), F.avg(F.size(terms(F.col("_text")))).alias("avgdl"))

    def frequencies(some: DataFrame) -> DataFrame:
        toks = some.select("doc_id", terms(F.col("_text")).alias("_tok"))
        hit = toks.select("doc_id", F.size("_tok").alias("dl"), F.explode("_tok").alias("term")).join(qterms, "term")
        return hit.groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    df_t = frequencies(docs).groupBy("term").agg(F.count("*").alias("df"))
    idf = (df_t.crossJoin(F.broadcast(stats))  # one-row stats
           .select("term", "N", "avgdl",
                   F.log(1 + (F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")))
    weights = written(qt.join(idf, "term").select("query_id", "term", "avgdl", "idf"), "bm25-weights")     # the queries' terms
    scored = (frequencies(docs.repartition("doc_id")).join(weights, "term")
              .withColumn("c", F.col("idf") * F.col("tf") * (k1 + 1) /
                          (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))))
    parts = F.array_sort(F.collect_list(F.struct("term", "c")))                # a query's terms at most
    score = F.aggregate(parts, F.lit(0.0), lambda total, x: total + x["c"]) if digits is None else F.round(F.sum("c"), digits)
    agg = scored.groupBy("query_id", "doc_id").agg(score.alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id").asc())
    return agg.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def normalize_hits(hits: DataFrame) -> DataFrame:
    """Defaults for missing title / content / url; score parsed as double, bad -> null."""
    score = F.col("score").cast("string")
    return hits.withColumns({
        "title": F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit(NO_TITLE)),
        "content": F.coalesce(F.nullif(F.col("content"), F.lit("")), F.lit(NO_CONTENT)),
        "url": F.coalesce(F.nullif(F.col("url"), F.lit("")), F.lit(NO_URL)),
        "score": F.expr("try_cast(score AS DOUBLE)") if score is not None else F.col("score"),
    })


def search_text(hits: DataFrame, key: str = "query_id") -> DataFrame:
    """Hit contents joined by newline in rank order."""
    return hits.groupBy(key).agg(ordered_join("rank", "content", "\n").alias("search_text"))


def search_records(hits: DataFrame, key: str = "query_id") -> DataFrame:
    """R11, chat variant: whole hit records as JSON (title, content, url, score), one a line, in rank
    order."""
    record = F.to_json(F.struct("title", "content", "url", "score"))
    return hits.withColumn("_rec", record).groupBy(key).agg(ordered_join("rank", "_rec", "\n").alias("search_records"))


def format_hits(hits: DataFrame, queries: DataFrame, key: str = "query_id") -> DataFrame:
    """P8: '[i] title\\nSource: url\\nContent: content' blocks joined by a blank line; a query
    without hits -> 'No search results found.'"""
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("title"), F.lit("\nSource: "),
                     F.col("url"), F.lit("\nContent: "), F.col("content"))
    per = hits.withColumn("_b", block).groupBy(key).agg(ordered_join("rank", "_b", "\n\n").alias("formatted"))
    return (queries.select(key).join(per, key, "left")
            .withColumn("formatted", F.coalesce("formatted", F.lit(NO_RESULTS))))
