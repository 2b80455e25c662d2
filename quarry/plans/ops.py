"""Registered queries for streams, index collections, sources and prompt tables
(X1-X3, S1, S2, S6, S7, S9-S13, P1, P2, P4, P10, R9, R12, V8, V9, V11, J5-J7)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import prompts as PR
from quarry.operators import documents as D
from quarry.operators import search as S
from quarry.operators import sessions as K
from quarry.operators import vectors as V
from quarry.operators import routing as R
from quarry.session import scratch_path
from quarry.sources import commit_log as CL
from quarry.sources import index_store as IX
from quarry.sources.tables import attach_by_position, table, take_first, written
from quarry.streaming import jobs as X
from quarry.streaming import stateful as ST

# ---- fixture parameters ------------------------------------------------------------------------
RATE_LIMIT, RATE_WINDOW = 5, "1 day"           # reference: 10 per minute
EXEMPT = ("error",)                            # event types that are not counted as requests
MAX_UPLOAD_BYTES = 10 * 1024 * 1024            # reference value: 10 MiB
PDF = "application/pdf"
FIRST_N = 100
FMT = "yyyy-MM-dd HH:mm:ss"
# -----------------------------------------------------------------------------------------------


def _path(sf, name):
    return f"{sf.rstrip('/')}/{name}.parquet"


def rate_limit(spark, sf):
    r = X.rate_limit_batch(table(spark, sf, "events"), RATE_LIMIT, RATE_WINDOW)
    return r.select("user_id", F.date_format("window_start", FMT).alias("window_start"), "n_requests",
                    F.col("n_limited").cast("long").alias("n_limited"))


def rate_limit_stream(spark, sf):
    ev = table(spark, sf, "events")
    r = X.rate_limit_stream(spark, _path(sf, "events"), ev.schema, RATE_LIMIT, RATE_WINDOW)
    return r.select("user_id", F.date_format("window_start", FMT).alias("window_start"), "n_requests",
                    F.col("n_limited").cast("long").alias("n_limited"))


def request_decisions(spark, sf):
    """A decision for every request, by the stream."""
    ev = table(spark, sf, "events")
    r = ST.request_decisions(spark, _path(sf, "events"), ev.schema, RATE_LIMIT, RATE_WINDOW, exempt=EXEMPT)
    return r.select("event_id", "user_id", F.date_format("window_start", FMT).alias("window_start"), "allowed")


def request_decisions_batch(spark, sf):
    r = ST.request_decisions_batch(table(spark, sf, "events"), RATE_LIMIT, RATE_WINDOW, exempt=EXEMPT)
    return r.select("event_id", "user_id", F.date_format("window_start", FMT).alias("window_start"), "allowed")


def memory_stream(spark, sf):
    c = table(spark, sf, "conversations")
    return ST.memory_stream(spark, _path(sf, "conversations"), c.schema, 200).select("conv_id", "turn", "n_tokens")


def session_counts_stream(spark, sf):
    c = table(spark, sf, "conversations")
    return X.session_counts_stream(spark, _path(sf, "conversations"), c.schema)


INDEX = "vec_id long, parent_id long, embedding array<float>, collection string"


def _index(spark, sf):
    """Index all embeddings by a stream, twice: the second run, of a checkpoint of its own, finds every key in the index."""
    emb = table(spark, sf, "embeddings")
    root = scratch_path(spark, f"index-{__import__('uuid').uuid4().hex[:8]}")
    tf = lambda d: d.select(F.col("vec_id").cast("long"), F.expr("vec_id div 5").alias("parent_id"), F.col("embedding").cast("array<float>"),
                            F.concat(F.lit("label"), F.col("label").cast("string")).alias("collection"))
    for run in "ab":
        X.incremental_index(spark, _path(sf, "embeddings"), emb.schema, f"{root}/index", f"{root}/ckpt-{run}", transform=tf)
    return f"{root}/index"


def index_append(spark, sf):
    rows = CL.read_committed(spark, _index(spark, sf), T.StructType.fromDDL(INDEX))
    return rows.select("vec_id", "parent_id", F.lit(IX.DEFAULT_COLLECTION).alias("collection"))


def index_commits(spark, sf):
    """What the commit log says of each collection: rows and key range over its files."""
    log = CL.manifest(spark, _index(spark, sf))
    return log.groupBy("collection").agg(F.sum("n_rows").alias("n_rows"), F.min("low").alias("low"), F.max("high").alias("high"))


def index_roundtrip(spark, sf):
    emb = table(spark, sf, "embeddings")
    root = scratch_path(spark, f"collections-{__import__('uuid').uuid4().hex[:8]}")
    IX.save_index(emb.select("vec_id", "embedding", F.concat(F.lit("label"), F.col("label").cast("string"))
                             .alias("collection")), root)
    names = emb.select(F.concat(F.lit("label"), F.col("label").cast("string")).alias("collection")).distinct()
    reg = IX.drop(IX.register(None, names), spark.createDataFrame([("label0",)], "collection string"))
    loaded = spark.read.parquet(root).groupBy("collection").agg(F.count("*").alias("n_vectors"))
    return (loaded.join(reg.withColumn("registered", F.lit(1)), "collection", "left")
            .select("collection", "n_vectors", F.coalesce("registered", F.lit(0)).alias("registered")))


def collection_fallback(spark, sf):
    docs = table(spark, sf, "documents")
    reg = docs.select(F.col("source").alias("collection")).distinct()
    req = table(spark, sf, "conversations").select("conv_id").distinct().withColumn(
        "requested", F.concat(F.lit("src"), (F.col("conv_id") % 25).cast("string")))
    res = IX.resolve_collection(req, reg)
    sizes = docs.groupBy(F.col("source").alias("collection")).agg(F.count("*").alias("n_docs"))
    total = docs.agg(F.count("*").alias("n_all"))
    return (res.join(sizes, "collection", "left").crossJoin(total)  # one-row total
            .select("conv_id", "requested", "collection",
                    F.when(F.col("collection") == IX.DEFAULT_COLLECTION, F.col("n_all"))
                    .otherwise(F.col("n_docs")).alias("n_docs")))


def to_documents(spark, sf):
    d = table(spark, sf, "documents")
    meta = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"),
                        F.lit("n_chars"), F.col("n_chars").cast("string"))
    entries = F.array_sort(F.map_entries(meta))
    return d.select("doc_id", F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])),
                                           ";").alias("metadata"))


def document_maps(spark, sf):
    """Documents with a metadata map of scalar, list, missing and null-valued fields, shown sorted."""
    d = table(spark, sf, "documents").withColumn("tags", F.array("source", "lang", F.lit(None)))
    got = D.to_documents(d, "text", ["lang", "n_chars", "tags", "text", "title"], keep=["doc_id"])
    shown = F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return got.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), F.array_join(shown, ";").alias("metadata"))


def longform(spark, sf):
    """All documents as questions, with the documents from the longest to the shortest as contexts, titles along."""
    d = table(spark, sf, "documents")
    contexts = d.select((-F.col("n_chars")).alias("size"), F.col("doc_id").alias("id"), F.col("text").alias("context"), F.array("source", "lang").alias("context_titles"))
    got = D.reshape_longform(d.select("doc_id", F.col("text").alias("question")), ["doc_id"], contexts, ["size", "id"])
    return got.select("query_id", F.md5("query").alias("query_md5"), F.md5("context").alias("context_md5"), F.array_join("context_titles", ",").alias("titles"))


def positional_join(spark, sf):
    b = table(spark, sf, "benchmark")
    n = b.count()
    ctx = take_first(table(spark, sf, "documents").select("doc_id"), n, "doc_id")
    return (attach_by_position(b, "item_id", ctx, "doc_id").select(F.concat(F.lit("eli5_"), F.col("pos").cast("string")).alias("query_id"),
                                      F.col("text").alias("query"), F.col("doc_id").alias("context_doc_id")))


def first_n(spark, sf):
    return take_first(table(spark, sf, "documents").select("doc_id", "n_chars"), FIRST_N, "doc_id")


def upload_checks(spark, sf):
    p = table(spark, sf, "pages")
    up = p.select("page_id", "url", F.when(F.col("page_id") % 3 != 0, F.lit(PDF)).otherwise(F.lit("text/html"))
                  .alias("file_type"), (F.length("html") * 5000).cast("long").alias("size"),
                  F.concat(F.lit("user"), (F.col("page_id") % 10).cast("string"), F.lit("@example.com")).alias("owner"))
    reason = (F.when(F.col("file_type") != PDF, F.lit("only PDF files are allowed"))
              .when(F.col("size") > MAX_UPLOAD_BYTES, F.lit("file too large")))
    meta = F.concat_ws(";", F.concat(F.lit("file_name="), F.col("url")), F.concat(F.lit("file_type="), F.col("file_type")),
                       F.concat(F.lit("size="), F.col("size").cast("string")), F.concat(F.lit("user_email="), F.col("owner")))
    return up.select("page_id", reason.isNull().cast("int").alias("accepted"), reason.alias("reject_reason"),
                     meta.alias("metadata"))


def last_answer_per_query(spark, sf):
    pairs = K.pair_turns(table(spark, sf, "conversations"))
    seq = F.col("conv_id") * 100000 + F.col("turn")
    return pairs.groupBy("question").agg(F.max_by("answer", seq).alias("answer")).select(
        F.md5("question").alias("query_md5"), F.md5("answer").alias("answer_md5"))


def _bm25_docs(spark, sf):
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    return q, docs, S.bm25(docs.select("doc_id", "text"), q, 5, digits=6)


def context_blocks(spark, sf):
    q, docs, hits = _bm25_docs(spark, sf)
    hits = written(hits, "block-hits")                  # a few rows a query: texts need no shuffle to meet them
    rel = V.concat_context(hits.join(docs.select("doc_id", "text"), "doc_id"), out="relevant")
    corpus = S.pages_corpus(table(spark, sf, "pages"))
    ph = written(S.bm25(corpus, q, 5, digits=6), "block-pages").join(corpus.select("doc_id", "content"), "doc_id")
    st = S.search_text(ph)
    j = rel.join(st, "query_id", "full").fillna("", ["relevant", "search_text"])
    return j.select("query_id", F.md5(R.attributed_context(F.col("relevant"), F.col("search_text"))).alias("attributed_md5"),
                    F.md5(V.merge_context(F.col("relevant"), F.col("search_text"))).alias("merged_md5"),
                    F.length("relevant").alias("relevant_chars"))


def prompts_relevance(spark, sf):
    q, docs, hits = _bm25_docs(spark, sf)
    j = hits.join(docs, "doc_id").join(q, "query_id")
    prompt = PR.render(PR.RELEVANCY_TEMPLATE, context_str=F.col("text"),
                       metadata=PR.py_dict_repr(lang=F.col("lang"), source=F.col("source")), query_str=F.col("query"))
    rewrite = PR.render(PR.TRANSFORM_QUERY_TEMPLATE, query_str=F.col("query"))
    return j.select("query_id", "doc_id", F.md5(prompt).alias("prompt_md5"), F.length(prompt).alias("prompt_chars"),
                    F.md5(rewrite).alias("rewrite_md5"))


# ---- oracle SQL --------------------------------------------------------------------------------
_F = "'%Y-%m-%d %H:%M:%S'"


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _render_sql(template: str, **vals: str) -> str:
    parts, pos = [], 0
    for m in PR._FIELD.finditer(template):
        parts.append(_sql_str(template[pos:m.start()]))
        parts.append(f"CAST({vals[m.group(1)]} AS VARCHAR)")
        pos = m.end()
    parts.append(_sql_str(template[pos:]))
    return "(" + " || ".join(parts) + ")"


from quarry.plans.search import _bm25_sql, _HITS  # noqa: E402

_DECISIONS = f"""SELECT event_id, user_id, strftime(date_trunc('day', ts), {_F}) AS window_start,
       event_type IN ('error') OR row_number() OVER (PARTITION BY user_id, date_trunc('day', ts), event_type IN ('error') ORDER BY ts, event_id) <= {RATE_LIMIT} AS allowed
FROM events"""

SQL = {
    "rate_limit": f"""SELECT user_id, strftime(date_trunc('day', ts), {_F}) AS window_start, count(*) AS n_requests,
       CAST(greatest(count(*) - {RATE_LIMIT}, 0) AS BIGINT) AS n_limited FROM events GROUP BY user_id, date_trunc('day', ts)""",
    "rate_limit_stream": f"""SELECT user_id, strftime(date_trunc('day', ts), {_F}) AS window_start, count(*) AS n_requests,
       CAST(greatest(count(*) - {RATE_LIMIT}, 0) AS BIGINT) AS n_limited FROM events GROUP BY user_id, date_trunc('day', ts)""",
    "request_decisions": _DECISIONS,
    "request_decisions_batch": _DECISIONS,
    "session_counts_stream": "SELECT conv_id, count(*) AS message_count, max(turn) AS last_turn FROM conversations GROUP BY conv_id",
    "memory_stream": r"""WITH t AS (SELECT conv_id, turn, len(regexp_extract_all(text, '[\p{L}\p{N}\p{M}]+|[^\p{Z}\p{C}]')) AS n_tokens FROM conversations),
  r AS (SELECT *, sum(n_tokens) OVER w AS s, row_number() OVER w AS rn FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT conv_id, turn, n_tokens FROM r WHERE rn = 1 OR s <= 200""",
    "index_append": "SELECT vec_id, vec_id // 5 AS parent_id, 'default' AS collection FROM embeddings",
    "index_commits": """SELECT 'label' || label AS collection, count(*) AS n_rows, min(vec_id) AS low, max(vec_id) AS high
       FROM embeddings GROUP BY label""",
    "index_roundtrip": """SELECT 'label' || label AS collection, count(*) AS n_vectors,
       CASE WHEN 'label' || label = 'label0' THEN 0 ELSE 1 END AS registered FROM embeddings GROUP BY label""",
    "collection_fallback": """WITH req AS (SELECT DISTINCT conv_id, 'src' || (conv_id % 25) AS requested FROM conversations),
  reg AS (SELECT DISTINCT source AS collection FROM documents),
  sz AS (SELECT source AS collection, count(*) AS n_docs FROM documents GROUP BY source)
SELECT req.conv_id, req.requested, coalesce(reg.collection, 'default') AS collection,
       CASE WHEN reg.collection IS NULL THEN (SELECT count(*) FROM documents) ELSE sz.n_docs END AS n_docs
FROM req LEFT JOIN reg ON reg.collection = req.requested LEFT JOIN sz ON sz.collection = reg.collection""",
    "to_documents": "SELECT doc_id, 'lang=' || lang || ';n_chars=' || n_chars || ';source=' || source AS metadata FROM documents",
    "document_maps": """SELECT doc_id, md5(coalesce(text, '')) AS text_md5,
       concat_ws(';', 'lang=' || lang, 'n_chars=' || n_chars, 'tags=' || coalesce(source, 'None') || ',' || coalesce(lang, 'None') || ',None') AS metadata FROM documents""",
    "longform": """WITH q AS (SELECT text, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents),
  c AS (SELECT text, source, lang, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS pos FROM documents)
SELECT 'eli5_' || q.pos AS query_id, md5(q.text) AS query_md5, md5(c.text) AS context_md5, concat_ws(',', c.source, c.lang) AS titles FROM q JOIN c ON c.pos = q.pos""",
    "positional_join": """WITH b AS (SELECT item_id, text, row_number() OVER (ORDER BY item_id) - 1 AS pos FROM benchmark),
  c AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents)
SELECT 'eli5_' || b.pos AS query_id, b.text AS query, c.doc_id AS context_doc_id FROM b JOIN c ON c.pos = b.pos""",
    "first_n": f"SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT {FIRST_N}",
    "upload_checks": f"""WITH up AS (SELECT page_id, url, CASE WHEN page_id % 3 <> 0 THEN '{PDF}' ELSE 'text/html' END AS file_type,
       CAST(length(html) * 5000 AS BIGINT) AS size, 'user' || (page_id % 10) || '@example.com' AS owner FROM pages),
  r AS (SELECT *, CASE WHEN file_type <> '{PDF}' THEN 'only PDF files are allowed'
                       WHEN size > {MAX_UPLOAD_BYTES} THEN 'file too large' END AS reject_reason FROM up)
SELECT page_id, CAST(reject_reason IS NULL AS INTEGER) AS accepted, reject_reason,
       'file_name=' || url || ';file_type=' || file_type || ';size=' || size || ';user_email=' || owner AS metadata FROM r""",
    "last_answer_per_query": """WITH pt AS (SELECT * FROM (SELECT conv_id, turn, role, text AS question,
       lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nrole, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer
       FROM conversations) WHERE role = 'user' AND nrole = 'assistant')
SELECT md5(question) AS query_md5, md5(arg_max(answer, conv_id * 100000 + turn)) AS answer_md5 FROM pt GROUP BY question""",
    "context_blocks": f"""WITH {_bm25_sql('documents')},
  rel AS (SELECT top.query_id, string_agg(d.text, chr(10) || chr(10) ORDER BY top.rank) AS relevant
          FROM top JOIN documents d ON d.doc_id = top.doc_id GROUP BY top.query_id),
  {_HITS.replace('q AS (', 'q2 AS (', 1).replace('JOIN q ON q.term', 'JOIN q2 ON q2.term').replace('SELECT q.query_id', 'SELECT q2.query_id').replace('GROUP BY q.query_id', 'GROUP BY q2.query_id').replace('WHERE term IN (SELECT term FROM q)', 'WHERE term IN (SELECT term FROM q2)').replace(' d AS (', ' d2 AS (').replace('FROM d)', 'FROM d2)').replace('st AS (', 'st2 AS (').replace('FROM dft, st)', 'FROM dft, st2)').replace('h AS (', 'h2 AS (').replace('FROM h WHERE', 'FROM h2 WHERE').replace('tf AS (', 'tf2 AS (').replace('FROM tf ', 'FROM tf2 ').replace('tf.', 'tf2.').replace('dft AS (', 'dft2 AS (').replace('FROM dft,', 'FROM dft2,').replace('FROM tf2 GROUP BY term', 'FROM tf2 GROUP BY term').replace('idf AS (', 'idf2 AS (').replace('JOIN idf ON idf.term', 'JOIN idf2 ON idf2.term').replace('idf.idf', 'idf2.idf').replace('idf.avgdl', 'idf2.avgdl').replace('sc AS (', 'sc2 AS (').replace('FROM sc)', 'FROM sc2)').replace('r AS (', 'r2 AS (').replace('FROM r WHERE', 'FROM r2 WHERE').replace('top AS (', 'top2 AS (').replace('FROM top JOIN', 'FROM top2 JOIN').replace('top.', 'top2.')},
  st3 AS (SELECT query_id, string_agg(content, chr(10) ORDER BY rank) AS search_text FROM hits GROUP BY query_id),
  j AS (SELECT coalesce(rel.query_id, st3.query_id) AS query_id, coalesce(rel.relevant, '') AS relevant,
               coalesce(st3.search_text, '') AS search_text FROM rel FULL JOIN st3 ON st3.query_id = rel.query_id)
SELECT query_id, md5('[Document]: ' || relevant || chr(10) || chr(10) || '[Web Search]: ' || search_text) AS attributed_md5,
       md5(relevant || chr(10) || search_text) AS merged_md5, length(relevant) AS relevant_chars FROM j""",
    "prompts_relevance": f"""WITH {_bm25_sql('documents')}
SELECT top.query_id, top.doc_id,
       md5({_render_sql(PR.RELEVANCY_TEMPLATE, context_str='d.text', metadata="'{''lang'': ''' || d.lang || ''', ''source'': ''' || d.source || '''}'", query_str='b.text')}) AS prompt_md5,
       length({_render_sql(PR.RELEVANCY_TEMPLATE, context_str='d.text', metadata="'{''lang'': ''' || d.lang || ''', ''source'': ''' || d.source || '''}'", query_str='b.text')}) AS prompt_chars,
       md5({_render_sql(PR.TRANSFORM_QUERY_TEMPLATE, query_str='b.text')}) AS rewrite_md5
FROM top JOIN documents d ON d.doc_id = top.doc_id JOIN benchmark b ON b.item_id = top.query_id""",
}

QUERIES = {
    "rate_limit": rate_limit,
    "rate_limit_stream": rate_limit_stream,
    "request_decisions": request_decisions,
    "request_decisions_batch": request_decisions_batch,
    "session_counts_stream": session_counts_stream,
    "memory_stream": memory_stream,
    "index_append": index_append,
    "index_commits": index_commits,
    "index_roundtrip": index_roundtrip,
    "collection_fallback": collection_fallback,
    "to_documents": to_documents,
    "document_maps": document_maps,
    "longform": longform,
    "positional_join": positional_join,
    "first_n": first_n,
    "upload_checks": upload_checks,
    "last_answer_per_query": last_answer_per_query,
    "context_blocks": context_blocks,
    "prompts_relevance": prompts_relevance,
}
