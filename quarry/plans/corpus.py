"""Registered corpus queries: chunking, neighbours, grouping, two-level units.

Fixture values (reference defaults 4096 / 200 / 20 / 512 do not exercise grouping on these
documents, median 314 tokens): chunk 64 tokens, overlap 16, group cap 4, child chunks of 16
tokens with overlap 4.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import chunking as C
from quarry.operators import graph
from quarry.sources.tables import table, written

# ---- fixture parameters ------------------------------------------------------------------------
SIZE, OVERLAP, CAP, SMALL, SMALL_OVERLAP = 64, 16, 4, 16, 4
# ---------------------------------------------------------------------------------------------


def _chunks(spark, sf):
    return C.chunk(table(spark, sf, "documents").select("doc_id", "text"), SIZE, OVERLAP)


def chunk_window(spark, sf):
    return _chunks(spark, sf).select("doc_id", "seq", "n_chunks", "text")


def chunk_neighbors(spark, sf):
    c = C.neighbors(_chunks(spark, sf))
    return c.select("chunk_id", "prev_id", "next_id", "degree",
                    C.visit_order(F.col("seq"), F.col("n_chunks")).alias("visit_order"))


def group_chunks(spark, sf):
    g = C.group_chunks(_chunks(spark, sf), CAP)
    w = Window.partitionBy("doc_id", "group_idx")
    unlimited = C.group_index(F.col("seq"), F.col("n_chunks"), None)
    return g.select("doc_id", "seq", "group_idx", F.count("*").over(w).alias("group_size"),
                    unlimited.alias("group_idx_unlimited"))


def group_text(spark, sf):
    groups, _ = C.two_level(table(spark, sf, "documents").select("doc_id", "text"), SIZE, SMALL, CAP,
                            OVERLAP, SMALL_OVERLAP)
    return groups.select("group_id", "doc_id", "group_idx", "n_members", "text")


def child_chunks(spark, sf):
    _, children = C.two_level(table(spark, sf, "documents").select("doc_id", "text"), SIZE, SMALL, CAP,
                              OVERLAP, SMALL_OVERLAP)
    return children.select("parent_id", "doc_id", "seq", "n_chunks", "text")


def chunk_sentences(spark, sf):
    c = C.chunk_sentences(table(spark, sf, "documents").select("doc_id", "text"), SIZE, OVERLAP)
    return c.select("doc_id", "seq", "n_tokens", "text")


def components(spark, sf):
    """Parts and suppliers that lines of a quantity of 50 or more connect, as its SQL; ``components_all`` takes all lines."""
    return _supplied(table(spark, sf, "lineitem").where("l_quantity >= 50"))


def components_all(spark, sf):
    """Parts and suppliers that any line connects. No SQL: recursion over all of them is too much for it."""
    return _supplied(table(spark, sf, "lineitem"))


def _supplied(lines):
    edges = lines.select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 1000000000).alias("b"))
    return graph.connected(edges.select(F.col("a").alias("node")), edges)


def group_links(spark, sf):
    """C6 with a limit over the links of all chunks to their next ones; on such chains it gives what ``group_chunks`` gives."""
    c = written(_chunks(spark, sf).select("doc_id", "seq", "n_chunks"), "chunk-names")      # read by nodes and links; no text
    name = lambda seq: F.struct("doc_id", seq.alias("seq"))
    edges = c.where("seq < n_chunks - 1").select(name(F.col("seq")).alias("a"), name(F.col("seq") + 1).alias("b"))
    g = graph.group_graph(c.select(name(F.col("seq")).alias("node")), edges, CAP)
    size = F.count("*").over(Window.partitionBy("grp"))
    return g.select("node.doc_id", "node.seq", F.col("grp.seq").alias("first_seq"), size.alias("group_size"))


TOK = r"'[\p{L}\p{N}\p{M}]+|[^\p{Z}\p{C}]'"


def _chunk_sql(src: str, key: str, size: int, overlap: int, extra: str = "") -> str:
    step = size - overlap
    return f"""SELECT {key}{extra}, CAST(greatest(1, ceil((len(tok) - {overlap}) / {step})) AS INTEGER) AS n_chunks,
       CAST(unnest(range(CAST(greatest(1, ceil((len(tok) - {overlap}) / {step})) AS BIGINT))) AS INTEGER) AS seq, tok
FROM (SELECT {key}{extra}, regexp_extract_all(text, {TOK}, 0) AS tok FROM {src})"""


_CH = f"""c0 AS ({_chunk_sql('documents', 'doc_id', SIZE, OVERLAP)}),
  c AS (SELECT doc_id, n_chunks, seq, array_to_string(tok[seq * {SIZE - OVERLAP} + 1 : seq * {SIZE - OVERLAP} + {SIZE}], ' ') AS text FROM c0)"""

_GIDX = f"""CASE WHEN n_chunks <= 2 THEN 0 WHEN seq <= n_chunks - 3 THEN seq // {CAP}
     WHEN ((n_chunks - 3) % {CAP}) + 1 + 2 <= {CAP} THEN (n_chunks - 3) // {CAP} ELSE (n_chunks - 3) // {CAP} + 1 END"""

_GROUPS = _CH + f""",
  g AS (SELECT *, CAST({_GIDX} AS INTEGER) AS group_idx FROM c),
  gt AS (SELECT doc_id || '-g' || group_idx AS group_id, doc_id, group_idx, count(*) AS n_members,
                string_agg(text, chr(10) || chr(10) ORDER BY seq) || chr(10) || chr(10) AS text
         FROM g GROUP BY doc_id, group_idx)"""

SQL = {
    "components": """WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS a, l_suppkey + 1000000000 AS b FROM lineitem WHERE l_quantity >= 50),
  bo AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
  reach AS (SELECT a AS node, a AS other FROM bo UNION SELECT reach.node, bo.b FROM reach JOIN bo ON bo.a = reach.other)
SELECT node, min(other) AS component FROM reach GROUP BY node""",
    "chunk_window": f"WITH {_CH} SELECT doc_id, seq, n_chunks, text FROM c",
    "chunk_neighbors": f"""WITH {_CH}
SELECT doc_id || '-' || seq AS chunk_id,
       CASE WHEN seq > 0 THEN doc_id || '-' || (seq - 1) END AS prev_id,
       CASE WHEN seq < n_chunks - 1 THEN doc_id || '-' || (seq + 1) END AS next_id,
       1 + CAST(seq > 0 AS INTEGER) + CAST(seq < n_chunks - 1 AS INTEGER) AS degree,
       CAST(row_number() OVER (PARTITION BY doc_id ORDER BY 1 + CAST(seq > 0 AS INTEGER) + CAST(seq < n_chunks - 1 AS INTEGER), seq) - 1 AS INTEGER) AS visit_order
FROM c""",
    "group_chunks": f"""WITH {_CH}, g AS (SELECT *, CAST({_GIDX} AS INTEGER) AS group_idx FROM c)
SELECT doc_id, seq, group_idx, count(*) OVER (PARTITION BY doc_id, group_idx) AS group_size, 0 AS group_idx_unlimited FROM g""",
    "group_links": f"""WITH {_CH}, g AS (SELECT *, CAST({_GIDX} AS INTEGER) AS group_idx FROM c)
SELECT doc_id, seq, min(seq) OVER (PARTITION BY doc_id, group_idx) AS first_seq, count(*) OVER (PARTITION BY doc_id, group_idx) AS group_size FROM g""",
    "group_text": f"WITH {_GROUPS} SELECT group_id, doc_id, group_idx, n_members, text FROM gt",
    "child_chunks": f"""WITH {_GROUPS},
  k0 AS ({_chunk_sql('gt', 'group_id', SMALL, SMALL_OVERLAP, ', doc_id')})
SELECT group_id AS parent_id, doc_id, seq, n_chunks,
       array_to_string(tok[seq * {SMALL - SMALL_OVERLAP} + 1 : seq * {SMALL - SMALL_OVERLAP} + {SMALL}], ' ') AS text FROM k0""",
}

QUERIES = {
    "chunk_sentences": chunk_sentences,
    "components": components,
    "components_all": components_all,
    "chunk_window": chunk_window,
    "chunk_neighbors": chunk_neighbors,
    "group_chunks": group_chunks,
    "group_links": group_links,
    "group_text": group_text,
    "child_chunks": child_chunks,
}
