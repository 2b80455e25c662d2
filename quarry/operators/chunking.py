"""Chunking and grouping of documents.

All chunk work is row-local: a document's chunk texts are built as one array from its token
array and only then exploded, so exploding never copies the token array once per chunk.
Chunk ids are (doc_id, seq), which makes PREVIOUS / NEXT plain arithmetic instead of a window.
Grouping of a chunk chain is the closed form of the greedy merge (smallest related group first,
nodes visited by ascending degree), so no driver-side graph walk is needed; arbitrary graphs go
through ``graph.group_graph``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators.vectors import ordered_join

# ---- fixed values (reference workload constants; overlap is the splitter's library default) --
CHUNK_SIZE = 4096
SMALL_CHUNK_SIZE = 512
MAX_GROUP_SIZE = 20
OVERLAP = 200
# ---------------------------------------------------------------------------------------------


def n_chunks(n_tok: Column, size: int, overlap: int) -> Column:
    step = size - overlap
    return F.greatest(F.lit(1), F.ceil((n_tok - overlap) / F.lit(step))).cast("int")


def chunk(df: DataFrame, size: int = CHUNK_SIZE, overlap: int = OVERLAP, *, key: str = "doc_id",
          text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """C1 (window mode): token windows of ``size`` tokens advancing by ``size - overlap``.

    Output: key, seq (0-based), n_chunks, text (tokens joined by one space), plus ``keep``.
    """
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    step = size - overlap
    keep = keep or []
    t = df.select(key, *keep, T.tokenize(F.col(text)).alias("_tok"))
    n = n_chunks(F.size("_tok"), size, overlap)
    arr = T.let(F.col("_tok"), lambda tok: F.transform(
        F.sequence(F.lit(0), n_chunks(F.size(tok), size, overlap) - 1),
        lambda i: F.array_join(F.slice(tok, i * step + 1, size), " ")))
    return (t.select(key, *keep, n.alias("n_chunks"), F.posexplode(arr).alias("seq", "text")))


def neighbors(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """SOURCE / PREVIOUS / NEXT relationships and degree (single 1, end 2, middle 3)."""
    cid = F.concat_ws("-", F.col(key).cast("string"), F.col("seq").cast("string"))
    prev = F.when(F.col("seq") > 0, F.concat_ws("-", F.col(key).cast("string"), (F.col("seq") - 1).cast("string")))
    nxt = F.when(F.col("seq") < F.col("n_chunks") - 1,
                 F.concat_ws("-", F.col(key).cast("string"), (F.col("seq") + 1).cast("string")))
    return (chunks.withColumn("chunk_id", cid).withColumn("prev_id", prev).withColumn("next_id", nxt)
            .withColumn("degree", 1 + F.col("prev_id").isNotNull().cast("int") + F.col("next_id").isNotNull().cast("int")))


def visit_order(seq: Column, n: Column) -> Column:
    """Position of a chunk in the greedy's visiting order (degree, then original order):
    first chunk, last chunk, then the middle ones."""
    return (F.when(n <= 2, seq).when(seq == 0, F.lit(0)).when(seq == n - 1, F.lit(1))
            .otherwise(seq + 1))


def group_index(seq: Column, n: Column, max_size: int | None = MAX_GROUP_SIZE) -> Column:
    """C5 closed form of the greedy grouping of a chunk chain (requires max_size >= 3).

    Chunks 0..n-3 fill groups of ``max_size`` in order; the last two chunks always travel
    together and join the last group when it has room for both.
    """
    if max_size is None:
        return F.lit(0)
    if max_size < 3:
        raise ValueError("closed form needs max_size >= 3; use graph.group_graph")
    m = F.lit(max_size)
    b = F.floor((n - 3) / m)
    s = F.pmod(n - 3, m) + 1
    return (F.when(n <= 2, F.lit(0))
            .when(seq <= n - 3, F.floor(seq / m))
            .when(s + 2 <= m, b).otherwise(b + 1)).cast("int")


def group_chunks(chunks: DataFrame, max_size: int | None = MAX_GROUP_SIZE, key: str = "doc_id") -> DataFrame:
    """Adds group_idx and group_id (key-group_idx). ``max_size=None`` -> one group per
    document (C9, regrouping loaded chunks without a limit)."""
    g = group_index(F.col("seq"), F.col("n_chunks"), max_size)
    return (chunks.withColumn("group_idx", g)
            .withColumn("group_id", F.concat_ws("-g", F.col(key).cast("string"), F.col("group_idx").cast("string"))))


def assemble_groups(grouped: DataFrame, key: str = "doc_id", metadata: str | None = None) -> DataFrame:
    """Group text = member texts in seq order, each followed by a blank line; metadata of
    a later member overwrites earlier (max_by on seq). Groups hold at most max_size members."""
    aggs = [F.count("*").alias("n_members"),
            F.concat(ordered_join("seq", "text", "\n\n"), F.lit("\n\n")).alias("text")]
    if metadata:
        aggs.append(F.max_by(metadata, "seq").alias(metadata))
    return grouped.groupBy(key, "group_idx", "group_id").agg(*aggs)


_SENTENCE = r"[^.!?\n]+[.!?]*\n*"


def chunk_sentences(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = OVERLAP, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, seq, n_tokens, text): whole sentences packed into chunks of at most ``size`` tokens.

    A chunk takes sentences while they fit; the next one starts with the last sentences of the one
    before that fit into ``overlap`` tokens, but always moves on by a sentence. A sentence longer than
    ``size`` is cut into pieces of ``size`` tokens. Sentences are split and tokenised once, by built-in
    functions, and chunks are made before they are exploded; only their lengths go through Python, a document at a time. A text without a sentence
    has no chunk.
    """
    piece = lambda text, n: F.struct(text.alias("p"), n.cast("int").alias("n"))
    cut = lambda tok, i: T.let(F.slice(tok, i * size + 1, size), lambda part: piece(F.array_join(part, " "), F.size(part)))
    pieces = F.flatten(F.transform(F.regexp_extract_all(F.col(text), F.lit(_SENTENCE), F.lit(0)), lambda s: T.let(T.tokenize(s), lambda tok: F.when(
        F.size(tok) <= size, F.array(piece(F.trim(s), F.size(tok)))).otherwise(
        F.transform(F.sequence(F.lit(0), F.floor((F.size(tok) - 1) / size).cast("int")), lambda i: cut(tok, i))))))
    s = docs.select(F.col(key).alias("_k"), F.filter(pieces, lambda x: x["n"] > 0).alias("_s"))

    @F.pandas_udf("array<struct<a:int,b:int>>")
    def packed(lengths: pd.Series) -> pd.Series:
        return lengths.map(lambda n: [{"a": a, "b": b} for a, b in pack_lengths([int(x) for x in n], size, overlap)] if n is not None and len(n) else [])
    s = s.select("_k", "_s", packed(F.col("_s.n")).alias("_r"))
    chunk_of = lambda r: T.let(F.slice("_s", r["a"] + 1, r["b"] - r["a"]), lambda part: F.struct(
        F.aggregate(part, F.lit(0), lambda total, x: total + x["n"]).alias("n"), F.array_join(F.transform(part, lambda x: x["p"]), " ").alias("t")))
    s = s.select("_k", F.posexplode(F.transform("_r", chunk_of)).alias("seq", "_c"))
    return s.select(F.col("_k").alias(key), "seq", F.col("_c.n").alias("n_tokens"), F.col("_c.t").alias("text"))


def pack_lengths(lengths: list[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """Ranges [a, b) of sentences; every length is at most ``size``."""
    out, a = [], 0
    while True:
        b, total = a, 0
        while b < len(lengths) and total + lengths[b] <= size:
            total += lengths[b]
            b += 1
        out.append((a, b))
        if b == len(lengths):
            return out
        back, kept = b, 0
        while back - 1 > a and kept + lengths[back - 1] <= overlap and kept + lengths[back - 1] + lengths[b] <= size:
            back -= 1
            kept += lengths[back]
        a = back


def two_level(docs: DataFrame, size: int | None = CHUNK_SIZE, small: int = SMALL_CHUNK_SIZE,
              max_size: int | None = MAX_GROUP_SIZE, overlap: int = OVERLAP,
              small_overlap: int = OVERLAP, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Chunk -> group -> assemble -> small chunks of each group carrying parent_id. Both
    levels overlap by the library's default unless told otherwise.

    With ``size=None`` the documents themselves are the groups. Returns (groups, children).
    """
    if size is None:
        groups = docs.select(key, F.lit(0).alias("group_idx"),
                             F.concat_ws("-g", F.col(key).cast("string"), F.lit("0")).alias("group_id"),
                             F.lit(1).cast("long").alias("n_members"), "text")
    else:
        c = chunk(docs, size, overlap, key=key)
        groups = assemble_groups(group_chunks(c, max_size, key), key)
    children = chunk(groups, small, small_overlap, key="group_id", keep=[key, "group_idx"])
    return groups, children.withColumnRenamed("group_id", "parent_id")
