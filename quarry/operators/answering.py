"""Ranking of context parts and extractive answers (V7, R13, R14); answers made elsewhere are joined by
``prompts.join_responses`` instead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T

SENTENCE = r"[^.!?\n]+[.!?]*"


def sentences(text: Column) -> Column:
    """Sentences of a text in order, trimmed."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), T.strip), lambda s: s != "")


def overlap(query_tokens: Column, text: Column) -> Column:
    """Number of distinct query tokens that a text holds."""
    return F.size(F.array_intersect(query_tokens, T.tokenize(text, True)))


def rank_parts(query: Column, relevant: Column, search: Column) -> Column:
    """V7: the two context parts, the one that shares more query tokens first (ties: relevant text first),
    joined by a line break."""
    q = F.array_distinct(T.tokenize(query, True))
    joined = lambda a, b: F.concat(a, F.lit("\n"), b)
    return F.when(overlap(q, search) > overlap(q, relevant), joined(search, relevant)).otherwise(joined(relevant, search))


def best_sentence(df: DataFrame, key: str, query: str, context: str, out: str = "long_answer") -> DataFrame:
    """(key, out): the context's sentence that shares most distinct query tokens, the first of
    equals; '' where there is none. Sentences are rows, so a long context is no single row's work."""
    s = df.select(key, F.array_distinct(T.tokenize(F.col(query), True)).alias("_q"), F.posexplode(sentences(F.col(context))).alias("_i", "_s"))
    best = s.groupBy(key).agg(F.max(F.struct(overlap(F.col("_q"), F.col("_s")).alias("n"), (-F.col("_i")).alias("i"), F.col("_s").alias("s"))).alias("_b"))
    return df.select(key).join(best, key, "left").select(key, F.coalesce("_b.s", F.lit("")).alias(out))


def short_answer(long_answer: Column) -> Column:
    """R14 default: the long answer without its closing marks."""
    return F.regexp_replace(long_answer, r"[.!?]+$", "")
