"""Corrective routing over retrieved hits.

A hit table is (query_id, rank, score, ...). The judge is a column: a response table joined by
id, the keyword-overlap default (R3), or a pandas UDF. Hits whose score clears the threshold
never reach the judge: the table is split, only the weak branch is joined to the judge's
answers, and the two branches are unioned (a Python judge inside ``when`` would otherwise run
on every row, because Python UDFs are not short-circuited).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import strip
from quarry.operators.vectors import ordered_join

# ---- fixed values (reference thresholds) ----------------------------------------------------
BATCH_THRESHOLD = 0.7
CHAT_THRESHOLD = 0.6
# ---------------------------------------------------------------------------------------------


def judge_relevance(hits: DataFrame, judge_answers: DataFrame | None, threshold: float | None,
                    key: str = "vec_id", answer_col: str = "answer",
                    default_answer: str | None = "no") -> DataFrame:
    """label = 'yes' when the score is non-null and >= threshold, otherwise the
    judge's answer lower-cased and stripped. ``threshold=None`` judges every hit (R2).

    ``judge_answers`` is (key, answer); a hit without an answer gets ``default_answer``.
    """
    if threshold is None:
        strong = hits.limit(0)
        weak = hits
    else:
        cond = F.col("score").isNotNull() & (F.col("score") >= F.lit(threshold))
        strong = hits.filter(cond)
        weak = hits.filter(~cond | F.col("score").isNull())
    strong = strong.withColumn("label", F.lit("yes"))
    if judge_answers is None:
        weak = weak.withColumn("label", F.lit(default_answer).cast("string"))
    else:
        ans = judge_answers.select(F.col(key), strip(F.lower(F.col(answer_col))).alias("label"))
        weak = (weak.join(ans, key, "left")
                .withColumn("label", F.coalesce(F.col("label"), F.lit(default_answer).cast("string"))))
    return strong.unionByName(weak)


def quality_answers(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Judge answers taken from a labelled table: quality 1 -> 'yes', else 'no'."""
    return labels.select(F.col(key).alias("vec_id"),
                         F.when(F.col("quality") == 1, "yes").otherwise("no").alias("answer"))


def keyword_judge(query_tokens: Column, doc_tokens: Column, min_overlap: float = 0.5) -> Column:
    """R3 default judge (keyword/topic overlap, not strict): share of distinct query terms found
    in the document >= ``min_overlap`` -> 'yes' else 'no'."""
    qd = F.array_distinct(query_tokens)
    share = F.size(F.array_intersect(qd, F.array_distinct(doc_tokens))) / F.greatest(F.size(qd), F.lit(1))
    return F.when(share >= min_overlap, "yes").otherwise("no")


def relevancy(labelled: DataFrame, key: str = "query_id", queries: DataFrame | None = None) -> DataFrame:
    """R4 + R8 per query: yes-count / hit-count, number of hits, any 'no'.

    With ``queries`` every query has a row: without hits the score is null and ``n_hits`` 0."""
    got = (labelled.groupBy(key)
            .agg(F.count("*").alias("n_hits"),
                 F.sum((F.col("label") == "yes").cast("int")).alias("n_yes"),
                 F.max(F.coalesce((F.col("label") == "no").cast("int"), F.lit(0))).alias("any_no"))
            .withColumn("relevancy_score", F.col("n_yes") / F.col("n_hits")))
    if queries is None:
        return got
    return queries.select(key).distinct().join(got, key, "left").na.fill(0, ["n_hits", "n_yes", "any_no"])


def status(score: Column) -> Column:
    """> 0.5 correct, == 0 incorrect, else ambiguous; no hits (null) -> incorrect (Q4)."""
    return (F.when(score.isNull(), "incorrect").when(score > 0.5, "correct")
            .when(score == 0.0, "incorrect").otherwise("ambiguous"))


def route_search(score: Column) -> Column:
    """Search when the relevancy score is below 0.5 (exactly 0.5 does not search)."""
    return F.coalesce(score < 0.5, F.lit(True)).cast("int")


def keep_relevant(labelled: DataFrame) -> DataFrame:
    """Hits whose label is exactly 'yes'."""
    return labelled.filter(F.col("label") == "yes")


def relevant_text(labelled: DataFrame, texts: DataFrame, key: str = "query_id",
                  text_key: str = "vec_id", queries: DataFrame | None = None) -> DataFrame:
    """Texts of 'yes' hits joined by newline in rank order; no 'yes' hit -> ''. With
    ``queries`` also a query without any hit has its row.

    The per-query group is bounded by k, so the ordered collect is small.
    """
    yes = keep_relevant(labelled).join(texts.select(text_key, "text"), text_key)
    agg = yes.groupBy(key).agg(ordered_join("rank", "text", "\n").alias("relevant_text"))
    return ((labelled if queries is None else queries).select(key).distinct().join(agg, key, "left")
            .withColumn("relevant_text", F.coalesce("relevant_text", F.lit(""))))


def attributed_context(relevant: Column, search: Column) -> Column:
    """R12: '[Document]: ...\\n\\n[Web Search]: ...'."""
    return F.concat(F.lit("[Document]: "), relevant, F.lit("\n\n[Web Search]: "), search)
