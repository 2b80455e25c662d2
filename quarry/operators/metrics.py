"""Answer-quality metrics as table jobs.

* ``answer_join`` (M11) finds every (document, answer) pair where the answer's token list is a
  contiguous run of the document's, without a cross join: the answer side (small, size-checked)
  is broadcast as a shingle -> answer map; each document emits hashes of its token shingles and
  probes that map in the scan stage (no shuffle of exploded rows); only candidate pairs are shuffled
  and verified by exact padded-string containment, for which only their documents are tokenised again.
* ``rouge1`` (M12) counts unigram multisets with one ``groupBy(id, token)``: work is linear in
  tokens and spread over (id, token) keys, so a long text is never one task's whole input.
* ``running_mean`` (M18) is a blocked prefix sum: block totals (one row per block) are summed
  into offsets, each block runs its own ordered window. No single-partition window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.sources.tables import written

SHINGLE = 4


def _shingles(tokens: Column, n: int) -> Column:
    """Array of 64-bit hashes of the n-token windows (empty when there are fewer than n tokens)."""
    at = F.sequence(F.lit(0), F.size(tokens) - n)
    return F.when(F.size(tokens) >= n, F.transform(at, lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(n)]))).otherwise(
        F.array().cast("array<bigint>"))


def answer_join(docs: DataFrame, answers: DataFrame, *, doc_key: str = "doc_id", doc_text: str = "text",
                ans_key: str = "item_id", ans_text: str = "text", decompose: bool = True,
                shingle: int = SHINGLE) -> DataFrame:
    """(doc_key, ans_key) pairs where the answer's uncased tokens are a contiguous run of
    the document's (NFD first). Answers with no tokens match every document by definition; they
    are not expanded into pairs: :func:`empty_answers` lists them."""
    raw = docs.select(F.col(doc_key).alias("_d"), F.col(doc_text).alias("_t"))
    d0, a0 = raw, answers.select(F.col(ans_key).alias("_a"), F.col(ans_text).alias("_at"))
    if decompose:
        d0 = T.nfd_rows(d0, "_t", "_tn").select("_d", F.col("_tn").alias("_t"))
        a0 = T.nfd_rows(a0, "_at", "_an").select("_a", F.col("_an").alias("_at"))
    a = (a0.withColumn("_atok", T.tokenize(F.col("_at"), uncased=True))
         .filter(F.size("_atok") > 0)
         .withColumn("_len", F.least(F.size("_atok"), F.lit(shingle)))
         .withColumn("_key", F.coalesce(*[F.when(F.col("_len") == n, F.get(_shingles(F.slice("_atok", 1, n), n), F.lit(0))) for n in range(1, shingle + 1)]))
         .withColumn("_astr", T.token_string(F.col("_atok")))
         .select("_a", "_len", "_key", "_astr"))
    a = written(a, "answer-keys")                                              # read for its lengths, keys and answers
    keys = a.select("_len", "_key").distinct()
    lengths = sorted(r[0] for r in a.select("_len").distinct().collect())  # at most `shingle` values
    if not lengths:
        return docs.sparkSession.createDataFrame([], f"{doc_key} long, {ans_key} long")
    dtok = d0.select("_d", T.tokenize(F.col("_t"), uncased=True).alias("_dtok"))
    windows = F.concat(*[F.transform(_shingles(F.col("_dtok"), n), lambda h: F.struct(F.lit(n).alias("_len"), h.alias("_key"))) for n in lengths])
    cands = dtok.select("_d", F.explode(windows).alias("_w")).select("_d", "_w._len", "_w._key").join(keys, ["_key", "_len"])
    # Written: the scan of all documents runs once, and the texts of the few that are left meet ids of a known size.
    pairs = written(cands.join(a, ["_key", "_len"]).select("_d", "_a", "_astr").distinct(), "answer-candidates")
    full = raw.join(pairs.select("_d").distinct(), "_d", "left_semi")
    full = full.select("_d", T.token_string(T.tokenize(T.nfd(F.col("_t")) if decompose else F.col("_t"), uncased=True)).alias("_dstr"))
    ok = pairs.join(full, "_d").filter(F.contains(F.col("_dstr"), F.col("_astr")))
    return ok.select(F.col("_d").alias(doc_key), F.col("_a").alias(ans_key))


def empty_answers(answers: DataFrame, ans_key: str = "item_id", ans_text: str = "text") -> DataFrame:
    """M11, the other part: answers without tokens, which every document contains."""
    return answers.filter(F.size(T.tokenize(F.coalesce(F.col(ans_text), F.lit("")), uncased=True)) == 0).select(ans_key)


def token_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """Token count per row (M9 tokens)."""
    return df.select(key, F.size(T.tokenize(F.col(text))).alias("n_tokens"))


def rouge1(pairs: DataFrame, key: str = "id", pred: str = "prediction", target: str = "target",
           stemmer=None) -> DataFrame:
    """ROUGE-1 precision / recall / F per row -> (key, precision, recall, fmeasure).

    ``stemmer`` is an optional ``(DataFrame[token]) -> DataFrame[token, stem]`` job; it runs once
    over the distinct vocabulary and is joined back, never per row.
    """
    base = pairs.select(F.col(key).alias("_k"), F.col(pred).alias("_p"), F.col(target).alias("_t"))
    toks = (base.select("_k", F.explode(T.rouge_tokens(F.col("_p"))).alias("tok"), F.lit(1).alias("_ip"),
                        F.lit(0).alias("_it"))
            .unionByName(base.select("_k", F.explode(T.rouge_tokens(F.col("_t"))).alias("tok"),
                                     F.lit(0).alias("_ip"), F.lit(1).alias("_it"))))
    if stemmer is not None:
        vocab = toks.select("tok").distinct()
        stems = stemmer(vocab)
        toks = toks.join(stems, "tok").drop("tok").withColumnRenamed("stem", "tok")
    per_tok = toks.groupBy("_k", "tok").agg(F.sum("_ip").alias("cp"), F.sum("_it").alias("ct"))
    per_row = per_tok.groupBy("_k").agg(F.sum(F.least("cp", "ct")).alias("ov"), F.sum("cp").alias("np"),
                                        F.sum("ct").alias("nt"))
    r = base.select("_k").join(per_row, "_k", "left").na.fill(0, ["ov", "np", "nt"])
    p = F.col("ov") / F.greatest(F.col("np"), F.lit(1))
    rc = F.col("ov") / F.greatest(F.col("nt"), F.lit(1))
    return (r.select(F.col("_k").alias(key), p.alias("precision"), rc.alias("recall"))
            .withColumn("fmeasure", F.when(F.col("precision") + F.col("recall") > 0,
                                           2 * F.col("precision") * F.col("recall") /
                                           (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))))


def rouge_multi(pairs: DataFrame, key: str = "id", pred: str = "prediction", targets: str = "targets", stemmer=None, *,
                references: DataFrame | None = None, group: str = "group", target: str = "target") -> DataFrame:
    """Several references a row; the best value of each figure over them. A row without
    references has zeros.

    The references are the row's array ``targets`` or, with ``references`` (group, target), all of the row's group,
    equal ones once: token counts meet there, so that no text is copied to a pair and pairs without a common token,
    whose figures are zero, are not made. Equal rows count once, and of a repeated key the best.
    """
    best = [F.max(c).alias(c) for c in ("precision", "recall", "fmeasure")]
    if references is not None:
        return _rouge_by_group(pairs, references, key, pred, group, target, stemmer).groupBy(F.col("_k").alias(key)).agg(*best)
    one = pairs.select(F.col(key).alias("_id"), pred, F.posexplode_outer(targets).alias("_n", "_t"))
    one = one.select(F.struct("_id", "_n").alias("_id_n"), pred, F.coalesce("_t", F.lit("")).alias("_t"))
    return rouge1(one, "_id_n", pred, "_t", stemmer).groupBy(F.col("_id_n._id").alias(key)).agg(*best)


def _rouge_by_group(pairs: DataFrame, references: DataFrame, key: str, pred: str, group: str, target: str, stemmer) -> DataFrame:
    """(_k, precision, recall, fmeasure): of each row and each reference of its group with a common token, and a zero for each row."""
    p = pairs.select(F.col(group).alias("_g"), F.col(key).alias("_k"), F.coalesce(pred, F.lit("")).alias("_x")).distinct().withColumn("_p", F.md5("_x"))
    t = references.select(F.col(group).alias("_g"), F.coalesce(target, F.lit("")).alias("_x")).distinct().withColumn("_t", F.md5("_x"))

    def counts(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        toks = df.select(*keys, F.size(T.rouge_tokens(F.col("_x"))).alias(f"n{name}"), F.explode(T.rouge_tokens(F.col("_x"))).alias("tok"))
        if stemmer is not None:
            toks = toks.join(stemmer(toks.select("tok").distinct()), "tok").drop("tok").withColumnRenamed("stem", "tok")
        return toks.groupBy(*keys, f"n{name}", "tok").agg(F.count("*").alias(f"c{name}"))
    both = counts(p, ["_g", "_k", "_p"], "p").join(counts(t, ["_g", "_t"], "t"), ["_g", "tok"])
    per = both.groupBy("_g", "_k", "_p", "_t", "np", "nt").agg(F.sum(F.least("cp", "ct")).alias("ov"))
    per = per.select("_k", (F.col("ov") / F.col("np")).alias("precision"), (F.col("ov") / F.col("nt")).alias("recall"))
    per = per.withColumn("fmeasure", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return per.union(p.select("_k", *[F.lit(0.0)] * 3))


def rouge_avg(scores: DataFrame) -> DataFrame:
    """Mean of each ROUGE figure; no rows -> no row."""
    return (scores.agg(F.count("*").alias("n"), F.avg("precision").alias("precision"),
                       F.avg("recall").alias("recall"), F.avg("fmeasure").alias("fmeasure"))
            .filter(F.col("n") > 0))


def summary(results: DataFrame, dataset_size: Column | int) -> DataFrame:
    """One-row run summary; ratios are over processed (non-error) rows, 0 when none. The
    failed ids are a table of their own (:func:`failed_ids`), never one cell."""
    ok = F.col("status") != "error"
    n_ok = F.sum(ok.cast("int"))

    def ratio(c: Column) -> Column:
        return F.coalesce(F.sum(F.when(ok, c).otherwise(0)) / F.nullif(n_ok, F.lit(0)), F.lit(0.0))

    ds = dataset_size if isinstance(dataset_size, Column) else F.lit(dataset_size)
    return (results.agg(
        n_ok.cast("long").alias("processed_items"),
        F.sum((~ok).cast("int")).cast("long").alias("n_failed"),
        ratio(F.col("is_exact_match")).alias("exact_match"),
        ratio(F.col("is_substring_match")).alias("substring_match"),
        ratio((F.col("status") == "correct").cast("int")).alias("correct_match"),
        ratio((F.col("status") == "ambiguous").cast("int")).alias("ambiguous_match"),
        ratio((F.col("status") == "incorrect").cast("int")).alias("incorrect_match"))
        .withColumn("dataset_size", ds.cast("long"))
        .withColumn("completion_percentage",
                    F.col("processed_items") * 100.0 / F.nullif(F.col("dataset_size"), F.lit(0))))


def failed_ids(results: DataFrame, id_col: str = "id") -> DataFrame:
    """The ids of failed rows, one a row."""
    return results.filter(F.col("status") == "error").select(id_col)


def running_mean(df: DataFrame, seq: str, cols: list[str], block: int = 1 << 20) -> DataFrame:
    """Running means of ``cols`` in ``seq`` order (seq = 1, 2, ... dense positions).

    Blocked prefix sum: each block of ``block`` consecutive positions is one window partition,
    block totals give the offsets. Works for any size; no global single-task window.
    """
    b = df.withColumn("_blk", F.floor((F.col(seq) - 1) / block))
    tot = b.groupBy("_blk").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    wo = Window.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)  # over block totals only
    offs = tot.select("_blk", *[F.coalesce(F.sum(f"_t_{c}").over(wo), F.lit(0)).alias(f"_o_{c}") for c in cols])
    w = Window.partitionBy("_blk").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    out = b.join(F.broadcast(offs), "_blk")
    for c in cols:
        out = out.withColumn(f"running_{c}", (F.sum(c).over(w) + F.col(f"_o_{c}")) / F.col(seq))
    return out.drop("_blk", *[f"_o_{c}" for c in cols])
