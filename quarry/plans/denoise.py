"""Registered denoising-set queries.

Fixture ``uns`` (from ``documents``): row i = doc_id i; target = its text; passages = texts of
documents i, i+1, i+2 (those that exist, found by equi-joins on doc_id + 1 / + 2); scores =
[1, 0, 2] rotated left by i mod 3. Seed 42.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as Tx
from quarry.operators import denoise as D
from quarry.sources.tables import table

SEED = 42


def uns(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    d1 = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("t1"))
    d2 = d.select((F.col("doc_id") - 2).alias("doc_id"), F.col("text").alias("t2"))
    j = d.join(d1, "doc_id", "left").join(d2, "doc_id", "left")
    rot = F.pmod(F.col("doc_id"), F.lit(3))
    scores = (F.when(rot == 0, F.array(*[F.lit(x) for x in (1.0, 0.0, 2.0)]))
              .when(rot == 1, F.array(*[F.lit(x) for x in (0.0, 2.0, 1.0)]))
              .otherwise(F.array(*[F.lit(x) for x in (2.0, 1.0, 0.0)])))
    return j.select(F.col("doc_id").alias("row_id"), F.col("text").alias("target"),
                    F.filter(F.array("text", "t1", "t2"), lambda x: x.isNotNull()).alias("passages"),
                    scores.alias("scores"))


def _with_task(df):
    return df.withColumn("task", D.assign_task(F.col("row_id"))).withColumn("task_pos", D.task_position(F.col("row_id")))


def task_assign(spark, sf):
    u = _with_task(uns(spark, sf).select("row_id"))
    cnt = {r["task"]: r["count"] for r in u.groupBy("task").count().collect()}  # three numbers
    base = {"cac": 0, "sc": cnt.get("cac", 0), "cs": cnt.get("cac", 0) + cnt.get("sc", 0)}
    off = F.when(F.col("task") == "cac", base["cac"]).when(F.col("task") == "sc", base["sc"]).otherwise(base["cs"])
    return u.select("row_id", "task", "task_pos", (off + F.col("task_pos")).cast("long").alias("ordinal"))


def reference_passages(spark, sf):
    u = _with_task(uns(spark, sf))
    kept = F.when(F.col("task") == "cs", D.drop_target(F.col("passages"), F.col("target"))).otherwise(F.col("passages"))
    return u.select("row_id", "task", F.size(kept).alias("n_passages"),
                    D.source_index(F.col("scores")).alias("source_index"),
                    F.md5(F.array_join(D.reference_passages(kept), "\n")).alias("passages_md5"))


def _vocab(spark, sf):
    return D.replacement_vocabulary(D.token_frequencies(table(spark, sf, "documents")))


def _masked(u, vocab):
    """Per passage of the correct-and-complete rows: tokens, codes, marks, corrupted tokens."""
    c = u.filter(F.col("task") == "cac").select("row_id", F.posexplode("passages").alias("pidx", "p"))
    return D.mask_passages(c.select("row_id", "pidx", D.passage_tokens(F.col("p")).alias("toks")), vocab, SEED)


def mask_pairs(spark, sf):
    m = _masked(_with_task(uns(spark, sf)), _vocab(spark, sf))
    cnt = lambda s, ch: F.length(s) - F.length(F.regexp_replace(s, ch, ""))
    return m.select("row_id", "pidx", F.size("toks").alias("n_tokens"), cnt(F.col("codes"), "1").alias("n_selected"),
                    (cnt(F.col("marks"), "S") + cnt(F.col("marks"), "C")).alias("n_masked"),
                    F.size(F.filter("corrupted", lambda t: t == D.MASK)).alias("n_mask_tokens"),
                    F.md5(F.array_join("corrupted", " ")).alias("corrupted_md5"))


def _trace(task):
    s_idx = D.source_index(F.col("scores")).cast("string")
    return F.lit(D.TRACE_CS) if task == "cs" else F.concat(F.lit(D.TRACE_CAC if task == "cac" else D.TRACE_SC), s_idx)


def _sequences(spark, sf):
    """Per row: task, input tokens (prompt, query, trace) and the number of ignored label positions."""
    u = _with_task(uns(spark, sf))
    m = _masked(u, _vocab(spark, sf))
    cac_parts = (m.groupBy("row_id")
                 .agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pidx", "corrupted"))),
                                            lambda x: F.slice(x["corrupted"], 2, 1 << 30))).alias("cac_part")))
    u = u.join(cac_parts, "row_id", "left")
    plain = lambda arr: F.flatten(F.transform(arr, lambda p: F.slice(D.passage_tokens(p), 2, 1 << 30)))
    kept_cs = D.drop_target(F.col("passages"), F.col("target"))
    part = (F.when(F.col("task") == "cac", F.coalesce(F.col("cac_part"), F.array().cast("array<string>")))
            .when(F.col("task") == "cs", plain(kept_cs)).otherwise(plain(F.col("passages"))))
    trace = F.when(F.col("task") == "cac", _trace("cac")).when(F.col("task") == "cs", _trace("cs")).otherwise(_trace("sc"))
    q = Tx.tokenize(F.concat(F.lit(D.QUERY_TEMPLATE), F.col("target")))
    u = u.select("row_id", "task", F.concat(F.array(F.lit(D.BOS)), part).alias("prompt"), q.alias("q"),
                 Tx.tokenize(trace).alias("trace"))
    lo, hi = F.floor(F.size("q") / 2), F.floor(F.size("q") * 3 / 4)
    start = lo + F.pmod(D.draw(F.col("row_id"), "start", seed=SEED), hi - lo + 1)
    return u.select("row_id", "task", F.concat("prompt", "q", "trace").alias("input"),
                    (F.size("prompt") + start).cast("long").alias("n_ignored"))


def label_sequence(spark, sf):
    """The text and its label array (tokens behind the ignored part, -100 before)."""
    s = _sequences(spark, sf)
    lab = F.concat(F.array_repeat(F.lit(str(D.IGNORE_INDEX)), F.col("n_ignored").cast("int")),
                   F.slice("input", F.col("n_ignored").cast("int") + 1, F.size("input")))
    return s.select("row_id", "task", F.size("input").alias("n_input"), "n_ignored",
                    F.md5(F.concat(F.array_join("input", " "), F.lit(" " + D.EOS))).alias("text_md5"),
                    F.md5(F.array_join(lab, " ")).alias("labels_md5"))


def training_rows(spark, sf):
    """The tasks' rows as one union in the order cac, sc, cs, each split 80 / 20."""
    n = _with_task(uns(spark, sf).select("row_id")).groupBy("task").agg(F.count("*").alias("n_task"))
    parts = [_task_texts(spark, sf, t).withColumn("part", F.lit(i)) for i, t in enumerate(D.DATA_ORDER)]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    u = u.withColumn("task_pos", D.task_position(F.col("row_id"))).join(F.broadcast(n), "task")  # three rows
    return u.select("part", "task_pos", D.split(F.col("task_pos"), F.col("n_task")).alias("split"), F.md5("text").alias("text_md5"))


def _task_texts(spark, sf, task):
    """(row_id, task, text) of one task: the input tokens of :func:`_sequences` and the end mark, joined by blanks.

    Only rows of the task are read into it, only those of the first are masked, and passages leave the masking as texts: they
    are joined before they meet, never being empty, and sort as their tokens do, a blank coming before any character of a token.
    """
    u = _with_task(uns(spark, sf)).where(F.col("task") == task)
    if task == "cac":
        m = _masked(u, _vocab(spark, sf)).select("row_id", "pidx", F.array_join(F.slice("corrupted", 2, 1 << 30), " ").alias("piece"))
        m = m.groupBy("row_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pidx", "piece"))), lambda x: x["piece"]).alias("pieces"))
        u = u.join(m, "row_id", "left").withColumn("pieces", F.coalesce("pieces", F.array().cast("array<string>")))
    else:
        kept = D.drop_target(F.col("passages"), F.col("target")) if task == "cs" else F.col("passages")
        u = u.withColumn("pieces", F.transform(kept, lambda p: F.array_join(F.slice(D.passage_tokens(p), 2, 1 << 30), " ")))
    query = Tx.tokenize(F.concat(F.lit(D.QUERY_TEMPLATE), F.col("target")))
    tokens = F.concat(F.array(F.lit(D.BOS)), F.col("pieces"), query, Tx.tokenize(_trace(task)))
    return u.select("row_id", "task", F.concat(F.array_join(tokens, " "), F.lit(" " + D.EOS)).alias("text"))


def token_encoding(spark, sf):
    """Every token of every document as its vocabulary id; per document a checksum."""
    d = table(spark, sf, "documents")
    e = D.encode(d, D.token_ids(D.token_frequencies(d)), "doc_id")
    return e.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.sum(F.col("id") * (F.col("position") + 1)).alias("checksum"))


def split_80_20(spark, sf):
    u = _with_task(uns(spark, sf).select("row_id"))
    n = u.groupBy("task").agg(F.count("*").alias("n_task"))
    total = u.count()
    j = u.join(F.broadcast(n), "task")  # three rows
    return j.select("row_id", "task", D.split(F.col("task_pos"), F.col("n_task"), "reference").alias("split_reference"),
                    D.split(F.col("task_pos"), F.col("n_task")).alias("split"),
                    D.eval_slice(F.col("row_id"), F.lit(total), "test").alias("in_eval_slice"))


# ---- oracle SQL --------------------------------------------------------------------------------
TOK = r"'[\p{L}\p{N}\p{M}]+|[^\p{Z}\p{C}]'"
_UNS = f"""uns0 AS (SELECT d.doc_id AS row_id, d.text AS target,
          list_filter([d.text, d1.text, d2.text], lambda x: x IS NOT NULL) AS passages,
          CAST(CASE d.doc_id % 3 WHEN 0 THEN [1.0, 0.0, 2.0] WHEN 1 THEN [0.0, 2.0, 1.0] ELSE [2.0, 1.0, 0.0] END AS DOUBLE[]) AS scores
        FROM documents d LEFT JOIN documents d1 ON d1.doc_id = d.doc_id + 1 LEFT JOIN documents d2 ON d2.doc_id = d.doc_id + 2),
  uns AS (SELECT *, CASE WHEN (row_id // 4) % 10 < 4 THEN 'cac' WHEN (row_id // 4) % 10 < 8 THEN 'cs' ELSE 'sc' END AS task FROM uns0),
  ut AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY row_id) - 1 AS task_pos FROM uns)"""

def _bits(key: str, first: int) -> str:
    return f"CAST('0x' || substr(md5({key}), {first}, 8) AS BIGINT)"


_KEY = f"'{SEED}:' || row_id || ':' || pidx || ':' || (i - 1)"
_H1, _U2, _H3 = _bits(_KEY, 1), f"({_bits(_KEY, 9)} / 4294967296.0)", _bits(_KEY, 17)

_MASK = _UNS + f""",
  vc AS (SELECT token, count(*) AS c FROM (SELECT unnest(regexp_extract_all(text, {TOK}, 0)) AS token FROM documents)
         GROUP BY token ORDER BY c DESC, token LIMIT {D.VOCAB_HI - D.VOCAB_LO + 1}),
  voc AS (SELECT list(token ORDER BY c DESC, token) AS vocab FROM vc),
  pt0 AS (SELECT row_id, unnest(passages) AS p, generate_subscripts(passages, 1) - 1 AS pidx FROM ut WHERE task = 'cac'),
  pt AS (SELECT row_id, pidx, ['<s>', '[REFERENCE]'] || regexp_extract_all(p, {TOK}, 0) AS toks FROM pt0),
  pc AS (SELECT *, array_to_string(list_transform(toks, lambda t, i: CASE WHEN t IN ('<s>', '[MASK]', '[REFERENCE]') THEN '2'
                 WHEN (i - 1) >= len(toks) // 3 AND {_H1} < {D.MASK_P} * 4294967296 THEN '1' ELSE '0' END), '') AS codes FROM pt),
  pm AS (SELECT *, regexp_replace(translate(regexp_replace(codes, '11', 'SC', 'g'), '1', 'S'), 'S0', 'SC', 'g') AS marks FROM pc),
  pr AS (SELECT pm.*, list_transform(toks, lambda t, i: CASE WHEN substr(marks, i, 1) NOT IN ('S', 'C') THEN t
                 WHEN {_U2} < {D.MASK_FRAC} THEN '[MASK]'
                 WHEN {_U2} < {D.KEEP_FRAC} THEN t
                 ELSE coalesce(voc.vocab[{_H3} % {D.VOCAB_HI - D.VOCAB_LO + 1} + 1], '<unk>') END) AS corrupted
         FROM pm, voc)"""


_LABEL = _MASK + f""",
  cp AS (SELECT row_id, flatten(list(corrupted[2:] ORDER BY pidx)) AS cac_part FROM pr GROUP BY row_id),
  lb AS (SELECT ut.row_id, ut.task,
           ['<s>'] || CASE WHEN task = 'cac' THEN coalesce(cp.cac_part, [])
                           WHEN task = 'cs' THEN flatten(list_transform(list_filter(passages, lambda x: x <> target),
                                                   lambda p: ['[REFERENCE]'] || regexp_extract_all(p, {TOK}, 0)))
                           ELSE flatten(list_transform(passages, lambda p: ['[REFERENCE]'] || regexp_extract_all(p, {TOK}, 0))) END AS prompt,
           regexp_extract_all('{D.QUERY_TEMPLATE}' || target, {TOK}, 0) AS q,
           regexp_extract_all(CASE WHEN task = 'cac' THEN '{D.TRACE_CAC}' || CAST(greatest(coalesce(list_position(scores, 0.0), 0), 1) - 1 AS VARCHAR)
                                   WHEN task = 'cs' THEN '{D.TRACE_CS}'
                                   ELSE '{D.TRACE_SC}' || CAST(greatest(coalesce(list_position(scores, 0.0), 0), 1) - 1 AS VARCHAR) END, {TOK}, 0) AS trace
         FROM ut LEFT JOIN cp ON cp.row_id = ut.row_id)"""

SQL = {
    "task_assign": f"""WITH {_UNS},
  n AS (SELECT task, count(*) AS c FROM ut GROUP BY task)
SELECT row_id, task, task_pos,
       task_pos + CASE task WHEN 'cac' THEN 0 WHEN 'sc' THEN coalesce((SELECT c FROM n WHERE task = 'cac'), 0)
                  ELSE coalesce((SELECT c FROM n WHERE task = 'cac'), 0) + coalesce((SELECT c FROM n WHERE task = 'sc'), 0) END AS ordinal
FROM ut""",
    "reference_passages": f"""WITH {_UNS},
  k AS (SELECT *, CASE WHEN task = 'cs' THEN list_filter(passages, lambda x: x <> target) ELSE passages END AS kept FROM ut)
SELECT row_id, task, len(kept) AS n_passages, greatest(coalesce(list_position(scores, 0.0), 0), 1) - 1 AS source_index,
       md5(array_to_string(list_transform(kept, lambda p: '[REFERENCE] ' || p), chr(10))) AS passages_md5 FROM k""",
    "mask_pairs": f"""WITH {_MASK}
SELECT row_id, pidx, len(toks) AS n_tokens, length(codes) - length(replace(codes, '1', '')) AS n_selected,
       length(marks) - length(replace(replace(marks, 'S', ''), 'C', '')) AS n_masked,
       len(list_filter(corrupted, lambda t: t = '[MASK]')) AS n_mask_tokens,
       md5(array_to_string(corrupted, ' ')) AS corrupted_md5 FROM pr""",
    "label_sequence": f"""WITH {_LABEL},
  st AS (SELECT *, len(q) // 2 AS lo, (len(q) * 3) // 4 AS hi FROM lb)
SELECT row_id, task, len(input) AS n_input, n_ignored, md5(array_to_string(input, ' ') || ' </s>') AS text_md5,
       md5(array_to_string(list_resize(CAST([] AS VARCHAR[]), n_ignored, '-100') || input[n_ignored + 1:], ' ')) AS labels_md5
FROM (SELECT row_id, task, prompt || q || trace AS input, len(prompt) + lo + ({_bits(f"'{SEED}:' || row_id || ':start'", 1)} % (hi - lo + 1)) AS n_ignored FROM st)""",
    "training_rows": f"""WITH {_LABEL},
  n AS (SELECT task, count(*) AS n_task FROM ut GROUP BY task)
SELECT CASE task WHEN 'cac' THEN 0 WHEN 'sc' THEN 1 ELSE 2 END AS part, ut.task_pos,
       CASE WHEN ut.task_pos < floor((n_task + 1) * 0.8) THEN 'train' ELSE 'test' END AS split,
       md5(array_to_string(prompt || q || trace, ' ') || ' </s>') AS text_md5
FROM lb JOIN ut USING (row_id, task) JOIN n USING (task)""",
    "token_encoding": f"""WITH w AS (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS position FROM (SELECT doc_id, regexp_extract_all(text, {TOK}, 0) AS t FROM documents)),
  c AS (SELECT token, count(*) AS c FROM w GROUP BY token),
  ids AS (SELECT token, row_number() OVER (ORDER BY c DESC, token) + 2 AS id FROM c)
SELECT doc_id, count(*) AS n_tokens, CAST(sum(id * position) AS BIGINT) AS checksum FROM w JOIN ids USING (token) GROUP BY doc_id""",
    "split_80_20": f"""WITH {_UNS},
  n AS (SELECT task, count(*) AS n_task FROM ut GROUP BY task),
  tot AS (SELECT count(*) AS n FROM ut)
SELECT ut.row_id, ut.task,
       CASE WHEN task_pos < floor((n_task + 1) * 0.8) THEN 'train' WHEN task_pos >= floor(n_task * 0.8 + 1) THEN 'test' ELSE 'dropped' END AS split_reference,
       CASE WHEN task_pos < floor((n_task + 1) * 0.8) THEN 'train' ELSE 'test' END AS split,
       CAST(ut.row_id >= floor(tot.n * 0.2) + 1 AS INTEGER) AS in_eval_slice
FROM ut JOIN n USING (task), tot""",
}

QUERIES = {
    "task_assign": task_assign,
    "reference_passages": reference_passages,
    "mask_pairs": mask_pairs,
    "label_sequence": label_sequence,
    "split_80_20": split_80_20,
    "training_rows": training_rows,
    "token_encoding": token_encoding,
}
