"""Registered chat-table queries.

Fixture (derived from ``conversations``; same rule in the oracle): session_id = conv_id,
owner ``user{conv_id mod 10}@example.com``, type retrieval for even / long_context for odd conv_id,
created_at = 2024-01-01 + conv_id hours, message ts = created_at + turn minutes. Update
requests: one per session, from the owner unless conv_id mod 4 = 3, title = the session's first
user message (empty when conv_id mod 5 = 0). Delete requests: conv_id mod 6 = 0 by the owner,
conv_id mod 6 = 1 by someone else (ignored). Memory budget 200 tokens (reference 1500).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import sessions as K
from quarry.sources.tables import table

# ---- fixture parameters ------------------------------------------------------------------------
PAGE_LIMIT, PAGE_OFFSET, MEMORY_LIMIT = 5, 5, 200
# -----------------------------------------------------------------------------------------------

FMT = "yyyy-MM-dd HH:mm:ss"


def messages(spark, sf):
    c = table(spark, sf, "conversations")
    created = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600)
    return c.select(F.col("conv_id").alias("session_id"), "turn", "role", "text",
                    F.when(F.col("conv_id") % 2 == 0, "retrieval").otherwise("long_context").alias("session_type"),
                    (created + F.make_dt_interval(mins=F.col("turn"))).alias("ts"),
                    F.concat(F.lit("user"), (F.col("conv_id") % 10).cast("string"), F.lit("@example.com"))
                    .alias("user_email"))


def sessions(spark, sf):
    m = messages(spark, sf)
    first_user = (m.filter(F.col("role") == "user").groupBy("session_id")
                  .agg(F.min_by("text", "turn").alias("first_user_text")))
    s = (m.groupBy("session_id", "user_email", "session_type")
         .agg(F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"),
              F.count("*").alias("message_count")))
    s = s.withColumn("created_at", F.timestamp_seconds(F.lit(1704067200) + F.col("session_id") * 3600))
    return s.withColumn("title", F.lit("")).join(first_user, "session_id", "left")


def session_list(spark, sf):
    page = K.list_sessions(sessions(spark, sf).drop("first_user_text"), PAGE_LIMIT, PAGE_OFFSET)
    return page.select("user_email", "session_id", F.col("position").cast("long").alias("position"),
                       "total", F.date_format("created_at", FMT).alias("created_at"))


def session_updates(spark, sf):
    s = sessions(spark, sf)
    other = F.concat(F.lit("user"), ((F.col("session_id") + 1) % 10).cast("string"), F.lit("@example.com"))
    upd = s.select("session_id",
                   F.when(F.col("session_id") % 4 == 3, other).otherwise(F.col("user_email")).alias("user_email"),
                   F.when(F.col("session_id") % 5 == 0, F.lit("")).otherwise(F.col("first_user_text")).alias("title"),
                   (F.col("created_at") + F.expr("INTERVAL 1 DAY")).alias("updated_at"))
    stranger = s.select("session_id", other.alias("user_email"), F.lit("stolen").alias("title"), (F.col("created_at") + F.expr("INTERVAL 9 DAYS")).alias("updated_at"))
    older = s.select("session_id", "user_email", F.lit("older").alias("title"), F.col("created_at").alias("updated_at"))
    upd = upd.union(stranger).union(older)
    dels = s.filter(F.col("session_id") % 6 <= 1).select(
        "session_id", F.when(F.col("session_id") % 6 == 0, F.col("user_email")).otherwise(other).alias("user_email"))
    updated = K.update_sessions(s.drop("first_user_text"), upd)
    kept_s, kept_m = K.delete_sessions(updated, messages(spark, sf), dels)
    counts = K.count_messages(kept_m).select("session_id", F.col("message_count").alias("n_messages"))
    return kept_s.join(counts, "session_id", "left").select(
        "session_id", "title", F.date_format("updated_at", FMT).alias("updated_at"), "n_messages")


def memory_buffer(spark, sf):
    m = messages(spark, sf).withColumn("n_tokens", F.size(T.tokenize(F.col("text"))))
    r = K.memory_buffer(m, MEMORY_LIMIT)
    return r.select("session_id", "turn", "n_tokens", "tokens_from_end", "kept")


def session_history(spark, sf):
    m = messages(spark, sf)
    h = K.session_history(m, types=["retrieval", "long_context"])
    line = lambda x: F.concat(x["role"], F.lit(": "), x["content"])
    cnt = K.count_messages(m)
    return h.join(cnt, "session_id").select(
        "session_id", "message_count", F.date_format("updated_at", FMT).alias("updated_at"),
        F.array_join(F.transform("retrieval", line), "\n").alias("retrieval_history"),
        F.array_join(F.transform("long_context", line), "\n").alias("long_context_history"))


def pair_turns(spark, sf):
    return K.pair_turns(table(spark, sf, "conversations")).select("conv_id", "turn", "question", "answer")


def classify_query(spark, sf):
    c = table(spark, sf, "conversations").filter(F.col("role") == "user")
    return c.select("conv_id", "turn", T.classify_query(F.col("text")).alias("query_class"))


def composite_keys(spark, sf):
    s = sessions(spark, sf)
    email = F.when(F.col("session_id") % 10 == 9, F.lit(None).cast("string")).otherwise(F.col("user_email"))
    keys = K.user_keys(F.col("user_email"), F.col("session_id") % 10, F.md5(F.col("session_id").cast("string")), F.col("session_id"))
    return s.select("session_id", K.chat_key(email, F.col("session_id"), F.col("session_type")).alias("chat_key"),
                    *[v.alias(k) for k, v in keys.items()])


def profiles(spark, sf):
    ev = table(spark, sf, "events")
    cust = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("user_name"))
    p = K.first_last_seen(ev).join(cust, "user_id", "left")
    return p.select("user_id", "user_name",
                    F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@example.com")).alias("user_email"),
                    F.date_format("first_logged_in", FMT).alias("first_logged_in"),
                    F.date_format("last_accessed", FMT).alias("last_accessed"), "n_events")


def profiles_lookup(spark, sf):
    ev = table(spark, sf, "events")
    p = K.first_last_seen(ev).withColumn("user_email", F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@example.com")))
    asked = table(spark, sf, "conversations").select(
        F.concat(F.lit("user"), (F.col("conv_id") % 400).cast("string"), F.lit("@example.com")).alias("user_email"))
    return K.profile_by_email(p, asked).select("user_email", "user_id", "n_events")


def stored_queries(spark, sf):
    """The queries of all users."""
    q = _queries(spark, sf)
    return K.stored_queries(q, q.select("user_id").distinct()).withColumn("position", F.col("position").cast("long"))


def _queries(spark, sf):
    c = table(spark, sf, "conversations").filter("role = 'user'")
    return c.select((F.col("conv_id") % 10).alias("user_id"), (F.col("conv_id") * 100000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"))


def owned_sessions(spark, sf):
    """K1 and K3: the stored sessions and newly created ones, as their owner sees them."""
    s = sessions(spark, sf).select("session_id", "user_email", "title", "session_type", "created_at", "updated_at", "message_count")
    first = table(spark, sf, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("title"))
    new = first.select((F.lit(1000000000) + F.col("conv_id")).alias("session_id"), "title", F.lit("retrieval").alias("session_type"),
                       F.concat(F.lit("user"), (F.col("conv_id") % 10).cast("string"), F.lit("@example.com")).alias("user_email"))
    return K.owned_by(K.create_sessions(s, new), "user3@example.com").select("session_id", "title", "message_count")


TOK = r"'[\p{L}\p{N}\p{M}]+|[^\p{Z}\p{C}]'"
_MSG = """m AS (SELECT conv_id AS session_id, turn, role, text,
              CASE WHEN conv_id % 2 = 0 THEN 'retrieval' ELSE 'long_context' END AS session_type,
              TIMESTAMP '2024-01-01 00:00:00' + to_hours(conv_id) + to_minutes(turn) AS ts,
              'user' || (conv_id % 10) || '@example.com' AS user_email FROM conversations),
  s AS (SELECT session_id, user_email, session_type, TIMESTAMP '2024-01-01 00:00:00' + to_hours(session_id) AS created_at,
               max(ts) AS updated_at, count(*) AS message_count, '' AS title,
               arg_min(CASE WHEN role = 'user' THEN text END, CASE WHEN role = 'user' THEN turn END) AS first_user_text
        FROM m GROUP BY session_id, user_email, session_type)"""
_F = "'%Y-%m-%d %H:%M:%S'"

_STORED = """SELECT conv_id % 10 AS user_id, conv_id * 100000 + turn AS query_id, text AS query,
       row_number() OVER (PARTITION BY conv_id % 10 ORDER BY conv_id * 100000 + turn) AS position
FROM conversations WHERE role = 'user'"""

SQL = {
    "session_list": f"""WITH {_MSG},
  r AS (SELECT *, row_number() OVER (PARTITION BY user_email ORDER BY created_at DESC, session_id DESC) AS position,
               count(*) OVER (PARTITION BY user_email) AS total FROM s)
SELECT user_email, session_id, position, total, strftime(created_at, {_F}) AS created_at FROM r
WHERE position > {PAGE_OFFSET} AND position <= {PAGE_OFFSET + PAGE_LIMIT}""",
    "session_updates": f"""WITH {_MSG},
  u AS (SELECT session_id, user_email AS req,
               CASE WHEN session_id % 4 = 3 THEN 'older' WHEN session_id % 5 = 0 THEN '' ELSE first_user_text END AS new_title,
               CASE WHEN session_id % 4 = 3 THEN created_at ELSE created_at + INTERVAL 1 DAY END AS new_ts FROM s),
  d AS (SELECT session_id, CASE WHEN session_id % 6 = 0 THEN user_email ELSE 'user' || ((session_id + 1) % 10) || '@example.com' END AS req
        FROM s WHERE session_id % 6 <= 1),
  up AS (SELECT s.session_id, s.user_email,
                CASE WHEN u.req = s.user_email THEN coalesce(nullif(u.new_title, ''), s.title) ELSE s.title END AS title,
                CASE WHEN u.req = s.user_email THEN u.new_ts ELSE s.updated_at END AS updated_at
         FROM s LEFT JOIN u ON u.session_id = s.session_id),
  del AS (SELECT d.session_id FROM d JOIN s ON s.session_id = d.session_id AND s.user_email = d.req),
  cnt AS (SELECT session_id, count(*) AS n_messages FROM m WHERE session_id NOT IN (SELECT session_id FROM del) GROUP BY session_id)
SELECT up.session_id, up.title, strftime(up.updated_at, {_F}) AS updated_at, cnt.n_messages
FROM up LEFT JOIN cnt ON cnt.session_id = up.session_id WHERE up.session_id NOT IN (SELECT session_id FROM del)""",
    "memory_buffer": f"""WITH {_MSG},
  t AS (SELECT session_id, turn, len(regexp_extract_all(text, {TOK}, 0)) AS n_tokens FROM m),
  r AS (SELECT *, sum(n_tokens) OVER (PARTITION BY session_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tokens_from_end,
               row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS rn FROM t)
SELECT session_id, turn, n_tokens, tokens_from_end, CAST(rn = 1 OR tokens_from_end <= {MEMORY_LIMIT} AS INTEGER) AS kept FROM r""",
    "session_history": f"""WITH {_MSG},
  h AS (SELECT session_id, count(*) AS message_count, max(ts) AS updated_at,
               coalesce(string_agg(CASE WHEN session_type = 'retrieval' THEN role || ': ' || text END, chr(10) ORDER BY turn), '') AS retrieval_history,
               coalesce(string_agg(CASE WHEN session_type = 'long_context' THEN role || ': ' || text END, chr(10) ORDER BY turn), '') AS long_context_history
        FROM m GROUP BY session_id)
SELECT session_id, message_count, strftime(updated_at, {_F}) AS updated_at, retrieval_history, long_context_history FROM h""",
    "pair_turns": """SELECT conv_id, turn, question, answer FROM (
  SELECT conv_id, turn, role, text AS question, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nrole,
         lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM conversations)
WHERE role = 'user' AND nrole = 'assistant'""",
    "classify_query": f"""SELECT conv_id, turn,
  CASE WHEN regexp_matches(lower(trim(text)), '\\?$') OR regexp_matches(lower(trim(text)), '{T.QUESTION_START}') THEN 'question'
       WHEN regexp_matches(lower(trim(text)), '{T.CHAT_WORDS}') THEN 'chat'
       WHEN regexp_matches(lower(trim(text)), '{T.CONVERSATIONAL_START}') THEN 'conversational'
       ELSE 'neither' END AS query_class
FROM conversations WHERE role = 'user'""",
    "composite_keys": f"""WITH {_MSG}
SELECT session_id,
       concat_ws(':', CASE WHEN session_id % 10 = 9 THEN 'anonymous' ELSE user_email END, CAST(session_id AS VARCHAR), session_type) AS chat_key,
       'USER#' || (session_id % 10) AS user_pk, 'TOKEN#' || md5(CAST(session_id AS VARCHAR)) AS token_pk,
       'EMAIL#' || user_email AS email_pk, 'QUERY#' || session_id AS query_sk, 'nq_' || session_id AS document_id FROM s""",
    "profiles_lookup": """WITH p AS (SELECT e.user_id, 'user' || e.user_id || '@example.com' AS user_email, count(*) AS n_events FROM events e GROUP BY 1),
  asked AS (SELECT DISTINCT 'user' || (conv_id % 400) || '@example.com' AS user_email FROM conversations)
SELECT asked.user_email, p.user_id, p.n_events FROM asked LEFT JOIN p USING (user_email)""",
    "stored_queries": _STORED,
    "stored_queries_all": _STORED,
    "owned_sessions": f"""WITH {_MSG} SELECT session_id, title, message_count FROM s WHERE user_email = 'user3@example.com'
UNION ALL SELECT 1000000000 + conv_id, text, 0 FROM (SELECT conv_id, arg_min(text, turn) AS text FROM conversations GROUP BY conv_id) WHERE conv_id % 10 = 3""",
    "profiles": f"""SELECT e.user_id, c.c_name AS user_name, 'user' || e.user_id || '@example.com' AS user_email,
       strftime(min(e.ts), {_F}) AS first_logged_in, strftime(max(e.ts), {_F}) AS last_accessed, count(*) AS n_events
FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id GROUP BY e.user_id, c.c_name""",
}

QUERIES = {
    "profiles_lookup": profiles_lookup,
    "stored_queries": stored_queries,
    "stored_queries_all": stored_queries,
    "owned_sessions": owned_sessions,
    "session_list": session_list,
    "session_updates": session_updates,
    "memory_buffer": memory_buffer,
    "session_history": session_history,
    "pair_turns": pair_turns,
    "classify_query": classify_query,
    "composite_keys": composite_keys,
    "profiles": profiles,
}
