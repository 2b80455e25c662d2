"""Chat sessions and messages as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pair_turns(messages: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """K9: each user message with the assistant message that directly follows it."""
    w = Window.partitionBy(conv).orderBy(turn)
    return (messages.select(conv, turn, "role", F.col("text").alias("question"),
                            F.lead("role").over(w).alias("_nrole"), F.lead("text").over(w).alias("answer"))
            .filter((F.col("role") == "user") & (F.col("_nrole") == "assistant"))
            .drop("_nrole", "role"))


# ---- fixed values (reference limits) -----------------------------------------------------------
MEMORY_TOKEN_LIMIT = 1500
MAX_SESSIONS_PER_USER = 50   # declared, never enforced on pages: see ``newest_sessions``
ANONYMOUS = "anonymous"
# -----------------------------------------------------------------------------------------------


def chat_key(email: Column, session: Column, stype: Column) -> Column:
    """P3: '{email}:{session}:{type}', 'anonymous:{session}:{type}' without an email."""
    return F.concat_ws(":", F.coalesce(email, F.lit(ANONYMOUS)), session.cast("string"), stype)


def user_keys(email: Column, user_id: Column, access_token: Column, query_id: Column) -> dict:
    """Single-table keys of users, access tokens, the email index and stored queries (sort key
    under the user's key), and the id that a query's document has in the index."""
    return {"user_pk": F.concat(F.lit("USER#"), user_id.cast("string")),
            "token_pk": F.concat(F.lit("TOKEN#"), access_token.cast("string")),
            "email_pk": F.concat(F.lit("EMAIL#"), email),
            "query_sk": F.concat(F.lit("QUERY#"), query_id.cast("string")),
            "document_id": F.concat(F.lit("nq_"), query_id.cast("string"))}


def profile_by_email(profiles: DataFrame, emails: DataFrame) -> DataFrame:
    """The profile of each asked email; an unknown email keeps its row with nulls."""
    return emails.select("user_email").distinct().join(profiles, "user_email", "left")


def stored_queries(queries: DataFrame, users: DataFrame) -> DataFrame:
    """All stored queries of the asked users, in query order within a user."""
    return (users.select("user_id").distinct().join(queries, "user_id")
            .withColumn("position", F.row_number().over(Window.partitionBy("user_id").orderBy("query_id"))))


def create_sessions(existing: DataFrame | None, new: DataFrame, now: Column | None = None) -> DataFrame:
    """K1: append new sessions with count 0 and created = updated = now (ids from the input)."""
    now = now if now is not None else F.current_timestamp()
    rows = new.select("session_id", "user_email", F.coalesce("title", F.lit("")).alias("title"),
                      "session_type", now.alias("created_at"), now.alias("updated_at"),
                      F.lit(0).cast("long").alias("message_count"))
    if existing is None:
        return rows
    return existing.unionByName(rows.join(existing.select("session_id"), "session_id", "left_anti"))


def list_sessions(sessions: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """K2/W8 for every user at once: newest first by created_at, the page [offset, offset + limit)
    of each user's sessions, with the user's true total (Q9). Every page is there: no cap. The
    count over the user keeps all rows, so nothing is pruned before the shuffle."""
    w = Window.partitionBy("user_email").orderBy(F.col("created_at").desc(), F.col("session_id").desc())
    ranked = (sessions.withColumn("position", F.row_number().over(w))
              .withColumn("total", F.count("*").over(Window.partitionBy("user_email"))))
    return ranked.filter((F.col("position") > offset) & (F.col("position") <= offset + limit))


def newest_sessions(sessions: DataFrame, cap: int = MAX_SESSIONS_PER_USER) -> DataFrame:
    """K13, only where asked for: each user's newest ``cap`` sessions (a window-group limit prunes
    rows before the shuffle)."""
    w = Window.partitionBy("user_email").orderBy(F.col("created_at").desc(), F.col("session_id").desc())
    return sessions.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= cap).drop("_n")


def owned_by(sessions: DataFrame, email: Column | str) -> DataFrame:
    """Hide sessions whose owner differs."""
    e = F.lit(email) if isinstance(email, str) else email
    return sessions.filter(F.col("user_email") == e)


def update_sessions(sessions: DataFrame, updates: DataFrame) -> DataFrame:
    """K4: updates(session_id, user_email, title, updated_at); applied only when the requester
    owns the session; the title changes only when non-empty. Of several requests of the owner the
    latest by ``updated_at`` counts (ties: the greater title); others' requests never do."""
    latest = F.max(F.struct("updated_at", F.coalesce("title", F.lit("")).alias("title")))
    u = (updates.join(sessions.select("session_id", "user_email"), ["session_id", "user_email"], "left_semi")
         .groupBy("session_id").agg(latest.alias("_u"))
         .select("session_id", F.lit(True).alias("_own"), F.col("_u.title").alias("_title"), F.col("_u.updated_at").alias("_ts")))
    j = sessions.join(u, "session_id", "left")
    own = F.coalesce("_own", F.lit(False))
    return (j.withColumn("title", F.when(own, F.coalesce(F.nullif(F.col("_title"), F.lit("")), F.col("title")))
                         .otherwise(F.col("title")))
            .withColumn("updated_at", F.when(own, F.col("_ts")).otherwise(F.col("updated_at")))
            .drop("_own", "_title", "_ts"))


def delete_sessions(sessions: DataFrame, messages: DataFrame, deletes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K5: deletes(session_id, user_email); owner-checked, removes the session row and its
    messages (left_anti on both tables)."""
    ok = deletes.join(sessions.select("session_id", "user_email"), ["session_id", "user_email"], "left_semi")
    ids = ok.select("session_id").distinct()
    return (sessions.join(ids, "session_id", "left_anti"), messages.join(ids, "session_id", "left_anti"))


def memory_buffer(messages: DataFrame, limit: int = MEMORY_TOKEN_LIMIT, key: str = "session_id",
                  turn: str = "turn", tokens: str = "n_tokens") -> DataFrame:
    """Keep the most recent messages whose running token sum (newest first) stays within
    ``limit``. Adds ``kept`` (0/1) and ``tokens_from_end``. Decision: the newest message is always
    kept, even over the budget, so that an answer never loses its question."""
    w = (Window.partitionBy(key).orderBy(F.col(turn).desc())
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    r = F.row_number().over(Window.partitionBy(key).orderBy(F.col(turn).desc()))
    return (messages.withColumn("tokens_from_end", F.sum(tokens).over(w))
            .withColumn("_r", r)
            .withColumn("kept", ((F.col("_r") == 1) | (F.col("tokens_from_end") <= limit)).cast("int"))
            .drop("_r"))


def count_messages(messages: DataFrame, key: str = "session_id", ts: str = "ts") -> DataFrame:
    """Message count and last message time per session."""
    return messages.groupBy(key).agg(F.count("*").alias("message_count"), F.max(ts).alias("updated_at"))


def session_history(messages: DataFrame, key: str = "session_id", stype: str = "session_type",
                    *, types: list[str]) -> DataFrame:
    """K8: per session, the ordered message list of each session type; missing -> empty list.
    Pivot on a given type list (no distinct-values pass). One session is one row: page it first
    (``list_sessions``) where sessions are long."""
    msg = F.struct(F.col("turn").alias("turn"), F.col("role").alias("role"), F.col("text").alias("content"))
    p = messages.groupBy(key).pivot(stype, types).agg(F.array_sort(F.collect_list(msg)))
    for t in types:
        p = p.withColumn(t, F.coalesce(F.col(t), F.array().cast(p.schema[t].dataType)))
    return p


def first_last_seen(events: DataFrame, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """First login = min(ts) (not overwritten on each login, Q10), last access = max."""
    return events.groupBy(key).agg(F.min(ts).alias("first_logged_in"), F.max(ts).alias("last_accessed"),
                                   F.count("*").alias("n_events"))
