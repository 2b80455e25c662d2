"""Structured Streaming jobs (X1-X3) and their batch twins; keyed state that ends is in ``stateful``.

Every stream reads a directory of parquet files incrementally (``availableNow`` processes what is
there and stops; the checkpoint is the resume marker), so a rerun after a failure picks up
exactly where the committed offsets stopped. Sinks are idempotent: aggregates run in update mode and
write each micro-batch to a folder of its number (a replay overwrites it; the reader takes the latest
row of a key), appends go through a commit log.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import scratch_path
from quarry.sources import commit_log

# ---- fixed values (reference limit: 10 requests per minute per client) -------------------------
RATE_LIMIT, RATE_WINDOW = 10, "1 minute"
# -----------------------------------------------------------------------------------------------


def rate_limit_batch(events: DataFrame, limit: int = RATE_LIMIT, window: str = RATE_WINDOW,
                     key: str = "user_id", ts: str = "ts", route: str = "event_type", exempt: tuple = ()) -> DataFrame:
    """X1 batch twin: requests per (client, tumbling window) and how many lie beyond ``limit``: one
    aggregate. Requests of the exempt routes are not counted."""
    w = F.window(F.col(ts).cast("timestamp"), window).alias("win")
    e = events.filter(~F.col(route).isin(*exempt)) if exempt else events
    return (e.groupBy(key, w).agg(F.count("*").alias("n_requests"))
            .select(key, F.col("win.start").alias("window_start"), "n_requests",
                    F.greatest(F.col("n_requests") - limit, F.lit(0)).alias("n_limited")))


def rate_limit_stream(spark: SparkSession, src: str, schema, limit: int = RATE_LIMIT,
                      window: str = RATE_WINDOW, watermark: str | None = None,
                      key: str = "user_id", ts: str = "ts", route: str = "event_type", exempt: tuple = ()) -> DataFrame:
    """X1 as a stream in update mode: the watermark drops late rows and frees the state of past windows.
    Returns the latest count of every window (written through an idempotent sink, read back)."""
    watermark = watermark or window
    events = source(spark, src, schema)
    if exempt:
        events = events.filter(~F.col(route).isin(*exempt))
    s = (events
         .withColumn("_ts", F.col(ts).cast("timestamp"))
         .withWatermark("_ts", watermark)
         .groupBy(key, F.window("_ts", window).alias("win"))
         .agg(F.count("*").alias("n_requests"))
         .select(key, F.col("win.start").alias("window_start"), "n_requests",
                 F.greatest(F.col("n_requests") - limit, F.lit(0)).alias("n_limited")))
    return _run_update(spark, s, "rate_limit", [key, "window_start"])


def session_counts_stream(spark: SparkSession, src: str, schema, key: str = "conv_id",
                          ts: str = "turn") -> DataFrame:
    """Per-session message counter updated as messages arrive (update mode; the state has two
    numbers a session)."""
    s = (source(spark, src, schema)
         .groupBy(key).agg(F.count("*").alias("message_count"), F.max(ts).alias("last_turn")))
    return _run_update(spark, s, "session_counts", [key])


def source(spark: SparkSession, src: str, schema, files: int | None = None):
    """File-stream source over a directory of files. A table ``dir/name.parquet`` may be one file or a folder of
    files: it is given as a pattern, as the stream takes a plain path for a folder. ``files``: most files a micro-batch."""
    r = spark.readStream.schema(schema)
    if files:
        r = r.option("maxFilesPerTrigger", files)
    if src.endswith(".parquet"):
        d, f = src.rsplit("/", 1)
        return r.parquet(f"{d}/{{{f}}}")
    return r.parquet(src)


def _run_update(spark: SparkSession, agg: DataFrame, name: str, keys: list[str]) -> DataFrame:
    run = f"{name}-{uuid.uuid4().hex[:8]}"
    out, ckpt = scratch_path(spark, f"{run}/out"), scratch_path(spark, f"{run}/ckpt")

    def sink(df, epoch):
        df.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    q = (agg.writeStream.outputMode("update").foreachBatch(sink)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    values = [c for c in agg.columns if c not in keys]
    rows = spark.read.option("basePath", out).parquet(out)
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "epoch").alias("_v"))
    return latest.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in values])


def incremental_index(spark: SparkSession, src: str, schema, index_path: str, ckpt: str,
                      key: str = "vec_id", transform=None, files: int | None = None) -> list[dict[str, int]]:
    """Append new vectors to an index with a commit log, resumable.

    Each micro-batch is committed under its stream and epoch with the rows whose key the index doesn't hold; a
    batch replayed after a failure adds nothing twice. Returns files read and written of each micro-batch.
    """
    done: list[dict[str, int]] = []

    def sink(df, epoch):
        df = transform(df) if transform else df
        done.append(commit_log.append(df, index_path, commit_log.stream_name(ckpt), epoch, key))

    q = (source(spark, src, schema, files).writeStream.foreachBatch(sink)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return done
