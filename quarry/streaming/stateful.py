"""Streams with state of their own that ends: a decision for every request (X1) and session memory.

Both run on ``transformWithState`` with timers, keep a bounded state a key, and send to the keyed state only what can
matter: rows that a look at one Arrow batch already decides do not cross the network to a hot key.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quarry.functions.text import tokenize
from quarry.session import scratch_path
from quarry.streaming.jobs import RATE_LIMIT, RATE_WINDOW, source

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_IDLE_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


@contextmanager
def _settings(spark: SparkSession, by_clock: bool) -> Iterator[None]:
    """The state store that keyed state needs, while a query runs; the session's settings come back after.

    By the clock, state may end at any time, so batches without data would follow one another for ever; there they are
    off, and what has ended goes with the next data.
    """
    wanted = {_PROVIDER: _ROCKSDB, **({_IDLE_BATCHES: "false"} if by_clock else {})}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _run(spark: SparkSession, rows: DataFrame, at: str, by_clock: bool = False) -> DataFrame:
    """Run to the end of the input in update mode, a folder a micro-batch; all rows that were ever sent."""
    def sink(df, epoch):
        df.write.mode("overwrite").parquet(f"{at}/out/epoch={epoch}")
    with _settings(spark, by_clock):
        q = rows.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.option("basePath", f"{at}/out").parquet(f"{at}/out")


def _fresh(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:8]}")


def _as_text(key: str):
    """A key as text that tells null from all values: rows of a null key share one state, too."""
    return F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))


def _from_text(key: str, field):
    return F.when(F.col(key) != "", F.substring(F.col(key), 2, 1 << 30)).cast(field.dataType)


# ---- X1: a decision for every request ----------------------------------------------------------


def request_decisions_batch(events: DataFrame, limit: int = RATE_LIMIT, window: str = RATE_WINDOW, key: str = "user_id",
                            ts: str = "ts", event: str = "event_id", route: str = "event_type", exempt: tuple = ()) -> DataFrame:
    """(key, event, window_start, allowed): the first ``limit`` requests of a client in a tumbling window, by time and
    event, are allowed. Requests of exempt routes are always allowed and not counted; a null time has no decision."""
    win = F.window(F.col(ts).cast("timestamp"), window)
    e = events.where(F.col(ts).isNotNull()).select(key, event, F.col(ts).alias("_t"), win["start"].alias("window_start"), _counted(route, exempt).alias("_c"))
    rank = F.row_number().over(Window.partitionBy(key, "window_start", "_c").orderBy("_t", event))
    return e.select(key, event, "window_start", (~F.col("_c") | (rank <= limit)).alias("allowed"))


def _counted(route: str, exempt: tuple):
    return F.coalesce(~F.col(route).isin(*exempt), F.lit(True)) if exempt else F.lit(True)


_REQUEST = {"client": "object", "at_us": "int64", "event": "int64"}


class Limiter(StatefulProcessor):
    """Of one share of the clients and one window: the first ``limit`` requests of each client by time and number. A request
    that is not among them, or that an earlier one pushes out, is limited for good; a timer at the window's end (in event
    time) ends the state. A call to the state costs the same for one client as for many, so that clients go in shares."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "clients array<string>, times array<long>, events array<long>")

    def handleInputRows(self, key, rows, timerValues):
        held = self.first.get()
        kept = pd.DataFrame(dict(zip(_REQUEST, held or ([], [], [])))).astype(_REQUEST).drop_duplicates(ignore_index=True)
        before = pd.MultiIndex.from_frame(kept)
        kept["old"] = True
        for frame in rows:
            new = frame[list(_REQUEST)]
            if len(before):
                new = new[~pd.MultiIndex.from_frame(new).isin(before)]         # else a replayed row
            both = pd.concat([kept, new.assign(old=False)]).sort_values(["client", "at_us", "event"], ignore_index=True)
            fits = both.groupby("client").cumcount() < self.limit
            kept = both[fits]
            yield self._decided(key, both[~fits], False)
        self.first.update(tuple(kept[c].tolist() for c in _REQUEST))
        if not held:
            self.handle.registerTimer(int(pd.Timestamp(key[2]).timestamp() * 1000))
        yield self._decided(key, kept[~kept["old"]], True)

    @staticmethod
    def _decided(key, rows: pd.DataFrame, allowed: bool) -> pd.DataFrame:
        return pd.DataFrame({"client": rows["client"], "event": rows["event"], "window_start": pd.Series([key[1]] * len(rows), rows.index, "datetime64[ns]"), "allowed": allowed})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.first.clear()
        return iter(())

    def close(self) -> None:
        pass


def request_decisions(spark: SparkSession, src: str, schema, limit: int = RATE_LIMIT, window: str = RATE_WINDOW, watermark: str | None = None,
                      key: str = "user_id", ts: str = "ts", event: str = "event_id", route: str = "event_type", exempt: tuple = (),
                      at: str | None = None, files: int | None = None, shares: int = 64) -> DataFrame:
    """X1 as a stream: every request gets a row when it comes, allowed or limited; one that a late, earlier request
    pushes out gets a second row. What is returned is the final decision of each (limited, if it ever was).

    State: ``limit`` requests a client and open window, ended by a timer once the watermark (``watermark`` behind the
    newest time, a window by default) is past the window. Later requests of an ended window are refused without a row.
    Requests that come ``limit`` places or more behind others of their window in one Arrow batch are limited at once.
    ``at``: folder of output and checkpoint, to resume from; ``files``: most files a micro-batch; ``shares``: parts that the
    clients of a window are dealt into, each with its state in one value.
    """
    rows = source(spark, src, schema, files).where(F.col(ts).isNotNull())
    win = F.window(F.col(ts).cast("timestamp"), window)
    rows = rows.select(_as_text(key).alias("client"), F.col(event).cast("long").alias("event"), win["start"].alias("window_start"), win["end"].alias("window_end"),
                       F.unix_micros(F.col(ts).cast("timestamp")).alias("at_us"), F.col(ts).cast("timestamp").alias("seen"), _counted(route, exempt).alias("counted"))

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            place = f[f["counted"]].sort_values(["at_us", "event"]).groupby(["client", "window_start"]).cumcount()
            f["surplus"] = False
            f.loc[place.index[place >= limit], "surplus"] = True
            yield f
    seen = rows.mapInPandas(look, "client string, event long, window_start timestamp, window_end timestamp, at_us long, seen timestamp, counted boolean, surplus boolean")
    out = "client string, event long, window_start timestamp, allowed boolean"
    seen = seen.withColumn("share", F.pmod(F.xxhash64("client"), F.lit(shares)).cast("int"))
    decided = (seen.where("counted and not surplus").withWatermark("seen", watermark or window).groupBy("share", "window_start", "window_end")
               .transformWithStateInPandas(Limiter(limit), out, "update", "EventTime"))
    at_once = seen.where("not counted or surplus").select("client", "event", "window_start", (~F.col("counted")).alias("allowed"))
    rows = _run(spark, decided.union(at_once), at or _fresh(spark, "decisions"))
    return (rows.groupBy("client", "event", "window_start").agg(F.bool_and("allowed").alias("allowed"))
            .select(_from_text("client", schema[key]).alias(key), F.col("event").alias(event), "window_start", "allowed"))


# ---- X3: session memory that ends --------------------------------------------------------------


class SessionMemory(StatefulProcessor):
    """Of one session: turns and token counts of its newest messages within a budget (the newest always), and of the next.

    In event time a timer ends the state ``idle`` after the newest message; in processing time the list's own time
    to live does.
    """

    def __init__(self, limit: int, idle_ms: int, event_time: bool):
        self.limit, self.idle_ms, self.event_time = limit, idle_ms, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.messages = handle.getListState("messages", "turn long, n_tokens long", None if self.event_time else self.idle_ms)

    def handleInputRows(self, key, rows, timerValues):
        kept, newest = [(int(a), int(b)) for a, b in self.messages.get()], 0
        for frame in rows:
            kept += zip(frame["turn"].tolist(), frame["n_tokens"].tolist())
            kept = reaching(kept, self.limit)
            newest = max(newest, int(frame["at_ms"].max()))
        self.messages.put(kept)
        if self.event_time:
            timers = list(self.handle.listTimers())
            end = max([newest + self.idle_ms, *timers])
            for t in timers:
                if t != end:
                    self.handle.deleteTimer(t)
            if end not in timers:
                self.handle.registerTimer(end)
        kept = within(kept, self.limit)
        yield pd.DataFrame({"session": [key[0]], "turns": [[a for a, _ in kept]], "sizes": [[b for _, b in kept]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.messages.clear()
        return iter(())

    def close(self) -> None:
        pass


def within(messages, limit: int) -> list[tuple[int, int]]:
    """The newest (turn, tokens) whose tokens stay within the limit, the newest always; a repeated one counts once."""
    out, total = [], 0
    for turn, size in sorted(set(messages), reverse=True):
        if out and total + size > limit:
            break
        out.append((turn, size))
        total += size
    return out


def reaching(messages, limit: int) -> list[tuple[int, int]]:
    """The messages of :func:`within` and the next one, that does not fit: it keeps out all older ones, whenever they come."""
    out, total = [], 0
    for turn, size in sorted(set(messages), reverse=True):
        if out and total > limit:
            break
        out.append((turn, size))
        total += size
    return out


def memory_stream(spark: SparkSession, src: str, schema, limit: int, key: str = "conv_id", turn: str = "turn", text: str = "text",
                  idle: str = "1 day", ts: str | None = None, watermark: str = "10 minutes", at: str | None = None, files: int | None = None) -> DataFrame:
    """X3, token-bounded: the messages that a session's memory holds, (key, turn, n_tokens).

    The state of a session is bounded by the budget and ends when the session has been idle for ``idle``: by the time
    column ``ts`` if there is one, else by the clock. The last memory of an ended session stays in the output; a
    session that comes back after that begins anew. Only the newest messages of a session within the budget, and the one
    that exceeds it, leave an Arrow batch.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    when = F.col(ts).cast("timestamp") if ts else F.lit(None).cast("timestamp")
    rows = source(spark, src, schema, files).select(_as_text(key).alias("session"), F.col(turn).cast("long").alias("turn"),
                                                    F.coalesce(F.size(tokenize(F.col(text))), F.lit(0)).cast("long").alias("n_tokens"), when.alias("seen"))

    def newest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f.drop_duplicates(["session", "turn", "n_tokens"]).sort_values(["turn", "n_tokens"], ascending=False)
            of = f.groupby("session")
            yield f[(of["n_tokens"].cumsum() - f["n_tokens"] <= limit) | (of.cumcount() == 0)]
    rows = rows.where("turn is not null").mapInPandas(newest, "session string, turn long, n_tokens long, seen timestamp")
    rows = rows.withColumn("at_ms", F.coalesce(F.unix_millis("seen"), F.lit(0)))
    if ts:
        rows = rows.withWatermark("seen", watermark)
    s = rows.groupBy("session").transformWithStateInPandas(SessionMemory(limit, idle_ms, ts is not None), "session string, turns array<long>, sizes array<long>",
                                                           "update", "EventTime" if ts else "ProcessingTime")
    got = _run(spark, s, at or _fresh(spark, "memory"), ts is None).groupBy("session").agg(F.max_by(F.struct("turns", "sizes"), "epoch").alias("m"))
    return (got.select("session", F.explode(F.arrays_zip("m.turns", "m.sizes")).alias("m"))
            .select(_from_text("session", schema[key]).alias(key), F.col("m.turns").alias(turn), F.col("m.sizes").alias("n_tokens")))
