"""Streams over a table that is a folder of files; clients of a window that share one state value."""

import pandas as pd
import pytest
from quarry.streaming import jobs as X
from quarry.streaming import stateful as ST

TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("files", [1, 3])
def test_table_of_several_files(spark, tmp_path, files):
    path = str(tmp_path / "conversations.parquet")
    rows = spark.createDataFrame([(c, t, "user", "a b") for c in range(6) for t in range(c + 1)], TURNS)
    rows.repartition(files).write.parquet(path)
    got = {r.conv_id: (r.message_count, r.last_turn) for r in X.session_counts_stream(spark, path, rows.schema).collect()}
    assert got == {c: (c + 1, c) for c in range(6)}


class Value:
    def __init__(self):
        self.held, self.calls = None, 0

    def get(self):
        self.calls += 1
        return self.held

    def update(self, value):
        self.calls, self.held = self.calls + 1, value


class Handle:
    def __init__(self):
        self.value, self.timers = Value(), []

    def getValueState(self, *_):
        return self.value

    def registerTimer(self, at):
        self.timers.append(at)


def test_clients_share_a_state_value():
    handle, limiter = Handle(), ST.Limiter(2)
    limiter.init(handle)
    key = (0, pd.Timestamp(0), pd.Timestamp(60, unit="s"))
    frame = lambda *rows: pd.DataFrame(rows, columns=["client", "at_us", "event"])
    run = lambda *frames: sorted((r.client, r.event, r.allowed) for f in limiter.handleInputRows(key, iter(frames), None) for r in f.itertuples())
    first = run(frame(*[(f"={c}", 10 + e, e) for c in range(50) for e in (2, 1)]), frame(("=0", 13, 3), ("=0", 13, 3), ("", 5, 9)))
    assert [r for r in first if r[0] in ("=0", "")] == [("", 9, True), ("=0", 1, True), ("=0", 2, True), ("=0", 3, False), ("=0", 3, False)]
    assert len(first) == 103 and handle.value.calls == 2 and handle.timers == [60_000]
    assert run(frame(("=1", 11, 1), ("=1", 4, 7), ("=2", 12, 2))) == [("=1", 2, False), ("=1", 7, True)]     # one replayed, one pushed out
    assert len(handle.timers) == 1 and len(handle.value.held[0]) == 101


def test_memory_whatever_the_batches():
    """A message that does not fit keeps older ones out, also where they come later."""
    import random
    rng = random.Random(3)
    for _ in range(300):
        messages = [(t, rng.choice([0, 1, 4, 9, 12])) for t in range(8)]
        rng.shuffle(messages)
        held = []
        for m in messages:
            held = ST.reaching([*held, m], 10)
        assert ST.within(held, 10) == ST.within(messages, 10)
