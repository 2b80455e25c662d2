"""Streams with state that ends: decisions event by event, late rows, freed state, memory equal to its batch twin."""

import datetime as dt

import pytest
from quarry.streaming import stateful as ST

BASE = dt.datetime(2024, 1, 1)
EVENTS = "event_id long, ts timestamp, user_id long, event_type string"


def write(spark, path, schema, *batches):
    """Each batch a file, in the order of their times."""
    import os
    import time
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}-{i}")
        os.makedirs(path, exist_ok=True)
        [name] = [f for f in os.listdir(f"{path}-{i}") if f.endswith(".parquet")]
        os.rename(f"{path}-{i}/{name}", f"{path}/{i}.parquet")
        os.utime(f"{path}/{i}.parquet", (time.time() - 1000 + 10 * i,) * 2)
    return path, spark.createDataFrame([], schema).schema


def at(seconds):
    return BASE + dt.timedelta(seconds=seconds)


def state_rows(spark, folder, name):
    return spark.read.format("statestore").option("stateVarName", name).load(f"{folder}/state").count()


@pytest.fixture
def events(spark, tmp_path):
    first = [(i, at(i), 1, "call") for i in range(8)] + [(20, at(3), 2, "call"), (21, at(3), None, "call"), (22, at(4), 1, "health")]
    second = [(8 + i, at(10 + i), 1, "call") for i in range(6)] + [(30, at(70), 1, "call"), (31, None, 1, "call")]
    third = [(40, at(2.5), 1, "call"), (41, at(75), 1, "call"), (42, at(75), 1, "call")]          # 40 comes late and pushes 9 out
    fourth = [(50, at(400), 3, "call")]
    fifth = [(60, at(401), 3, "call")]
    sixth = [(61, at(20), 1, "call")]                                                             # its window has ended
    return write(spark, str(tmp_path / "in"), EVENTS, first, second, third, fourth, fifth, sixth)


def test_decisions_equal_the_batch_twin(spark, events, tmp_path):
    src, schema = events
    folder = str(tmp_path / "run")
    got = ST.request_decisions(spark, src, schema, 10, "1 minute", exempt=("health",), at=folder, files=1)
    twin = ST.request_decisions_batch(spark.read.parquet(src).where("event_id <> 61"), 10, "1 minute", exempt=("health",))
    rows = sorted(map(tuple, got.collect()), key=str)
    assert rows == sorted(map(tuple, twin.collect()), key=str)
    by = {r[1]: r[3] for r in rows}
    assert by[40] and by[8] and not by[9] and by[30] and by[22] and 61 not in by and 31 not in by
    sent = spark.read.parquet(f"{folder}/out").where("event = 9").orderBy("allowed").collect()
    assert [r.allowed for r in sent] == [False, True]                                             # allowed at first, then pushed out
    assert state_rows(spark, folder, "first") == 1                                                # only the open window's
    again = ST.request_decisions(spark, src, schema, 10, "1 minute", exempt=("health",), at=folder, files=1)
    assert sorted(map(tuple, again.collect()), key=str) == rows


def test_hot_client(spark, tmp_path):
    rows = [(i, at((i * 7919) % 50), 1, "call") for i in range(5000)]
    src, schema = write(spark, str(tmp_path / "in"), EVENTS, rows)
    got = ST.request_decisions(spark, src, schema, 10, "1 minute")
    assert {r.event_id for r in got.where("allowed").collect()} == {i for i, *_ in sorted(rows, key=lambda r: (r[1], r[0]))[:10]} and got.count() == 5000


TURNS = "conv_id long, turn long, text string, ts timestamp"


def test_memory_ends_by_event_time(spark, tmp_path):
    one = [(1, t, "a b c d", at(t)) for t in range(6)] + [(2, 0, "x " * 50, at(1))]
    two = [(1, 6, "e f", at(30)), (1, 6, "e f", at(30)), (3, 0, None, at(40))]
    three = [(4, 0, "late day", at(7200))]
    four = [(4, 1, "again", at(7300))]
    five = [(1, 7, "back", at(7300))]                                                             # session 1 begins anew
    src, schema = write(spark, str(tmp_path / "in"), TURNS, one, two, three, four, five)
    folder = str(tmp_path / "run")
    got = ST.memory_stream(spark, src, schema, 10, idle="30 minutes", ts="ts", at=folder, files=1)
    assert sorted((r.conv_id, r.turn) for r in got.collect()) == [(1, 7), (2, 0), (3, 0), (4, 0), (4, 1)]
    left = spark.read.format("statestore").option("stateVarName", "messages").load(f"{folder}/state")
    assert sorted({r[0] for r in left.select("key.session").collect()}) == ["=1", "=4"]


def test_memory_by_the_clock(spark, tmp_path):
    rows = [(c, t, "w " * ((c * t) % 7), at(t)) for c in range(20) for t in range(30)]
    src, schema = write(spark, str(tmp_path / "in"), TURNS, rows[:300], rows[300:])
    got = ST.memory_stream(spark, src, schema, 12, files=1).collect()
    want = {(c, t) for c in range(20) for t, _ in ST.within([(t, (c * t) % 7) for t in range(30)], 12)}
    assert {(r.conv_id, r.turn) for r in got} == want and len(got) == len(want)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ST._ROCKSDB


def test_limits(spark):
    assert ST.within([], 5) == [] and ST.within([(1, 9), (1, 9)], 5) == [(1, 9)] and ST.within([(3, 2), (2, 3), (1, 1)], 5) == [(3, 2), (2, 3)]
    none = spark.createDataFrame([], EVENTS)
    assert ST.request_decisions_batch(none).count() == 0
