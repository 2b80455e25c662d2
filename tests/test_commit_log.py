"""The index's commit log: replays, a run killed between append and commit, files read a batch, filters."""

import numpy as np
import pytest
from pyspark.sql import types as T

from quarry.sources import commit_log as CL

ROWS = "vec_id long, name string, collection string"
SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("collection", T.StringType())])


def batch(spark, a, b, collection="c d/ä"):
    return spark.createDataFrame([(i, f"n{i}", collection) for i in range(a, b)], ROWS).coalesce(1)


def held(spark, root, collection=None):
    return sorted(r.vec_id for r in CL.read_committed(spark, root, SCHEMA, collection).collect())


def test_filters():
    rng = np.random.default_rng(1)
    mine, other = rng.integers(-2**63, 2**63 - 1, 5000), rng.integers(-2**63, 2**63 - 1, 20000)
    bits = CL.bloom(mine)
    assert CL.may_hold(bits, mine).all() and CL.may_hold(bits, other).mean() < 0.02
    assert not CL.may_hold(CL.bloom(mine[:0]), other).any()


def test_replay_and_killed_run(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "index")
    assert CL.append(batch(spark, 0, 10), root, "s", 0, "vec_id") == {"read": 0, "written": 1}
    assert CL.append(batch(spark, 0, 10), root, "s", 0, "vec_id") == {"read": 0, "written": 0}      # a replay after its commit
    with monkeypatch.context() as m:
        m.setattr(CL, "_describe", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            CL.append(batch(spark, 5, 20), root, "s", 1, "vec_id")
    assert held(spark, root) == list(range(10))                                                  # what no log names is not seen
    assert CL.append(batch(spark, 5, 20), root, "s", 1, "vec_id") == {"read": 1, "written": 1}
    assert held(spark, root) == list(range(20)) and held(spark, root, "c d/ä") == list(range(20)) and held(spark, root, "x") == []
    assert CL.append(batch(spark, 0, 20, "x"), root, "t", 0, "vec_id")["written"] == 0              # all known: an empty commit
    assert len(CL.committed(spark, root)) == 3 and held(spark, root) == list(range(20))
    assert {r.collection for r in CL.read_committed(spark, root, SCHEMA).collect()} == {"c d/ä"}


def test_files_read_do_not_grow(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(CL, "BLOCK", 7)                                                          # several blocks a batch
    root = str(tmp_path / "index")
    read = [CL.append(batch(spark, 20 * i - 2, 20 * i + 20), root, "s", i, "vec_id")["read"] for i in range(6)]
    assert read == [0, 1, 1, 1, 1, 1] and held(spark, root) == list(range(-2, 120))


def test_odd_keys(spark, tmp_path):
    root = str(tmp_path / "index")
    rows = spark.createDataFrame([(None, "a", "c"), (None, "b", "c"), (7, "x", "c"), (7, "y", "c")], ROWS)
    CL.append(rows, root, "s", 0, "vec_id")
    got = CL.read_committed(spark, root, SCHEMA).collect()
    assert sorted(str(r.vec_id) for r in got) == ["7", "None", "None"]
    assert CL.append(rows.limit(0), root, "s", 1, "vec_id") == {"read": 0, "written": 0}
    assert CL.read_committed(spark, str(tmp_path / "none"), SCHEMA).count() == 0
