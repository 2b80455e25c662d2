import os

import pytest
from pyspark.sql import functions as F

from quarry.operators import documents as D


def test_to_documents(spark):
    df = spark.createDataFrame([(1, "body", ["a", None, "c"], "x,y", 5, None), (2, None, [], "", None, "z")],
                               "id long, text string, tags array<string>, scalar string, n int, gap string")
    got = {r.id: (r.text, r.metadata) for r in D.to_documents(df, "text", ["tags", "scalar", "text", "absent", "n", "gap", "n"], keep=["id"]).collect()}
    assert got == {1: ("body", {"tags": "a,None,c", "scalar": "x,y", "n": "5"}), 2: (None, {"tags": "", "scalar": "", "gap": "z"})}
    assert [r.metadata for r in D.to_documents(df, "text").collect()] == [{}, {}]


def test_longform(spark):
    items = spark.createDataFrame([(7, "q7"), (3, "q3"), (None, "q0")], "id long, question string")
    contexts = spark.createDataFrame([("b", "cb", ["t1"]), ("a", "ca", []), ("c", "cc", None)], "k string, context string, context_titles array<string>")
    got = sorted(tuple(r) for r in D.reshape_longform(items, ["id"], contexts, ["k"]).collect())
    assert got == [("eli5_0", "q0", "ca", []), ("eli5_1", "q3", "cb", ["t1"]), ("eli5_2", "q7", "cc", None)]
    with pytest.raises(ValueError, match="equal lengths"):
        D.reshape_longform(items, ["id"], contexts.limit(2), ["k"])


def test_uploads(spark, tmp_path):
    for name, data in {"good.pdf": b"%PDF-1.7 body", "fake.pdf": b"plain text", "big.pdf": b"%PDF-" + b"x" * 100, "big.png": b"\x89PNG" + b"x" * 100,
                       "named.txt": b"%PDF-2", "empty.pdf": b""}.items():
        (tmp_path / name).write_bytes(data)
    got = {os.path.basename(r.path): r for r in D.read_uploads(spark, str(tmp_path), "a@b.c", max_bytes=50).collect()}
    assert {n: r.reject_reason for n, r in got.items()} == {
        "good.pdf": None, "named.txt": None, "fake.pdf": "only PDF files are allowed",
        "big.pdf": "file too large", "big.png": "only PDF files are allowed"}
    assert got["good.pdf"].metadata == {"file_name": "good.pdf", "file_type": D.PDF, "size": "13", "user_email": "a@b.c"}
    assert bytes(got["named.txt"].content) == b"%PDF-2" and got["big.pdf"].content is None


def test_size_is_pruned_before_content_is_read(spark, tmp_path):
    """A large file that cannot be read at all is still judged: its content is not asked for."""
    (tmp_path / "big.pdf").write_bytes(b"x" * 100)
    plan = D.read_uploads(spark, str(tmp_path), "o", 50)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(length,50)" in plan and "LessThanOrEqual(length,50)" in plan


def test_splits_round_trip(spark, tmp_path):
    rows = spark.range(30).select("id", F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    path = str(tmp_path / "out")
    parts = {"train": rows.where("id < 24"), "test": rows.where("id >= 24"), "data": rows}
    D.write_splits(parts, path)
    back = D.read_split_files(spark, path, "id long, text string")
    assert {r.split: r.n for r in back.groupBy("split").agg(F.count("*").alias("n")).collect()} == {"train": 24, "test": 6, "data": 30}
    assert {tuple(r) for r in D.read_split_files(spark, path, "id long, text string", "test").drop("split").collect()} == {tuple(r) for r in parts["test"].collect()}


def test_failed_write_leaves_no_file(spark, tmp_path):
    path = tmp_path / "out"
    bad = spark.range(0, 20, 1, 4).select(F.when(F.col("id") == 19, F.raise_error(F.lit("stop"))).otherwise(F.col("id").cast("string")).alias("id"))
    with pytest.raises(Exception, match="stop"):
        D.write_splits({"train": bad, "test": bad}, str(path))
    assert not [f for _, _, files in os.walk(path) for f in files if f.endswith(".json")]
