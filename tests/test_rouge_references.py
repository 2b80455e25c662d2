from quarry.operators import metrics as M
from quarry.plans import evaluation as E


def test_references_of_a_group(spark):
    """By group as by array, on every target of the group, whatever their number."""
    rows = spark.createDataFrame([(1, "1:1", "the red fox"), (1, "1:2", "a b"), (1, "1:3", None), (2, "2:1", "red red")], "g long, id string, prediction string")
    refs = spark.createDataFrame([(1, t) for t in ("x y", "q", "the fox ran", "the fox ran", "a")] + [(2, "red"), (2, None), (3, "red")], "g long, target string")
    got = {r.id: tuple(r)[1:] for r in M.rouge_multi(rows, references=refs, group="g").collect()}
    arrays = rows.join(refs.groupBy("g").agg({"target": "collect_list"}).toDF("g", "targets"), "g")
    assert got == {r.id: tuple(r)[1:] for r in M.rouge_multi(arrays).collect()}
    assert got["1:1"] == (2 / 3, 2 / 3, 2 / 3) and got["1:3"] == (0.0, 0.0, 0.0)


def test_query_takes_all_questions(spark, tmp_path):
    """The third question from the answer counts, too."""
    turns = [(1, 2 * i, "user", q) for i, q in enumerate(["one", "two", "three", "blue sky"])] + [(1, 2 * i + 1, "assistant", a) for i, a in enumerate(["blue sky", "none", "none", "none"])]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.id: r.fmeasure for r in E.rouge_multi(spark, str(tmp_path)).collect()}
    assert got == {"1:0": 1.0, "1:2": 0.0, "1:4": 0.0, "1:6": 0.0}
