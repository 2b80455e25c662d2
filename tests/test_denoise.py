import numpy as np
import pytest

from quarry.operators import denoise as D


def test_marks_by_hand():
    # '1' selected, '0' plain, '2' special; S starts a pair, C is the position it consumes
    for codes, marks in [("0110", "0SC0"), ("0100", "0SC0"), ("111", "SCS"), ("1110", "SCSC"), ("12", "S2"), ("1111", "SCSC"), ("01020", "0SC20"), ("", "")]:
        assert D.mark(codes) == marks


def test_task_positions(spark):
    df = spark.range(0, 97).withColumnRenamed("id", "row_id")
    rows = df.select("row_id", D.assign_task(df.row_id).alias("t"), D.task_position(df.row_id).alias("p")).orderBy("row_id").collect()
    seen = {}
    for r in rows:
        assert r.p == seen.get(r.t, 0)
        seen[r.t] = r.p + 1


def test_draws_are_independent():
    vocab = [f"v{i}" for i in range(31997)]
    shares, follow, kinds = [], [], np.zeros(3)
    for row in (0, 1, 640, 645, 100_000, 2**40):
        toks = [D.BOS, D.REF, *[f"t{i}" for i in range(6000)]]
        codes, marks, out = D._passage(row, 1, toks, vocab, 42)
        low = len(toks) // 3
        assert set(codes[2:low]) == {"0"} and codes[:2] == "22"
        sel = np.array([c == "1" for c in codes[low:]])
        shares.append(sel.mean())
        follow.append(np.corrcoef(sel[:-1], sel[1:])[0, 1])
        for m, a, b in zip(marks, toks, out):
            if m in "SC":
                kinds += [b == D.MASK, a == b, b.startswith("v")]
            else:
                assert a == b
    assert all(0.27 < s < 0.33 for s in shares) and all(abs(f) < 0.06 for f in follow)
    assert np.allclose(kinds / kinds.sum(), [0.5, 0.1, 0.4], atol=0.02)


def test_every_token_has_an_id(spark):
    docs = spark.createDataFrame([(1, "b a a c"), (2, "a d")], "doc_id long, text string")
    ids = {r.token: r.id for r in D.token_ids(D.token_frequencies(docs)).collect()}
    assert ids == {"a": 3, "b": 4, "c": 5, "d": 6}
    got = {(r.doc_id, r.position): r.id for r in D.encode(docs, D.token_ids(D.token_frequencies(docs)), "doc_id").collect()}
    assert got == {(1, 0): 4, (1, 1): 3, (1, 2): 3, (1, 3): 5, (2, 0): 3, (2, 1): 6}


@pytest.mark.parametrize("common", [0, 2, 100])
def test_only_rare_tokens_are_shuffled(spark, common):
    docs = spark.createDataFrame([(1, "b a a c"), (2, "a d x"), (2, "a d x"), (None, "c"), (3, None)], "doc_id long, text string")
    ids = spark.createDataFrame([("a", 3), ("b", 4), ("c", 5), ("d", 6)], "token string, id long")
    got = D.encode(docs, ids, "doc_id", common=common)
    twice = [(2, 0, 3), (2, 1, 6), (2, 2, 0)] * 2
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 0, 4), (1, 1, 3), (1, 2, 3), (1, 3, 5), (None, 0, 5), *twice], key=str)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Join") == 1             # tokenised once; what is known joins nothing


def test_rows_of_a_task_are_masked_once(spark, tmp_path):
    """Three branches, one of them masked; ids that repeat, a null id and empty and null texts as the label texts of the same rows."""
    from quarry.plans import denoise as P
    texts = ["a b c d e f g, h", "", "x y z", None, "the red fox ran. far", "é 1 2 3"] * 8
    rows = [*enumerate(texts), (2, "x y z again"), (17, "q r s"), (17, "q r s"), (None, "no id")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = P.training_rows(spark, str(tmp_path))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    want = [(D.DATA_ORDER.index(r.task), r.text_md5) for r in P.label_sequence(spark, str(tmp_path)).collect()]
    assert sorted(((r.part, r.text_md5) for r in got.collect()), key=str) == sorted(want, key=str)
