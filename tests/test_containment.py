"""Answer containment by automaton against the shingle join and hand-worked cases, in one shard and in many."""

import pytest

from quarry.operators.containment import SHARD, contained
from quarry.operators.metrics import answer_join

DOCS = [(1, "The cat sat, on the mat."), (2, "category matters"), (3, None), (4, ""), (5, "Über café cat"), (5, "mat again the cat"),
        (None, "the cat"), (6, "a " * 3000 + "long run of words"), (7, "x.y the-cat"), (8, "cat")]
ANSWERS = [(10, "the cat"), (11, "Cat"), (12, "mat ."), (13, ""), (14, None), (15, "café CAT"), (16, "THE CAT"), (17, "run of words"), (18, "cat sat on"),
           (19, "a a a a a a a"), (11, "cat"), (20, "...")]


@pytest.mark.parametrize("shard", [1, 12, SHARD])
def test_equals_the_shingle_join(spark, shard):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    answers = spark.createDataFrame(ANSWERS, "item_id long, text string")
    got = sorted((str(r.doc_id), r.item_id) for r in contained(docs, answers, shard=shard).collect())
    known = sorted({(r.doc_id, r.item_id) for r in answer_join(docs.where("doc_id is not null"), answers).collect()})
    assert sorted((int(d), a) for d, a in got if d != "None") == known
    assert {a for d, a in got if d == "None"} == {10, 11, 16} and ("5", 15) in got and ("1", 12) in got
    assert not any(d in ("2", "3", "4") for d, _ in got) and ("6", 19) in got and ("1", 18) not in got


def test_empty_tables(spark):
    docs, none = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert contained(docs, none).count() == 0
    assert contained(docs.limit(0), spark.createDataFrame(ANSWERS, "item_id long, text string")).count() == 0


def test_only_documents_with_candidates_are_tokenised_again(spark):
    docs = spark.createDataFrame([(1, "A b c d e f"), (1, "A b c d e f"), (2, "b c x"), (3, "a b c d x"), (None, "a b c d e"), (4, None), (5, "c")], "doc_id long, text string")
    answers = spark.createDataFrame([(10, "a b c d e"), (11, "b C"), (12, "c"), (13, "!"), (14, ""), (11, "x")], "item_id long, text string")
    got = answer_join(docs, answers)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "LeftSemi" in plan                 # windows of all documents were made once, before
    want = [(1, 10), (1, 10), (1, 11), (1, 11), (1, 12), (1, 12), (2, 11), (2, 11), (2, 12), (3, 11), (3, 11), (3, 12), (5, 12)]
    assert sorted(map(tuple, got.collect())) == want
