"""M11 answer join, ROUGE-1 and search text on hand-made rows."""

from pyspark.sql import functions as F

from quarry.functions.stem import stem_tokens
from quarry.operators import metrics as M
from quarry.operators import search as S


def test_answer_join(spark):
    docs = [(1, "The quick brown fox jumps over the lazy dog"), (2, "a café near the station"), (3, "quick brown"),
            (4, "Fox jumps over the lazy dog, again and again")]
    ans = [(10, "brown fox jumps"), (11, "Café"), (12, "the lazy dog"), (13, "quick brown fox jumps over"), (14, "  "), (15, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    a = spark.createDataFrame(ans, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in M.answer_join(d, a).collect()} == {(1, 10), (2, 11), (1, 12), (4, 12), (1, 13)}
    assert {r.item_id for r in M.empty_answers(a).collect()} == {14, 15}


def test_rouge1(spark):
    rows = [("1", "the cat sat on the mat", "the cat on a mat"), ("2", "", "x"), ("3", "runs running", "run")]
    df = spark.createDataFrame(rows, "id string, prediction string, target string")
    got = {r.id: (r.precision, r.recall, round(r.fmeasure, 6)) for r in M.rouge1(df).collect()}
    assert got == {"1": (4 / 6, 4 / 5, 0.727273), "2": (0, 0, 0), "3": (0, 0, 0)}
    stemmed = {r.id: (r.precision, r.recall) for r in M.rouge1(df, stemmer=stem_tokens).collect()}
    assert stemmed["3"] == (0.5, 1.0)
    many = spark.createDataFrame([("1", "a b", ["a", "a b c d", "x"]), ("2", "a", [])], "id string, prediction string, targets array<string>")
    best = {r.id: (r.precision, r.recall, round(r.fmeasure, 6)) for r in M.rouge_multi(many).collect()}
    assert best == {"1": (1.0, 1.0, 0.666667), "2": (0, 0, 0)}


def test_search_text(spark):
    html = "<html><title>A &amp; B</title><article class='x'><p>one &lt;two&gt;</p> &amp;lt; three</article></html>"
    df = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    r = S.pages_corpus(df).first()
    assert (r.title, r.content) == ("A & B", "one <two> &lt; three")
    hits = spark.createDataFrame([(1, 1, "", None, "u", "1.5"), (1, 2, "t", "c", "", "bad"), (1, 3, "t", "c", "v", None)],
                                 "query_id long, rank int, title string, content string, url string, score string")
    got = [tuple(r) for r in S.normalize_hits(hits).orderBy("rank").select("title", "content", "url", "score").collect()]
    assert got == [("No title", "No content", "u", 1.5), ("t", "c", "No URL", None), ("t", "c", "v", None)]
    lines = S.search_records(S.normalize_hits(hits)).first().search_records.split("\n")
    assert lines[0] == '{"title":"No title","content":"No content","url":"u","score":1.5}' and len(lines) == 3
    assert S.search_text(S.normalize_hits(hits)).select(F.col("search_text")).first()[0] == "No content\nc\nc"


def test_bm25_ranks_by_full_scores(spark):
    """The shorter document scores higher, by less than a millionth; rounded scores tie and the smaller id goes first."""
    from quarry.operators import search as S
    filler = " ".join(f"f{i}" for i in range(400000))
    docs = spark.createDataFrame([(1, "rare " + filler + " one"), (2, "rare " + filler), (3, "other words")], "doc_id long, text string")
    q = spark.createDataFrame([(9, "rare")], "query_id long, query string")
    assert [r.doc_id for r in S.bm25(docs, q, 2).orderBy("rank").collect()] == [2, 1]
    assert [r.doc_id for r in S.bm25(docs, q, 2, digits=6).orderBy("rank").collect()] == [1, 2]


def test_bm25_sums_a_document_in_one_task(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a a c"), (2, "a a c"), (3, "d"), (None, "b"), (4, None)], "doc_id long, text string")
    q = spark.createDataFrame([(7, "a b"), (8, "c a"), (8, "a"), (9, "x")], "query_id long, query string")
    got = S.bm25(docs, q, 2, digits=6)
    plan = got._jdf.queryExecution().executedPlan().toString()
    for line in plan.split("hashpartitioning(")[1:]:
        keys = line.split(", ENSURE")[0].split(", REPARTITION")[0]
        assert not ("query_id" in keys and "doc_id" in keys)            # (query, document) rows cross no exchange
    rows = [(r.query_id, r.doc_id, r["rank"]) for r in got.orderBy("query_id", "rank").collect()]
    assert rows == [(7, 1, 1), (7, 2, 2), (8, 2, 1), (8, 1, 2)]      # rows of one id and length count together
