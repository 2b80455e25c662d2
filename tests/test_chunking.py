"""Grouping of chunk chains by properties and hand-worked cases; windows, sentences, graphs."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.operators import chunking as C
from quarry.operators import graph


def groups_of(spark, sizes, m):
    rows = [(n, i) for n in sizes for i in range(n)]
    df = spark.createDataFrame(rows, "n_chunks int, seq int").select("n_chunks", "seq", C.group_index(F.col("seq"), F.col("n_chunks"), m).alias("g"))
    out = {}
    for r in df.collect():
        out.setdefault(r.n_chunks, {}).setdefault(r.g, []).append(r.seq)
    return out


def test_by_hand(spark):
    got = groups_of(spark, [1, 2, 3, 6, 7, 8, 9], 4)
    assert got[1] == {0: [0]} and got[2] == {0: [0, 1]} and got[3] == {0: [0, 1, 2]}
    assert got[6] == {0: [0, 1, 2, 3], 1: [4, 5]}          # the first four fill a group, the last two stay together
    assert got[7] == {0: [0, 1, 2, 3], 1: [4, 5, 6]}
    assert got[8] == {0: [0, 1, 2, 3], 1: [4, 5, 6, 7]}
    assert got[9] == {0: [0, 1, 2, 3], 1: [4, 5, 6], 2: [7, 8]}
    assert groups_of(spark, [9], None)[9] == {0: list(range(9))}


def test_properties(spark):
    for m in (3, 4, 7, 20):
        for n, groups in groups_of(spark, range(1, 70), m).items():
            members = sorted(x for g in groups.values() for x in g)
            assert members == list(range(n))                                       # a partition of the chunks
            for g in groups.values():
                assert len(g) <= m and sorted(g) == list(range(min(g), max(g) + 1))     # small and contiguous
            assert n < 2 or any({n - 2, n - 1} <= set(g) for g in groups.values())      # the last two together


def test_chunk_windows_and_neighbors(spark):
    text = " ".join(f"w{i}" for i in range(10))
    df = spark.createDataFrame([(1, text), (2, "solo")], "doc_id long, text string")
    c = C.chunk(df, 4, 1).orderBy("doc_id", "seq").collect()
    assert [r.text for r in c if r.doc_id == 1] == ["w0 w1 w2 w3", "w3 w4 w5 w6", "w6 w7 w8 w9"]
    nb = C.neighbors(C.chunk(df, 4, 1)).orderBy("doc_id", "seq").collect()
    assert [r.degree for r in nb] == [2, 3, 2, 1]
    assert nb[0].prev_id is None and nb[0].next_id == "1-1"


def test_two_level_children_point_to_groups(spark):
    df = spark.createDataFrame([(7, " ".join(f"t{i % 50}" for i in range(200)))], "doc_id long, text string")
    groups, children = C.two_level(df, 20, 8, 3, 5, 2)
    assert {r.parent_id for r in children.collect()} == {r.group_id for r in groups.collect()}
    assert max(r.n_members for r in groups.collect()) <= 3
    groups, children = C.two_level(df, None, 8, small_overlap=2)                   # documents as groups
    assert [r.group_id for r in groups.collect()] == ["7-g0"] and {r.parent_id for r in children.collect()} == {"7-g0"}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 10), min_size=1, max_size=40), st.integers(10, 25), st.integers(0, 9))
def test_pack_lengths(lengths, size, overlap):
    got = C.pack_lengths(lengths, size, overlap)
    assert got[0][0] == 0 and got[-1][1] == len(lengths)
    for (a, b), (c, d) in zip(got, got[1:]):
        assert a < c <= b < d and sum(lengths[c:b]) <= overlap
    assert all(0 < sum(lengths[a:b]) <= size for a, b in got)


def test_sentence_chunks(spark):
    df = spark.createDataFrame([(1, "One two three. Four five! Six seven eight nine? Ten."), (2, ""), (3, "a b c d e f g h i j k")], "doc_id long, text string")
    got = {(r.doc_id, r.seq): (r.n_tokens, r.text) for r in C.chunk_sentences(df, 8, 3).collect()}
    assert got == {(1, 0): (7, "One two three. Four five!"), (1, 1): (8, "Four five! Six seven eight nine?"), (1, 2): (2, "Ten."),
                   (3, 0): (8, "a b c d e f g h"), (3, 1): (3, "i j k")}


def test_graph(spark):
    nodes = spark.createDataFrame([(i,) for i in range(12)], "node long")
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 3), (5, 6), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in graph.connected(nodes, edges).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 9: 1, 5: 5, 6: 5, 4: 4, 7: 7, 8: 8, 10: 10, 11: 11}
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert {r.component for r in graph.connected(chain.select(F.col("a").alias("node")), chain).collect()} == {0}
    capped = graph.group_graph(nodes, edges, 3).where("component = 1").collect()
    assert sorted((r.node, r.grp) for r in capped) == [(1, 1), (2, 1), (3, 3), (9, 3)]     # ends 1, 9 act first, then 2, then 3
