"""The size-limited greedy (C6): hand-worked graphs, chains, and a one-by-one run over random graphs."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import graph
from quarry.operators.chunking import group_index


def groups(spark, nodes, links, cap, **more):
    n = spark.createDataFrame([(x,) for x in nodes], "node long")
    e = spark.createDataFrame(links, "a long, b long")
    out = {}
    for r in graph.greedy_groups(n, e, cap, **more).collect():
        out.setdefault(r.grp, set()).add(r.node)
    assert all(min(m) == g for g, m in out.items())
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("whole", [1 << 16, 1])
def test_hand_worked(spark, whole):
    # a star: the leaves stand alone when the hub acts last; it takes the leaves formed last while there is room
    assert groups(spark, [], [(0, i) for i in range(1, 6)], 4, whole=whole) == [[0, 3, 4, 5], [1], [2]]
    # 1-2-3 and 4-5 joined by 3-4: ends 1, 5 act first, then 2, 3, 4 (two links each)
    assert groups(spark, [9], [(1, 2), (2, 3), (3, 4), (4, 5), (3, 3), (2, 1)], 3, whole=whole) == [[1, 2, 3], [4, 5], [9]]
    assert groups(spark, [1, 2], [], 3, whole=whole) == [[1], [2]]


def one_by_one(nodes, links, cap):
    near = {n: {b for a, b in links + [(y, x) for x, y in links] if a == n and b != n} for n in nodes}
    made = []                                                  # (formed at, members)
    for t, d in enumerate(sorted(nodes, key=lambda n: (len(near[n]), n))):
        mine = {d}
        for g in sorted([g for g in made if g[1] & near[d]], key=lambda g: (len(g[1]), -g[0])):
            if len(mine) + len(g[1]) <= cap:
                mine |= g[1]
                made.remove(g)
        made.append((t, mine))
    return sorted(sorted(m) for _, m in made)


@pytest.mark.parametrize("whole", [1 << 16, 1])
def test_random_graphs(spark, whole):
    rnd = random.Random(4)
    nodes = list(range(60))
    links = [(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(70)]
    assert groups(spark, nodes, links, 5, whole=whole) == one_by_one(nodes, links, 5)


def test_chain_as_closed_form(spark):
    n = 23
    want = spark.range(n).select("id", group_index(F.col("id"), F.lit(n), 5).alias("g")).collect()
    by = {}
    for r in want:
        by.setdefault(r.g, []).append(r.id)
    assert groups(spark, [], [(i, i + 1) for i in range(n - 1)], 5) == sorted(map(sorted, by.values()))


def test_many_small_components_share_a_call(spark, monkeypatch):
    # calls of Python are counted by what they get: 300 chains of five in few bundles, each grouped as it is alone
    monkeypatch.setattr(graph, "BUNDLE", 1 << 10)
    links = [(10 * c + i, 10 * c + i + 1) for c in range(300) for i in range(4)]
    seen = []
    whole = graph._greedy_small
    monkeypatch.setattr(graph, "_greedy_small", lambda e, n, m, bundles=None: seen.append(bundles) or whole(e, n, m, bundles))
    got = groups(spark, [], links, 3)
    assert 1 < seen[0] < 20
    assert got == sorted(sorted(10 * c + x for x in g) for c in range(300) for g in one_by_one(list(range(5)), links[:4], 3))


@pytest.mark.parametrize("few", [0, 1 << 16])
def test_components_of_a_long_chain(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW", few)
    n = 300
    links = [(i * 7919 % n, (i + 1) * 7919 % n) for i in range(n - 1)] + [(1000, 1001), (1001, 1000), (5000, 5000), (None, 3)]
    nodes = spark.createDataFrame([(x,) for x in [*range(n), 2000, None]], "node long")
    got = graph.connected(nodes, spark.createDataFrame(links, "a long, b long"), rounds=30).collect()
    assert sorted(map(tuple, got)) == sorted([(i, 0) for i in range(n)] + [(1000, 1000), (1001, 1000), (2000, 2000)])


def test_components_of_hubs(spark, monkeypatch):
    # a hub comes before all of its leaves in few rounds only; it must not lose one leaf a round
    monkeypatch.setattr(graph, "FEW", 0)
    links = [(1000 * h + i, 1000 * h) for h in (1, 2) for i in range(1, 400)] + [(None, 2000), (7, 7)]
    nodes = spark.createDataFrame([(a,) for a, _ in links], "node long")
    got = graph.connected(nodes, spark.createDataFrame(links, "a long, b long"), rounds=9).collect()
    assert sorted(map(tuple, got)) == [(7, 7), *[(1000 * h + i, 1000 * h) for h in (1, 2) for i in range(400)]]


def test_components_of_a_large_supplier(spark, monkeypatch, tmp_path):
    from quarry.plans import corpus
    monkeypatch.setattr(graph, "FEW", 0)
    monkeypatch.setattr(graph, "connected", lambda n, e, f=graph.connected: f(n, e, rounds=9))
    rows = [(i, 1, 50.0) for i in range(400)] + [(400, 1, 49.0), (500, 2, 50.0), (500, 2, 50.0), (None, 2, 50.0), (3, None, 50.0)]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = corpus.components(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [*[(i, 0) for i in range(400)], (500, 500), (10**9 + 1, 0), (10**9 + 2, 500)]
