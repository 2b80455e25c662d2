"""Queries without a row filter, by brute force over the whole tables."""

from quarry.plans import registry


def test_components_of_all_lines(spark, sf):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_partkey", "l_suppkey").distinct().collect():
        a, b = find(r.l_partkey), find(r.l_suppkey + 1000000000)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in registry.queries()["components_all"](spark, sf).collect()}
    assert got == {x: find(x) for x in list(up)}


def test_stored_queries_of_all_users(spark, sf):
    rows = [r for r in spark.read.parquet(f"{sf}/conversations.parquet").collect() if r.role == "user"]
    want = sorted((r.conv_id % 10, r.conv_id * 100000 + r.turn, r.text) for r in rows)
    got = sorted(registry.queries()["stored_queries_all"](spark, sf).collect(), key=lambda r: (r.user_id, r.position))
    assert [(r.user_id, r.query_id, r["query"]) for r in got] == want and {r.user_id for r in got} == {r.conv_id % 10 for r in rows} > {4, 9}
