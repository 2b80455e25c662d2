"""Grouping over an arbitrary graph (C6): connected components by rounds of grouped minima and joins, and the
size-limited greedy by rounds of nodes that do not depend on each other."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quarry.sources.tables import dense_position, written


#: Nodes and links of the components that are dealt to one call, on average.
BUNDLE = 1 << 16
#: Links (each in both directions) that one task may settle.
FEW = 1 << 16


def _settled(links: DataFrame) -> DataFrame:
    """(a, head) of a few links: every node but one of a component, and that one. Nodes may be structs."""
    node = links.schema["a"].dataType

    def run(batches):
        up, plain = {}, {}

        def top(x):
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x
        for b in batches:
            kind = b.schema.field("a").type
            for pair in zip(*(b.column(c).to_pylist() for c in ("a", "b"))):
                x, y = (tuple(v.values()) if isinstance(v, dict) else v for v in pair)
                plain.update({x: pair[0], y: pair[1]})
                x, y = top(up.setdefault(x, x)), top(up.setdefault(y, y))
                up[x] = y
        if up:
            got = [(plain[x], plain[top(x)]) for x in up if up[x] != x]
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], kind) for i in (0, 1)], ["a", "head"])
    return links.coalesce(1).mapInArrow(run, StructType([StructField("a", node), StructField("head", node)]))


def _last_heads(near: DataFrame) -> DataFrame:
    """(a, head) of (a, head, first), where ``head`` is the first neighbour of ``a`` in some order and ``first`` says that ``a`` comes before it:
    every node but the last of its path, and that one.

    Two nodes may be each other's first neighbours, and then the first of them is the last of the path. Longer rings cannot be: along a path, every
    second node comes before the one two steps back. Paths are halved until they have one step.
    """
    then = near.select(F.col("a").alias("head"), F.col("head").alias("next"))
    path = near.join(then, "head").where(~(F.col("first") & (F.col("next") == F.col("a")))).select("a", "head")
    while True:
        path = written(path, "graph-path")
        longer = path.join(path.select(F.col("a").alias("head"), F.col("head").alias("next")), "head", "left")
        if longer.where("next is not null").isEmpty():
            return path
        path = longer.select("a", F.coalesce("next", "head").alias("head"))


def connected(nodes: DataFrame, edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component): the smallest node reachable; a node without edges is its own component.

    ``nodes``: column node; ``edges``: columns a, b. The graph is contracted: in a round, every node with links goes with
    its first neighbour, by a hash of the round, and links between what is left go on. That halves the nodes that still have
    links, or better, whatever their links (a hub and its leaves are one node after a round), so all rounds together
    cost little more than the first. The last ``FEW`` links are settled in one task. Then the nodes taken in are named backwards,
    from the last round to the first. Each round is written to the shared folder; nothing is collected.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "graph-edges")
    every = nodes.select("node").union(both.select(F.col("a").alias("node"))).where("node is not null").distinct()
    taken, links = [], both
    for k in range(rounds + 1):
        left = links.count()
        if left <= FEW:
            taken += [written(_settled(links), "graph-taken")] if left else []
            break
        if k == rounds:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
        turn = lambda c: F.struct(F.xxhash64(F.lit(k), c).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        near = links.groupBy("a").agg(F.min(turn("b")).alias("near"))
        near = written(near.select("a", F.col("near.v").alias("head"), (turn("a") < F.col("near")).alias("first")), "graph-near")
        taken.append(_last_heads(near))
        for c in "ab":
            links = links.join(taken[-1].withColumnRenamed("a", c), c, "left").withColumn(c, F.coalesce("head", c)).drop("head")
        links = written(links.where("a <> b").distinct(), "graph-edges")
    named = None
    for got in reversed(taken):
        if named is not None:
            later = got.join(named.select(F.col("a").alias("head"), F.col("head").alias("last")), "head", "left")
            got = written(later.select("a", F.coalesce("last", "head").alias("head")).union(named), "graph-named")
        named = got
    if named is None:
        return every.withColumn("component", F.col("node"))
    low = named.groupBy("head").agg(F.min("a").alias("low")).select("head", F.least("low", "head").alias("low"))
    every = every.join(named.withColumnRenamed("a", "node"), "node", "left").withColumn("head", F.coalesce("head", "node"))
    return every.join(low, "head", "left").select("node", F.coalesce("low", "node").alias("component"))


def _one_after_another(degree_order: list, near: dict, max_size: int) -> dict:
    """The greedy on one small component: {node: the node that formed its group last}."""
    group, members = {}, {}
    for d in degree_order:
        touched = sorted({group[r] for r in near.get(d, ()) if r in group}, key=lambda g: (len(members[g]), -g))
        mine = [d]
        for g in touched:
            if len(mine) + len(members[g]) <= max_size:
                mine += members.pop(g)
        members[d] = mine
        group.update(dict.fromkeys(mine, d))
    return group


def _greedy_small(edges: DataFrame, nodes: DataFrame, max_size: int, bundles: int = 1) -> DataFrame:
    """(pos, grp) for components that one task may hold. They are dealt to ``bundles``, each one call for all of its components:
    a node sees its neighbours only, so the greedy over several components is that over each."""
    def grouped(key, of, links):
        near = {}
        for a, b in zip(links["a"].tolist(), links["b"].tolist()):
            near.setdefault(a, []).append(b)
        return pd.DataFrame(list(_one_after_another(sorted(of["pos"].tolist()), near, max_size).items()), columns=["pos", "grp"])
    dealt = lambda df, *cols: df.select(F.pmod(F.xxhash64("component"), F.lit(bundles)).alias("bundle"), *cols).groupBy("bundle")
    return dealt(nodes, "pos").cogroup(dealt(edges, "a", "b")).applyInPandas(grouped, "pos long, grp long")


def _greedy_rounds(edges: DataFrame, nodes: DataFrame, max_size: int) -> DataFrame:
    """(pos, grp) by dependency rounds: in each, all nodes act whose turn no open node can change.

    A node may act once it comes first among the open nodes of every group that it touches and before its open neighbours:
    a group changes only through a node that touches it, so what the node sees is what it would see in the one-by-one
    order. Two nodes of a round share no group.
    """
    done = nodes.sparkSession.createDataFrame([], "pos long, grp long")
    open_ = written(nodes.select("pos"), "greedy-open")
    while not open_.isEmpty():
        mine = edges.join(open_.withColumnRenamed("pos", "a"), "a")
        touched = written(mine.join(done.withColumnRenamed("pos", "b"), "b").select("a", "grp").distinct(), "greedy-touched")
        first = touched.groupBy("grp").agg(F.min("a").alias("first"))
        late = touched.join(first, "grp").where("a > first").select("a")
        late = late.union(mine.join(open_.withColumnRenamed("pos", "b"), "b").where("b < a").select("a"))
        ready = written(open_.join(late.select(F.col("a").alias("pos")).distinct(), "pos", "left_anti"), "greedy-ready")
        size = done.groupBy("grp").agg(F.count("*").alias("n"))
        smallest = Window.partitionBy("a").orderBy("n", F.desc("grp"))
        some = (touched.join(ready.withColumnRenamed("pos", "a"), "a").join(size, "grp")
                .withColumn("nth", F.row_number().over(smallest)).where(F.col("nth") < max_size)     # a group has a member at least
                .withColumn("sum", F.sum("n").over(smallest.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("sum") < max_size))
        done = written(done.join(some.select("grp", "a"), "grp", "left").select("pos", F.coalesce("a", "grp").alias("grp"))
                       .union(ready.select("pos", F.col("pos").alias("grp"))), "greedy-groups")
        open_ = written(open_.join(ready, "pos", "left_anti"), "greedy-open")
    return done


def greedy_groups(nodes: DataFrame, edges: DataFrame, max_size: int, *, whole: int = 1 << 16) -> DataFrame:
    """C6 with a limit: (node, component, grp), grp being the group's smallest node.

    Nodes act in the order of their number of neighbours, equals in the order of ``nodes.place`` if there is such a column, then of
    the node. A node takes in the groups of its neighbours that have acted, the smallest first (of equals the one
    formed last), while the limit holds. Components of at most ``whole`` nodes and links are one task each; a larger one is
    never in one task and acts in rounds, as many as its longest chain of nodes that wait for each other.
    Links to oneself and repeated links do not count; nodes that occur only in links take part.
    """
    both = written(edges.select("a", "b").where("a <> b"), "greedy-edges")
    both = written(both.union(both.select("b", "a")).distinct(), "greedy-links")
    place = ["place"] if "place" in nodes.columns else []
    known = nodes.select("node", *place).union(both.select(F.col("a").alias("node"), *[F.lit(None).alias(p) for p in place]))
    known = known.groupBy("node").agg(F.min(place[0]).alias("place")) if place else known.distinct()
    degree = both.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"))
    known = known.join(degree, "node", "left").join(connected(known.select("node"), both.where("a < b")), "node").fillna(0, ["degree"])
    at = written(dense_position(known, "degree", *place, "node"), "greedy-nodes")
    of = lambda c: at.select(F.col("node").alias(c), F.col("pos").alias(f"p{c}"))
    links = written(both.join(at.select(F.col("node").alias("a"), F.col("pos").alias("pa"), "component"), "a").join(of("b"), "b")
                    .select("component", F.col("pa").alias("a"), F.col("pb").alias("b")), "greedy-links")
    total = at.agg(F.sum(F.col("degree") + 1)).first()[0] or 0
    size = at.groupBy("component").agg(F.sum(F.col("degree") + 1).alias("n"))
    large = written(size.where(F.col("n") > whole).select("component"), "greedy-large")
    got = _greedy_small(links.join(large, "component", "left_anti"), at.join(large, "component", "left_anti").select("component", "pos"), max_size,
                        1 + total // BUNDLE)
    if not large.isEmpty():
        got = got.union(_greedy_rounds(links.join(large, "component", "left_semi").select("a", "b"), at.join(large, "component", "left_semi"), max_size))
    named = at.join(written(got, "greedy-groups"), "pos")
    least = named.groupBy("grp").agg(F.min("node").alias("least"))
    return named.join(least, "grp").select("node", "component", F.col("least").alias("grp"))


def group_graph(nodes: DataFrame, edges: DataFrame, max_size: int | None = None) -> DataFrame:
    """(node, component, grp): a component is one group without a limit; with one, the greedy of :func:`greedy_groups`."""
    if max_size is None:
        return connected(nodes, edges).withColumn("grp", F.col("component"))
    return greedy_groups(nodes, edges, max_size)
