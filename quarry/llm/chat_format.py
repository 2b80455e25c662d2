"""Chat formatting: cumulative-snapshot collapse, then rendering, with DataFrame functions only.

Logs hold a conversation again and again as it grows. Every turn gets the rolling hash of its
conversation up to it (XOR of 64-bit hashes of place, role and text, with two seeds: 128 bits). A
conversation is a snapshot when its last hash is the hash of a proper prefix of another; an anti-join
against the distinct proper-prefix hashes retains the maximal ones. Of equal conversations the
smallest id stays.

The rolling hash runs over blocks of turns (a window inside a block, one over block totals), so one
conversation may hold any share of all rows. Rendered text comes in parts of ``PART`` turns a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Turn numbers of one block of the rolling hash.
BLOCK = 256
#: Turns of one rendered row.
PART = 512


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, place (1, 2, ... by turn, role, text; nulls first), role, text, and rolling hashes h1, h2.

    A repeated row counts once.
    """
    t = (turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").distinct()
         .withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-2**62))))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    t = t.withColumn("nth", F.row_number().over(inside))
    blocks = t.groupBy("conv_id", "block").agg(F.count("*").alias("size"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("past"))
    t = _same(t, blocks, ["conv_id", "block"]).withColumn("place", F.col("past") + F.col("nth"))
    for seed in (1, 2):
        t = t.withColumn(f"x{seed}", F.xxhash64(F.lit(seed), "place", F.coalesce(F.concat(F.lit("r"), "role"), F.lit("")),
                                                F.coalesce(F.concat(F.lit("t"), "text"), F.lit(""))))
    sums = t.groupBy("conv_id", "block").agg(F.bit_xor("x1").alias("b1"), F.bit_xor("x2").alias("b2"))
    sums = sums.select("conv_id", "block", *[F.coalesce(F.bit_xor(f"b{i}").over(before), F.lit(0)).alias(f"p{i}") for i in (1, 2)])
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumns({f"w{i}": F.bit_xor(f"x{i}").over(so_far) for i in (1, 2)})
    return _same(t, sums, ["conv_id", "block"]).select(
        "conv_id", "place", "role", "text", *[F.col(f"w{i}").bitwiseXOR(F.col(f"p{i}")).alias(f"h{i}") for i in (1, 2)])


def _same(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null; b's key columns go."""
    b = b.withColumnsRenamed({k: f"{k}__b" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"{k}__b")) for k in keys]
    return a.join(b, on, how).drop(*[f"{k}__b" for k in keys]) if how == "inner" else a.join(b, on, how)


def maximal(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(numbered turns, maximal conversations with conv_id, n_turns, n_copies)."""
    t = numbered(turns)
    size = t.groupBy("conv_id").agg(F.max("place").alias("n_turns"), F.max_by("h1", "place").alias("h1"), F.max_by("h2", "place").alias("h2"))
    whole = size.groupBy("n_turns", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    last = size.select("conv_id", "n_turns")
    proper = (_same(t.select("conv_id", "place", "h1", "h2"), last, ["conv_id"]).where("place < n_turns")
              .select(F.col("place").alias("n_turns"), "h1", "h2").distinct())
    return t, whole.join(proper, ["n_turns", "h1", "h2"], "left_anti").select("conv_id", "n_turns", "n_copies")


def collapse(turns: DataFrame) -> DataFrame:
    """conv_id, part, n_turns, n_copies, text: maximal conversations, rendered.

    A turn is rendered ``<|role|>``, a line break, the text and a line break; a null role is
    ``unknown``, a null text empty. Part k holds the turns k * PART + 1 to (k + 1) * PART. n_copies
    counts equal conversations. Rows of a null conv_id are one conversation. Other columns are ignored.
    """
    t, best = maximal(turns)
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    t = _same(t.select("conv_id", "place", line.alias("line")), best, ["conv_id"])
    t = t.withColumn("part", F.floor((F.col("place") - 1) / PART))
    return (t.groupBy("conv_id", "part", "n_turns", "n_copies")
            .agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("lines"))
            .select("conv_id", "part", "n_turns", "n_copies", F.array_join(F.col("lines.line"), "").alias("text")))


SQL = f"""
WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place
           FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)),
c AS (SELECT conv_id, count(*) AS n_turns, list({{'r': role, 't': text}} ORDER BY place) AS said FROM t GROUP BY conv_id),
w AS (SELECT min(conv_id) AS conv_id, n_turns, count(*) AS n_copies, said FROM c GROUP BY n_turns, said),
p AS (SELECT DISTINCT said[1:k] AS said FROM (SELECT said, unnest(range(1, n_turns)) AS k FROM w)),
m AS (SELECT * FROM w ANTI JOIN p ON w.said = p.said)
SELECT m.conv_id, CAST((place - 1) // {PART} AS BIGINT) AS part, n_turns, n_copies,
       string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY place) AS text
FROM m JOIN t ON m.conv_id IS NOT DISTINCT FROM t.conv_id
GROUP BY 1, 2, 3, 4
"""
