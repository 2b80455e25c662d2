"""Snapshot collapse against a brute-force prefix test."""

import random

from pyspark.sql import functions as F

from quarry.llm import chat_format
from quarry.llm.chat_format import collapse

SCHEMA = "conv_id long, turn long, role string, text string"


def brute_force(rows):
    by = {}
    for c, t, r, x in set(rows):
        by.setdefault(c, []).append((t is not None, t or 0, r is not None, r or "", x is not None, x or "", r, x))
    said = {c: tuple(y[-2:] for y in sorted(v, key=lambda y: y[:6])) for c, v in by.items()}
    out = set()
    for c, s in said.items():
        same = [d for d in said if said[d] == s]
        if any(len(o) > len(s) and o[:len(s)] == s for o in said.values()) or min(same, key=lambda d: (d is None, d)) != c:
            continue
        out.add((c, len(s), len(same), "".join(f"<|{r or 'unknown'}|>\n{x or ''}\n" for r, x in s)))
    return out


def result(df):
    return {(r.conv_id, r.n_turns, r.n_copies, r.text) for r in df.collect()}


def test_whole_table(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    assert result(collapse(turns)) == brute_force([tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()])


def test_snapshots_ties_nulls(spark):
    rnd = random.Random(1)
    rows = []
    for c in range(60):
        line = [(rnd.choice(["user", "assistant", None]), rnd.choice(["hi", "", None, "ok"])) for _ in range(rnd.randrange(1, 4))]
        rows += [(c, i, r, x) for i, (r, x) in enumerate(line)]
    rows += [(90, 0, "user", "a"), (90, 0, "user", "a"), (90, None, "user", "b"), (91, 5, "user", "a"), (91, 900, "user", "z" * 100_000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("place", F.lit(1)).withColumn("h1", F.lit("x"))
    assert result(collapse(df)) == brute_force(rows)
    assert collapse(spark.createDataFrame([], SCHEMA)).count() == 0


def test_null_conversation_and_parts(spark):
    rows = [(None, 0, "user", "only here"), (1, 0, "user", "x")] + [(2, i, "user", f"t{i}") for i in range(2000)] + [(3, i, "user", f"t{i}") for i in range(700)]
    got = collapse(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", "part").collect()
    assert [(r.conv_id, r.part) for r in got] == [(None, 0), (1, 0), (2, 0), (2, 1), (2, 2), (2, 3)]
    whole = "".join(r.text for r in got if r.conv_id == 2)
    assert whole == "".join(f"<|user|>\nt{i}\n" for i in range(2000)) and got[2].text.count("<|user|>") == chat_format.PART
