"""Near-duplicates against a brute-force model over all pairs."""

import random
import re

from pyspark.sql import functions as F

from quarry.llm.components import components
from quarry.llm.minhash_dedup import deduplicate


def shingles(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def brute_force(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            both = len(a & b)
            if a and b and 100 * both >= 75 * (len(a) + len(b) - both):
                x, y = sorted((top(i), top(j)))
                up[y] = x
    return {(i, len(s), top(i), top(i) == i) for i, s in sets}


def result(df):
    return {tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()}


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert result(deduplicate(docs)) == brute_force(rows)


def test_chains_thresholds_and_shared_passages(make_docs):
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(4000)]
    passage = rnd.choices(words, k=60)
    rows, n = [], 0
    for g in range(30):
        base = rnd.choices(words, k=rnd.choice([12, 40, 90, 200]))
        for _ in range(8):
            rows.append((n, " ".join(base)))
            base = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2])):       # a chain: each is an edit of the one before
                base[rnd.randrange(len(base))] = rnd.choice(words)
            n += 1
        for _ in range(6):                                  # all share a passage, few are alike
            rows.append((n, " ".join(passage + rnd.choices(words, k=rnd.choice([5, 10, 15, 20, 60])))))
            n += 1
    rnd.shuffle(rows)
    assert result(deduplicate(make_docs(rows))) == brute_force(rows)


def test_odd_rows(make_docs, spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "Same Words"), (5, "same\x0bwords"), (6, "other words"),
            (7, "a b c d e"), (8, "A B C D E"), (9, "a b c d"), (10, "é É x y z"), (11, "É É x y z"), (4, "Same Words"),
            (12, "x y z a b")]
    long = " ".join(f"t{i}" for i in range(60_000))
    rows += [(20, long), (21, long + " end"), (22, "x" * 300_000)]
    docs = make_docs([*rows, (None, "same words")]).withColumn("node", F.lit(1)).withColumn("n", F.lit("x"))
    got = deduplicate(docs).collect()
    assert len(got) == len(rows) + 1
    by = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got}
    assert by[1] == (0, 1, True) and by[2] == (0, 2, True) and by[3] == (0, 3, True)
    assert by[4] == (1, 4, True) and by[5] == (1, 4, False) and by[6] == (1, 6, True)
    assert by[8] == (1, 7, False) and by[9] == (1, 9, True) and by[11][1] == 11 and by[12] == (1, 12, True)
    assert by[21][1] == 20 and not by[21][2] and by[22] == (1, 22, True)
    assert by[None] == (1, None, True)
    assert deduplicate(make_docs([])).count() == 0


def test_components(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + rnd.randrange(1, 200)) for _ in range(80)] + [(500, 500), (7, None)]
    rnd.shuffle(edges)
    got = {tuple(r) for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    star = {100, *(v for u, v in edges if u == 100)}
    assert got == {(i, 0) for i in range(41)} | {(i, 100) for i in star}
