"""BM25 top-k against scoring of all rows."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from quarry.llm import bm25_search
from quarry.llm.bm25_search import search, search_hundredth


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))


def brute_force(rows, queries, k=10):
    bags = [(i, Counter(words(t))) for i, t in rows]
    df = Counter(w for _, b in bags for w in b)
    n, mean = len(bags), sum(sum(b.values()) for _, b in bags) / max(len(bags), 1) or 1.0
    asked = {}
    for i, t in queries:
        if i is not None:
            asked.setdefault(i, Counter()).update(words(t))
    out = set()
    for q, bag in asked.items():
        scored = []
        for i, b in bags:
            size = sum(b.values())
            s = sum(round(1e6 * (f * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * (b[w] * 2.2 / (b[w] + 1.2 * (1 - 0.75 + 0.75 * size / mean)))))
                    for w, f in bag.items() if w in b)
            if s:
                scored.append((-s, i is None, i))
        out |= {(q, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)}
    return out


def compare(got, want):
    got = {(r.query_id, r["rank"]): (r.doc_id, r.score * 1e6) for r in got.collect()}
    want = {(q, r): (i, s) for q, r, i, s in want}
    assert got.keys() == want.keys()
    for key, (i, s) in want.items():
        assert got[key][0] == i and abs(got[key][1] - s) <= 5, (key, got[key], want[key])


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    compare(search_hundredth(docs), brute_force(rows, [r for r in rows if r[0] % 100 == 0]))


def test_shards_blocks_and_ties(make_docs, monkeypatch):
    rnd = random.Random(6)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rnd.choices(vocabulary, weights=[1 / (j + 1) for j in range(300)], k=rnd.randrange(1, 60)))) for i in range(900)]
    rows += [(1000 + i, rows[5][1].upper()) for i in range(30)]
    for block, shard, entries in ((4, 4000, 64), (64, 1 << 20, 1 << 20)):
        monkeypatch.setattr(bm25_search, "BLOCK", block)
        monkeypatch.setattr(bm25_search, "SHARD", shard)
        monkeypatch.setattr(bm25_search, "QUERY_BLOCK", entries)
        docs = make_docs(rows).repartition(3)
        queries = [(i, rows[i][1]) for i in range(0, 40)]
        compare(search(docs, make_docs(queries)), brute_force(rows, queries))


def test_pruning_skips_blocks():
    import numpy as np
    from quarry.llm.bm25_search import Shard
    n = 64 * 50
    docs = np.arange(n, dtype=np.int32)
    tf = np.ones(n, np.int32)
    tf[:20] = 50
    blobs = [np.arange(n), np.ones(n, np.int8), np.full(n, 60, np.int32), np.array([7], np.uint64), np.array([0, n]), docs, tf]
    kinds = [np.int64, np.int8, np.int32, np.uint64, np.int64, np.int32, np.int32]
    shard = Shard([b.astype(k).tobytes() for b, k in zip(blobs, kinds)], 60.0)
    read = []
    part = shard.part

    class Spy(np.ndarray):
        def __getitem__(self, at):
            read.append(np.size(at))
            return np.asarray(self).__getitem__(at)
    shard.part = part.view(Spy)
    rows, _ = shard.search(np.array([7], np.uint64), np.array([1.0]), 10)
    assert sorted(rows) == list(range(10)) and sum(read) < n / 5


def test_odd_rows(make_docs):
    rows = [(0, None), (100, ""), (200, " \t"), (300, "One two"), (301, "one"), (302, "ONE one é"), (303, "é"), (None, "one"), (400, "x " * 30_000 + "two"),
            (301, "one"), (500, "unseen")]
    docs = make_docs(rows).withColumn("score", F.lit(1)).withColumn("term", F.lit("x")).withColumn("rank", F.lit(0))
    compare(search_hundredth(docs), brute_force(rows, [r for r in rows if r[0] is not None and r[0] % 100 == 0]))
    assert search_hundredth(make_docs([])).count() == 0
    assert search_hundredth(make_docs([(100, None)])).count() == 0


def test_bound_of_earlier_rounds():
    """With another round's k-th score as its bound, a shard returns only rows that reach it, its ties included."""
    import numpy as np
    from quarry.llm.bm25_search import Shard
    n = 64 * 20
    tf = np.arange(n) % 97 + 1
    blobs = [np.arange(n), np.ones(n, np.int8), np.full(n, 100, np.int32), np.array([7], np.uint64), np.array([0, n]), np.arange(n), tf]
    kinds = [np.int64, np.int8, np.int32, np.uint64, np.int64, np.int32, np.int32]
    shard = Shard([b.astype(k).tobytes() for b, k in zip(blobs, kinds)], 100.0)
    term, weight = np.array([7], np.uint64), np.array([1.0])
    rows, scores = shard.search(term, weight, 10)
    floor = np.sort(scores)[-4]
    some, high = shard.search(term, weight, 10, floor)
    assert set(some) == set(rows[scores >= floor]) and (high >= floor).all() and len(some) >= 4
    assert len(shard.search(term, weight, 10, scores.max() + 1)[0]) == 0


def test_long_queries_are_taken_together(make_docs):
    """Many long queries of one shard: the rows and scores of the visits by bounds, from far fewer postings."""
    import numpy as np
    import pyarrow as pa
    from quarry.llm.bm25_search import Shard
    rng = np.random.default_rng(4)
    chance = 1 / np.arange(1, 2001)
    texts = [" ".join(f"w{j}" for j in rng.choice(2000, 120, p=chance / chance.sum())) for _ in range(640)]
    (blobs,) = bm25_search._index(iter([pa.RecordBatch.from_arrays([pa.array(range(640)), pa.array(texts)], ["doc_id", "text"])]))
    row, term, tf, _ = bm25_search._counted(pa.RecordBatch.from_arrays([pa.array(texts[:64] + ["w1999 w5"])], ["text"]))
    begins, weight = np.searchsorted(row, np.arange(66)), tf * rng.uniform(0.1, 9, len(tf))
    shard = Shard([blobs.column(c)[0].as_buffer() for c in bm25_search._BLOBS], 120.0)
    place = np.searchsorted(shard.terms, term)
    floors, products = np.zeros(65), np.diff(shard.begins)[place].sum()
    for _ in range(2):
        want = [shard.search(term[a:b], weight[a:b], 10, f) for a, b, f in zip(begins[:-1], begins[1:], floors)]
        read = []

        class Spy(np.ndarray):
            def __getitem__(self, at):
                read.append(np.size(at))
                return np.asarray(self).__getitem__(at)
        part, shard.part = shard.part, shard.part.view(Spy)
        got = shard.search_all(begins, place, weight, 10, floors)
        shard.part = part
        assert all(dict(zip(*g)) == dict(zip(*w)) for g, w in zip(got, want, strict=True))
        assert sum(read) < products / 4
        floors = np.array([s.min() if len(s) == 10 else 0.0 for _, s in got])
