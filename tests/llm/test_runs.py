"""Periodic runs: brute force over all periods on random, periodic and Fibonacci words; whole tables; odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w):
    """All runs, by comparing the words with themselves at every distance."""
    n, out = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(12, 2 * q):
                s, e = i, j + q
                if not any(w[s:e - d] == w[s + d:e] for d in range(1, q)):
                    out[s, e] = q
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def twin(doc_id, text):
    w = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode() if doc_id is not None else b""), len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    found = brute(w)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest(),
            hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


def sequence(rng):
    kind, n = rng.randint(0, 5), rng.randint(0, 90)
    if kind < 2:
        return [rng.randint(0, kind + 1) for _ in range(n)]
    if kind == 2:
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    if kind == 3:
        base = [rng.randint(0, 3) for _ in range(rng.randint(1, 20))]
        w = [base[i % len(base)] for i in range(n)]
        for _ in range(rng.randint(0, 2) if n else 0):
            w[rng.randrange(n)] = 9
        return w
    m = rng.randint(1, 40)
    if kind == 4:
        return ([0, 1] * m)[:rng.randint(0, 2 * m)] + ([0, 1] * m)[:rng.randint(0, 2 * m)] + ([0, 0, 1] * m)[:rng.randint(0, 30)]
    w = [rng.randint(0, 5) for _ in range(n)]
    return w[:10] + w[10:22] * 3 + w[22:]


def test_against_brute_force():
    rng = random.Random(7)
    seen = 0
    for _ in range(600):
        texts = [sequence(rng) for _ in range(rng.randint(1, 4))]
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        a, b, q = runs.find_runs(np.array([x for t in texts for x in t], np.int64), at)
        want = [(s + int(at[i]), m, p) for i, t in enumerate(texts) for s, m, p in brute(t)]
        assert list(zip(a.tolist(), (b - a).tolist(), q.tolist())) == want
        seen += len(want)
    assert seen > 2000


def test_successor():
    rng = np.random.default_rng(3)
    values = rng.permutation(200)
    tree = runs.WaveletTree(values, 200)
    left = rng.integers(0, 200, 500)
    right = np.minimum(left + rng.integers(0, 30, 500), 200)
    x = rng.integers(0, 300, 500)
    want = [min((v for v in values[i:j] if v >= y), default=-1) for i, j, y in zip(left, right, x)]
    assert tree.successor(left, right, x).tolist() == want


def test_long_periods():
    base = np.random.default_rng(1).integers(0, 500, 40_000)
    a, b, q = runs.find_runs(np.concatenate([[900], np.tile(base, 3), [901]]), np.array([0, 120_002]))
    assert (a.tolist(), b.tolist(), q.tolist()) == ([1], [120_001], [40_000])
    a, b, q = runs.find_runs(np.zeros(300_000, np.int64), np.array([0, 100_000, 300_000]))
    assert list(zip(a.tolist(), b.tolist(), q.tolist())) == [(0, 100_000, 1), (100_000, 300_000, 1)]


def key(r):
    return tuple((x is None, x) for x in r)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    rows = [r for r in rows if len(r[1]) < 12_000]
    got = {r.doc_id: tuple(r) for r in runs.report(docs).collect()}
    assert len(got) == docs.count() and [got[i] for i, _ in rows] == [twin(i, t) for i, t in rows]
    assert sum(got[i][1] > 0 for i, _ in rows) > 5


def test_odd_rows(make_docs):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b " * 6), (5, "a\tb\n" * 500), (5, "x"), (5, "x"), (None, "null id words " * 9),
            (6, "ä 漢 𝒳 " * 8 + "end"), *[(i, "the same words " * 7 + f"and {i}") for i in range(100, 140)], (7, "no run here")]
    docs = make_docs(rows).withColumn("start", F.lit("x")).withColumn("period", F.lit(1))
    got = [tuple(r) for r in runs.report(docs).collect()]
    assert sorted(got, key=key) == sorted([twin(i, t) for i, t, *_ in rows], key=key)
    assert runs.report(make_docs([])).count() == 0


def test_collapsed_texts(make_docs):
    got = {r.doc_id: r for r in runs.collapse(make_docs([(1, "go on  " + "a b c " * 5 + "a end"), (2, "plain\ntext"), (3, None)])).collect()}
    assert got[1].text == "go on a b c end" and [tuple(r) for r in got[1].runs] == [(2, 16, 3)]
    assert got[2].text == "plain text" and got[2].runs == [] and got[3].text == ""
