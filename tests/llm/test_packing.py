"""Packing: exact round trip, no gap, proportions of every window, odd rows."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm.packing import END, SEQUENCE, WINDOW, Mixture, cut_points, pack


def check(docs, **more):
    got = pack(docs, with_ids=True, **more).collect()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted(([*t.encode(r.text or "", add_special_tokens=False).ids, END] for r in docs.collect()), key=str)
    by, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.length == len(r.ids) > 0 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by[r.doc_id].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == SEQUENCE or at & (at - 1) == 0
    assert sorted(seqs) == list(range(len(seqs)))
    ids = []
    for parts in by.values():
        parts.sort(key=lambda r: (r.start, r.sequence_id))
        if len({(r.start) for r in parts}) == len(parts):
            assert [r.start for r in parts] == np.cumsum([0, *(r.length for r in parts)])[:-1].tolist()
            assert sum(r.length for r in parts) == parts[0].doc_tokens
            ids.append([x for r in parts for x in r.ids])
    if len(ids) == len(want):
        assert sorted(ids, key=str) == want
    else:                                                       # some ids repeat
        assert sum(len(r.ids) for r in got) == sum(map(len, want))
    return got


def test_whole_table(spark, sf):
    got = check(spark.read.parquet(f"{sf}/documents.parquet").repartition(5))
    total, size = sum(r.length for r in got), WINDOW * SEQUENCE
    by = defaultdict(lambda: defaultdict(int))
    for r in got:
        by[r.source][(r.sequence_id * SEQUENCE + r.offset) // size] += r.length
    for parts in by.values():
        share = sum(parts.values()) / total * size
        for w in range(total // size):
            assert abs(parts[w] - share) <= 2, (parts[w], share)


def test_odd_rows(make_docs):
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choices(["the", "é", "😀", "<|endoftext|>", "it's", "\x1c", " x", "é", "ΟΔΟΣ", "\t\nq", "Don'T", "#'s!", "<|STARTOFTEXT|>", "naïve,***", "x1Y2.3", "é's", "...", "'ll"], k=rnd.randrange(1, 300))), None,
             rnd.choice(["hot", "hot", "a", "b", None])) for i in range(300)]
    rows += [(900, None), (901, "", None, "tiny"), (902, "long words " * 20_000, None, "hot"), (903, "x" * 30_000, None, "b")]
    docs = make_docs(rows).withColumn("queue", F.lit(1)).withColumn("offset", F.lit("x")).repartition(7)
    check(docs)
    check(docs, weights={"hot": 1.0, "a": 5.0, "b": 1.0, "": 1.0, "tiny": 1.0})
    check(make_docs([(1, "a"), (1, "a"), (None, "b"), (1, "c d")]))
    assert pack(make_docs([])).count() == 0


def test_mixture_moves_on_and_loses_nothing():
    rnd = np.random.default_rng(4)
    for _ in range(30):
        sizes = rnd.integers(1, rnd.choice([3, 50, 100_000]), rnd.integers(1, 9))
        m = Mixture(sizes, rnd.random(len(sizes)) + 0.01, int(rnd.choice([1, 7, 4096])))
        w = np.unique(rnd.integers(0, m.total // m.window + 2, 400))
        sent = m.sent_before(w)
        assert (np.diff(sent, axis=0) >= 0).all() and (sent.sum(axis=1) == np.minimum(w * m.window, m.total)).all()
        for q, size in enumerate(sizes):
            cuts = np.unique(np.concatenate([[0, size], rnd.integers(0, size + 1, 5)]))
            row, start, length, _ = m.place(np.full(len(cuts) - 1, q), cuts[:-1], np.diff(cuts))
            assert np.bincount(row, length).astype(int).tolist() == np.diff(cuts).tolist()


def test_cut_points():
    assert cut_points(4096 * 2 + 13).tolist() == [8192, 8200, 8204, 8205] and cut_points(8192).tolist() == [8192]
