"""Language-model scores: base by brute force, the coder against a scalar model, held-out quality, odd rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import lm
from quarry.llm.lm import Model, score, train


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))


def brute_force(rows):
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    c = Counter()
    for (_, t), h in zip(rows, held):
        if not h:
            c.update(words(t))
            c["", "end"] += 1
    n, v = sum(c.values()), len(c)
    out = []
    for (i, t), h in zip(rows, held):
        w = [*words(t), ("", "end")]
        out.append((i, h, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)))
    return out


def check(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(score(docs).collect(), key=lambda r: (str(r.doc_id), r.n_tokens, r.base_score))
    want = sorted(brute_force(rows), key=lambda r: (str(r[0]), r[2], r[5]))
    for g, w in zip(got, want, strict=True):
        assert (g.doc_id, g.held_out, g.n_tokens, g.n_known, g.train_tokens) == w[:5]
        assert abs(g.base_score - w[5]) < 1e-6 * max(1, abs(w[5])) and math.isfinite(g.score) and g.score < 0
    return got


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = check(docs)
    held = [r for r in got if r.held_out]
    n_bytes = sum(len(r.text.encode()) for r in docs.join(docs.sparkSession.createDataFrame([(r.doc_id,) for r in held], "doc_id long"), "doc_id").collect())
    assert -sum(r.score for r in held) * math.log2(10) / n_bytes < 2.8
    again = {r.doc_id: r.score for r in score(docs.repartition(7)).collect()}
    assert all(abs(again[r.doc_id] - r.score) <= 1e-6 * abs(r.score) for r in got)     # whatever rows stand beside it


def scalar(model: Model, text: str) -> float:
    """The same model, one decision after the other."""
    a, total = model.alphabet, 0.0
    data = text.encode()
    sym = [*(int(a.cls[b]) for b in data), 0]
    rows = lm._rows(np.array(sym), np.array([0, len(sym)]), model.white)
    for at, s in enumerate(sym):
        if at % lm.SEGMENT == 0:
            w = {g: [lm._START] * len(lm.CONTEXTS) for g in range(lm._GATES)}
            r = {g: [1 / (1 + math.exp(-(i - (lm._BINS - 1) / 2) * 16 / lm._BINS)) for i in range(lm._BINS)] for g in range(lm._GATES)}
        for k in range(a.begin[s], a.begin[s] + a.length[s]):
            g, bit, node = int(a.meta[k]) >> 1, int(a.meta[k]) & 1, a.node[k]
            x = [int(model.table[row[at], node]) / lm._SCALE for row in rows]
            z = min(7.99, max(-7.99, sum(p * q for p, q in zip(w[g], x))))
            p = 1 / (1 + math.exp(-z))
            i = int(z * lm._BINS / 16 + lm._BINS / 2)
            mix = (p + r[g][i]) / 2
            total += math.log10(mix if bit else 1 - mix)
            r[g][i] += (bit - r[g][i]) * 0.02
            w[g] = [p0 + lm._RATE * (bit - p) * x0 for p0, x0 in zip(w[g], x)]
        if at < len(data):
            total += a.rest[data[at]]
    return total


def test_coder_by_hand(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = train(docs.where("doc_id % 2 = 0"))
    texts = [r.text for r in docs.orderBy(F.length("text")).limit(20).collect()] + ["", "é\x00\xff 漢字 unseen", "the " * 600]
    data = [t.encode() for t in texts]
    got = lm._code(model, np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    want = [scalar(model, t) for t in texts]
    assert np.allclose(got, want, rtol=2e-4, atol=2e-4)


def test_tree_is_a_code():
    n = np.zeros(256, np.int64)
    n[97:117] = np.arange(20) ** 3
    a = lm.Alphabet(n, 5)
    assert abs(sum(0.5 ** k for k in a.length) - 1) < 1e-12 and a.length[a.cls[116]] < a.length[a.cls[98]]
    assert abs((10 ** a.rest[a.cls == lm.CLASSES - 1]).sum() - 1) < 1e-9


def test_odd_rows(make_docs):
    rows = [(i, t) for i, t in enumerate([None, "", " \n", "A b a", "end", "x" * 100_000, "é " * 3000, "😀"] * 4)] + [(None, "a b"), (3, "A b a"), (3, "A b a")]
    check(make_docs(rows).withColumn("score", F.lit(1)).withColumn("word", F.lit("x")).withColumn("key", F.lit(2)))
    assert score(make_docs([])).count() == 0
    alone = [i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    got = check(make_docs([(i, "only held out") for i in alone]))
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in got)


def test_contexts_are_counted_by_themselves(spark, make_docs):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789éß漢"), 40_000)) for _ in range(8)]
    model = train(make_docs(list(enumerate(texts))))
    want = Counter()
    for t in texts:
        sym = [0] * 5 + [int(model.alphabet.cls[b]) for b in t.encode()] + [0]
        want.update(tuple(sym[i - 5:i + 1]) for i in range(5, len(sym)))
    table = model.table
    kind = table.cells >> 61 == lm.CONTEXTS.index(5)
    assert kind.sum() == len(want) > 1 << 17 and sorted(np.diff(table.total)[kind]) == sorted(want.values())
    assert len(set(model.alphabet.cls)) == 256


def test_minority_script_is_learned(spark, make_docs):
    han, plain = "漢字仮名交じり文の例。" * 30, "".join(chr(33 + i % 94) for i in range(9000))
    rows = [(i, plain) for i in range(0, 60, 2)] + [(i, han) for i in range(1, 60, 2)]
    got = score(make_docs(rows)).where("held_out and doc_id % 2 = 1").collect()
    assert got and all(r.bits_per_byte < 0.5 for r in got)


def test_parts_make_the_model_of_one_place(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.score for r in score(docs).collect()}
    rows = docs.collect()
    model = train(docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2))
    data = [(r.text or "").encode() for r in rows]
    want = lm._code(model, np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    assert all(abs(got[r.doc_id] - w) <= 1e-6 * abs(w) for r, w in zip(rows, want))


def test_one_adaptive_pass_a_text(spark, sf):
    """Weights and map go on through the whole text: 3,000 symbols against the same model by hand."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = train(docs.where("doc_id % 2 = 0"))
    a, text = model.alphabet, "qzx kwv " * 300 + "the same words again and again " * 20
    data = text.encode()
    sym = [*(int(a.cls[b]) for b in data), 0]
    rows = lm._rows(np.array(sym), np.array([0, len(sym)]), model.white)
    grid = [1 / (1 + math.exp(-(i - (lm._BINS - 1) / 2) * 16 / lm._BINS)) for i in range(lm._BINS)]
    w, r, total = {g: [lm._START] * 4 for g in range(lm._GATES)}, {g: list(grid) for g in range(lm._GATES)}, 0.0
    for at, s in enumerate(sym):
        for k in range(a.begin[s], a.begin[s] + a.length[s]):
            g, bit = int(a.meta[k]) >> 1, int(a.meta[k]) & 1
            x = [int(model.table[row[at], a.node[k]]) / lm._SCALE for row in rows]
            z = min(7.99, max(-7.99, sum(p * q for p, q in zip(w[g], x))))
            p = 1 / (1 + math.exp(-z))
            i = int(z * lm._BINS / 16 + lm._BINS / 2)
            total += math.log10(abs((p + r[g][i]) / 2 + bit - 1))
            r[g][i] += (bit - r[g][i]) * 0.02
            w[g] = [p0 + lm._RATE * (bit - p) * x0 for p0, x0 in zip(w[g], x)]
    got = lm._code(model, np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0]
    assert abs(got - total) < 2e-4 * abs(total)


def test_what_crosses_the_network_is_small(spark, make_docs, monkeypatch):
    """Two parts in four buckets: under 5 bytes a cell to the buckets, under 4 back, and the odds of the model of one place."""
    import pyarrow as pa
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choice(words, 900)) for _ in range(24)] + ["", "a" * 4000]
    model = train(make_docs(list(enumerate(texts))))
    parts = [pa.table({"text": texts[i::2], "held_out": [False] * 13}) for i in range(2)]
    sent = [lm._part_cells(model.alphabet, model.white, 4)((pa.scalar(i),), t) for i, t in enumerate(parts)]
    n = sum(len(lm._cells(model.alphabet, model.white, *lm.text_buffer(t.column("text")))[0]) for t in parts)
    assert sum(len(x) for t in sent for c in ("cells", "n") for x in t.column(c).to_pylist()) < 5 * n
    rows = pa.concat_tables(sent)
    back = pa.concat_tables([lm._bucket_odds(model.alphabet)(rows.filter(pa.compute.equal(rows.column("bucket"), b))) for b in range(4)])
    assert "cells" not in back.column_names and sum(map(len, back.column("odds").to_pylist())) < 4 * n

    class Common:
        value = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    monkeypatch.setattr(lm, "LOOP", 20_000)
    for i, t in enumerate(parts):
        t = t.append_column("doc_id", pa.array(range(i, 26, 2)))
        got = lm._score(model.alphabet, model.white, Common, 4)((pa.scalar(i),), t, back.filter(pa.compute.equal(back.column("part"), i)))
        want = lm._code(model, *lm.text_buffer(t.column("text")))
        assert np.allclose([s for _, s in sorted(zip(got.column("doc_id").to_pylist(), got.column("score").to_pylist()))], want, rtol=1e-6)


def test_a_part_takes_little_memory(spark, make_docs):
    """A worker holds less than 30 bytes for each byte of its part's texts at once."""
    import tracemalloc

    import pyarrow as pa
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choice(words, rng.integers(100, 500))) for _ in range(2500)]
    n = sum(map(len, texts))
    model = train(make_docs(list(enumerate(texts[:50]))))
    part = pa.table({"doc_id": range(len(texts)), "text": texts, "held_out": [i % 7 == 2 for i in range(len(texts))]})

    class Common:
        value = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def peak(run):
        tracemalloc.start()
        try:
            return run(), tracemalloc.get_traced_memory()[1] / n
        finally:
            tracemalloc.stop()
    sent, most = peak(lambda: lm._part_cells(model.alphabet, model.white, 1)((pa.scalar(0),), part))
    assert most < 30
    back = lm._bucket_odds(model.alphabet)(sent)
    got, most = peak(lambda: lm._score(model.alphabet, model.white, Common, 1)((pa.scalar(0),), part, back))
    assert most < 30 and got.num_rows == len(texts)
