"""Near-duplicate documents: MinHash with banding, verification, and connected components.

1. One pass over the texts takes each document's set of distinct 5-word shingles (64-bit hashes), the
   ``MINIMA`` minima of universal hashes over it, band keys of the first ``BANDS * ROWS`` of them, four
   bits of each (the sketch) and a 128-bit fingerprint of the set. The small signature table goes to the
   shared folder.
2. Documents of the same set are one class, found by a grouped minimum; only the smallest document of
   a class goes on, so copies never meet in a bucket.
3. Bucket members are first paired with the smallest and the largest member of their bucket, found by
   aggregation. Pairs whose set sizes or sketches rule out the similarity go; the others are confirmed
   on full shingle sets. Links give components by large-star / small-star.
4. Buckets that still hold several components are gone through completely: their members are dealt
   to cells of bounded size and every pair of members of different components is held against sizes
   and sketches, then confirmed on full sets. Pairs inside one component need no look: they cannot
   change a component.

A pair at similarity 0.75 shares no band with probability (1 - 0.75^4)^32 = 5e-6, and fails the sketch
(over ``SKETCH_MAX`` of 768 minima differ) with probability 3e-8; both fall quickly above it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, id_and_text, mix64, slices, small_batches, stored, text_buffer
from .components import components

WORDS = 5
BANDS, ROWS = 32, 4
MINIMA = 768
#: Minima whose four bits may differ; 180 are expected at similarity 0.75, with a deviation of 11.7.
SKETCH_MAX = 243
#: The same for the first minima alone (45 expected, deviation 5.9), which settle most pairs.
FIRST, FIRST_MAX = 192, 77
#: Members of a bucket that one side of a cell holds, on average.
CELL = 512

_RNG = np.random.default_rng(20240501)
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]                                   # A-Z as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(int(_P), -1, 2**64))
_WORD = _RNG.integers(0, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A = _RNG.integers(0, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, MINIMA, dtype=np.uint64)


def _powers(n: int, base: np.uint64, kept: dict = {}) -> np.ndarray:  # noqa: B006 - kept between slices
    if int(base) not in kept or len(kept[int(base)]) < n:
        p = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        p[0] = 1
        kept[int(base)] = np.cumprod(p)
    return kept[int(base)][:n]


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts in a buffer, and where each text's words begin."""
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = ~_SPACE[buf]
    filled = offsets[1:] > offsets[:-1]
    before = np.zeros(len(buf), bool)
    before[1:] = word[:-1]
    before[offsets[:-1][filled]] = False
    after = np.zeros(len(buf), bool)
    after[:-1] = word[1:]
    after[offsets[1:][filled] - 1] = False
    start = np.flatnonzero(word & ~before)
    end = np.flatnonzero(word & ~after) + 1
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * _powers(len(buf), _P), out=total[1:])
    h = mix64((total[end] - total[start]) * _powers(len(buf), _P_INV)[start])
    return h, np.searchsorted(start, offsets)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and where each text's begin."""
    h, at = word_hashes(buf, offsets)
    n = np.diff(at)
    full = np.maximum(n - (WORDS - 1), 0)
    short = (n > 0) & (n < WORDS)
    size = np.where(short, 1, full)
    cut = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(cut[-1], np.uint64)
    if len(h) >= WORDS:
        m = len(h) - WORDS + 1
        rolled = sum((h[k:m + k] * _WORD[k] for k in range(1, WORDS)), h[:m] * _WORD[0])
        inside = np.zeros(len(h) + 1, np.int64)
        np.add.at(inside, at[:-1][full > 0], 1)
        np.add.at(inside, (at[:-1] + full)[full > 0], -1)
        out[np.repeat(~short, size)] = rolled[np.cumsum(inside)[:m] > 0]
    for k in range(1, WORDS):
        which = np.flatnonzero(n == k)
        if len(which):
            out[cut[which]] = sum((h[at[which] + j] * _WORD[j] for j in range(k)), np.full(len(which), np.uint64(k)))
    out = mix64(out)
    for a, b in zip(cut[:-1], cut[1:]):
        if b - a > 1:
            out[a:b].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[cut[:-1][size > 0]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], kept[cut]


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.reshape(-1)))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            s, at = shingle_sets(*text_buffer(part.column("text")))
            n = np.diff(at)
            some = np.flatnonzero(n)
            low = np.zeros((MINIMA, part.num_rows), np.uint32)
            if len(some):
                first = at[:-1][some]
                for k in range(MINIMA):
                    low[k, some] = np.minimum.reduceat(((s * _A[k] + _B[k]) >> np.uint64(32)).astype(np.uint32), first)
            wide = low[:BANDS * ROWS].astype(np.uint64).reshape(BANDS, ROWS, -1)
            key = np.arange(BANDS, dtype=np.uint64)[:, None] + np.uint64(1)
            for r in range(ROWS):
                key = mix64(key * _P + wide[:, r])
            # four bits of each minimum, as bit planes: four words hold 64 minima
            planes = [np.packbits(np.ascontiguousarray((low >> b & 1).T.astype(np.uint8)), axis=1).view(np.int64) for b in range(4)]
            sketch = np.stack(planes, axis=2).reshape(part.num_rows, -1)
            print_1, print_2 = np.zeros((2, part.num_rows), np.uint64)
            if len(some):
                print_1[some] = np.add.reduceat(mix64(s), first)
                print_2[some] = np.add.reduceat(mix64(s + _P), first)
            keys = _lists(np.ascontiguousarray(key.T).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n), pa.array(print_1.view(np.int64)), pa.array(print_2.view(np.int64)),
                 _lists(sketch), keys],
                ["doc_id", "n", "print_1", "print_2", "sketch", "bands"])


def signatures(docs: DataFrame) -> DataFrame:
    """One row a document: set size, set fingerprint, sketch and band keys."""
    small_batches(docs.sparkSession)
    return id_and_text(docs).select("doc_id", "text").mapInArrow(
        _sign, "doc_id long, n long, print_1 long, print_2 long, sketch array<long>, bands array<long>")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            s, at = shingle_sets(*text_buffer(part.column("text")))
            at8 = pa.array(at * 8, pa.int64())
            data = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, at8.buffers()[1], pa.py_buffer(s.tobytes())])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), data.cast(pa.binary())], ["node", "shingles"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = np.zeros(batch.num_rows, bool)
        for i, (a, b) in enumerate(zip(batch.column("sa"), batch.column("sb"))):
            a = np.frombuffer(a.as_buffer(), np.uint64)
            b = np.frombuffer(b.as_buffer(), np.uint64)
            if len(a) > len(b):
                a, b = b, a
            both = int(np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a))
            ok[i] = 100 * both >= 75 * (len(a) + len(b) - both)
        yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(ok))


def _sketches(rows: DataFrame) -> DataFrame:
    """node, n, bands, and the words of the sketch as columns, which a join condition reads without detours."""
    return rows.select("node", "n", "bands", *[F.col("sketch")[i].alias(f"s{i}") for i in range(MINIMA // 16)])


def _may_link(a: str, b: str):
    """Sizes and sketches of the two sides allow the similarity."""
    def differ(g):
        return "bit_count(" + " | ".join(f"({a}.s{i} ^ {b}.s{i})" for i in range(4 * g, 4 * g + 4)) + ")"
    sizes = f"100 * least({a}.n, {b}.n) >= 75 * greatest({a}.n, {b}.n)"
    first, rest = (" + ".join(map(differ, r)) for r in (range(FIRST // 64), range(FIRST // 64, MINIMA // 64)))
    return F.expr(f"{sizes} and {first} <= {FIRST_MAX} and {first} + {rest} <= {SKETCH_MAX}")


def _confirmed(pairs: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """The pairs (u, v) that hold on full shingle sets, written."""
    nodes = pairs.select(F.col("u").alias("doc_id")).union(pairs.select(F.col("v").alias("doc_id"))).distinct()
    # The same plan at every size: texts meet the wanted ids in a shuffle, whichever of the two is small.
    sets = stored(id_and_text(docs).join(nodes.hint("shuffle_merge"), "doc_id", "left_semi").select("doc_id", "text")
                  .mapInArrow(_sets, "node long, shingles binary"), f"{name}-sets")
    both = (pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("sa")), "u")
            .join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("sb")), "v"))
    links = stored(both.select("u", "v", "sa", "sb").mapInArrow(_confirm, "u long, v long").distinct(), f"{name}-links")
    forget(sets)
    return links


def deduplicate(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest id reachable by links), kept.

    Words are runs of other than space and control white space, A-Z in lower case. Texts that are
    null, empty or without words have an empty set and link with nothing; fewer than five words are one
    shingle. Rows with equal ids are one node: they are linked by whichever of their texts is.
    A null id links with nothing, has a null component and is kept. Other columns are ignored.
    """
    sig = stored(signatures(docs), "minhash-signatures")
    copies = stored(sig.where("n > 0 and doc_id is not null").groupBy("n", "print_1", "print_2")
                    .agg(F.min("doc_id").alias("node"), F.count("*").alias("size")).where("size > 1").drop("size"), "minhash-copies")
    named = sig.where("n > 0 and doc_id is not null").join(copies, ["n", "print_1", "print_2"], "left")
    slim = ["n", "sketch", "bands"]
    rows = stored(named.where("node is null").select(F.col("doc_id").alias("node"), *slim)
                  .union(named.where("node = doc_id").dropDuplicates(["n", "print_1", "print_2"]).select("node", *slim)), "minhash-nodes")

    members = rows.select("node", F.explode("bands").alias("key"))
    buckets = (members.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("size"))
               .where("low < high"))
    inside = stored(members.join(buckets, "key"), "minhash-members")
    stars = (inside.select("node", F.explode(F.array("low", "high")).alias("hub")).where("node <> hub")
             .select(F.least("node", "hub").alias("u"), F.greatest("node", "hub").alias("v")).distinct())
    sketches = _sketches(rows)
    pairs = stored(stars.join(sketches.alias("a"), F.expr("u = a.node")).join(sketches.alias("b"), F.expr("v = b.node"))
                   .where(_may_link("a", "b")).select("u", "v").distinct(), "minhash-pairs")
    links = _confirmed(pairs, docs, "minhash-stars")
    comp = stored(components(links, "minhash-components"), "minhash-component")
    forget(links)

    rest = stored(_unresolved(inside, sketches, comp).join(pairs, ["u", "v"], "left_anti"), "minhash-rest")
    more = _confirmed(rest, docs, "minhash-more")
    comp = stored(components(more.union(comp.toDF("u", "v")), "minhash-components"), "minhash-component")
    for t in (inside, pairs, rest, more):
        forget(t)
    comp = comp.select(F.col("u").alias("node"), "component")
    out = (sig.select("doc_id", "n", "print_1", "print_2").join(copies, ["n", "print_1", "print_2"], "left")
           .withColumn("node", F.when(F.col("doc_id").isNotNull(), F.coalesce("node", "doc_id"))).join(comp, "node", "left")
           .withColumn("component_id", F.coalesce("component", "node")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id",
                      F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _unresolved(inside: DataFrame, sketches: DataFrame, comp: DataFrame) -> DataFrame:
    """Pairs of different components that share a bucket of three or more and may be alike.

    A pair is made in the smallest of the buckets that it shares only. Where that one holds just the
    two, they were a star pair and have been looked at.
    """
    inside = (inside.where("size > 2").select("key", "size", "node").join(comp.withColumnRenamed("u", "node"), "node", "left")
              .withColumn("component", F.coalesce("component", "node")))
    mixed = (inside.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key"))
    inside = stored(inside.join(mixed, "key", "left_semi").join(sketches, "node"), "minhash-mixed")
    cells = F.ceil(F.col("size") / CELL).cast("int")
    own = F.pmod(F.xxhash64("node"), cells).cast("int")
    part = F.sequence(F.lit(0), cells - 1)
    a = inside.select("*", own.alias("i"), F.explode(part).alias("j")).alias("a")
    b = inside.select("*", own.alias("j"), F.explode(part).alias("i")).alias("b")
    return (a.join(b, F.expr("a.key = b.key and a.i = b.i and a.j = b.j and a.node < b.node and a.component <> b.component")
                   & _may_link("a", "b") & F.expr("a.key = array_min(array_intersect(a.bands, b.bands))"))
            .select(F.col("a.node").alias("u"), F.col("b.node").alias("v")).distinct())


#: Over all pairs that share a shingle: for small tables.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                       '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                                          ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, e.v FROM r JOIN e ON e.u = r.v),
c AS (SELECT u AS doc_id, min(v) AS component_id FROM r GROUP BY u)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.doc_id
"""
