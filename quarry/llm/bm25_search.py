"""Exact top-k search: an inverted index with block-max pruning for BM25, run per shard, merged exactly.

Rows are cut into shards of bounded size. A shard's index is one row of a stored table: its terms (64-bit
hashes of lower-case words), postings in document order, and document lengths. Global statistics (rows,
mean length, document frequencies of the queries' terms) come from one aggregation over all rows.

Queries go by in blocks of bounded size. For a query of few words, each shard adds up its terms' block maxima
(the best score of the term in a block of ``BLOCK`` documents) to an upper bound of every block, and visits
blocks from the highest bound on. As in WAND, a block is entered only while its bound can beat the k-th
score found so far; the others' postings are never read. Such bounds add up to more than any document's score
where a query is a long text (its common words are in every block), so a shard takes its long queries together:
the terms that many of its documents and many queries hold are a product of two small dense matrices, all other
terms' postings are added to it, and only documents whose sum, with the most that rounding can have taken from
it, reaches the k-th score are scored in fixed point. A shard gives its exact k best; their union, ranked, is exact.

Shards are searched in rounds, each about four times as many as all before it: a shard's level is drawn from its
hash, and the rarest level goes first. The k-th score that a query has after a round goes along as its bound in
the next one, so blocks below it are skipped in every shard and rows below it are not returned: of a round about
4 k rows a query come back however many shards it has.

Scores are fixed-point: a term's part is rounded to 1e-6, so sums do not depend on their order and equal
texts have equal scores. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, id_and_text, slices, small_batches, stored, text_buffer
from .minhash_dedup import word_hashes

K1, B = 1.2, 0.75
UNIT = 1e6
#: Documents of a block, and bytes of text of a shard (one row at least).
BLOCK = 64
SHARD = 8 << 20
#: Entries (query, term) of a block of queries that is sent to every shard: 24 bytes each.
QUERY_BLOCK = 1 << 21
#: Blocks that are visited before the bound is compared again.
_STEP = 4
#: Terms in a shard up to which a query visits blocks by their bounds; longer ones are taken together.
FEW = 8
#: Sums of (query, document) that are held at once.
_SUMS = 1 << 18
#: A term is dense if so many (query, document) pairs of a shard, on average, have one that holds it on both sides.
_DENSE = 512
#: Rounds at most; level i has a 4^-i-th of the shards.
_LEVELS = 16


def _counted(part: pa.RecordBatch):
    """Distinct (row, term) pairs in row order: rows, terms, frequencies; and the rows' lengths."""
    h, at = word_hashes(*text_buffer(part.column("text")))
    rows, terms, tf = [], [], []
    for i, (a, b) in enumerate(zip(at[:-1], at[1:])):
        if b > a:
            t, n = np.unique(h[a:b], return_counts=True)
            terms.append(t)
            tf.append(n)
            rows.append(np.full(len(t), i, np.int64))
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return join(rows, np.int64), join(terms, np.uint64), join(tf, np.int64), np.diff(at)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", SHARD):
            rows, terms, tf, length = _counted(part)
            order = np.argsort(terms, kind="stable")              # by term, rows in order
            terms, rows, tf = terms[order], rows[order], tf[order]
            new = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if len(terms) else np.zeros(0, np.int64)
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)
            known = np.array(part.column("doc_id").is_valid())
            ids = np.where(known, np.nan_to_num(ids, nan=0), 0).astype(np.int64) if not known.all() else ids.astype(np.int64)
            blobs = [ids, known.astype(np.int8), length.astype(np.int32), terms[new], np.append(new, len(terms)).astype(np.int64),
                     rows.astype(np.int32), tf.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in blobs] + [pa.array([len(ids)], pa.int64()), pa.array([int(length.sum())], pa.int64())],
                                             [*_BLOBS, "rows", "words"])


_BLOBS = ["ids", "known", "lengths", "terms", "begins", "docs", "tfs"]
_KINDS = [np.int64, np.int8, np.int32, np.uint64, np.int64, np.int32, np.int32]


def build_index(docs: DataFrame) -> DataFrame:
    """The stored index, one row a shard."""
    small_batches(docs.sparkSession)
    shards = id_and_text(docs).mapInArrow(_index, ", ".join(f"{b} binary" for b in _BLOBS) + ", rows long, words long")
    draw = F.xxhash64("ids", "rows", "words")
    level = sum((F.pmod(draw, F.lit(4 ** i)) == 0).cast("int") for i in range(1, _LEVELS))
    return stored(shards.withColumn("level", level), "bm25-index", "level")


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            terms = np.frombuffer(batch.column("terms")[i].as_buffer(), np.uint64)
            begins = np.frombuffer(batch.column("begins")[i].as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(np.diff(begins))], ["term", "df"])


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            rows, terms, tf, _ = _counted(part)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(rows)), pa.array(terms.view(np.int64)), pa.array(tf)],
                                             ["query_id", "term", "qtf"])


class Shard:
    """A shard's postings with their scores (but for the query's weight) and block maxima."""

    def __init__(self, blobs: list, mean: float):
        ids, known, length, self.terms, self.begins, self.docs, tf = [np.frombuffer(b, k) for b, k in zip(blobs, _KINDS)]
        self.ids, self.known = ids, known.astype(bool)
        tf = tf.astype(np.float64)
        self.part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[self.docs] / mean))
        self.blocks = -(-len(ids) // BLOCK)
        of = np.repeat(np.arange(len(self.terms)), np.diff(self.begins)) * self.blocks + self.docs // BLOCK
        new = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
        self.cell_begin = np.append(new, len(of))                  # postings of a (term, block) cell
        self.cell_block = of[new] % max(self.blocks, 1)
        self.cell_max = np.maximum.reduceat(self.part, new) if len(new) else np.zeros(0)
        self.term_cell = np.searchsorted(new, self.begins)
        self.by_doc = None

    def search(self, terms: np.ndarray, weight: np.ndarray, k: int, floor: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Rows and fixed-point scores of the k best documents that hold a term and score ``floor`` or more."""
        at = np.searchsorted(self.terms, terms)
        some = at < len(self.terms)
        some[some] = self.terms[at[some]] == terms[some]
        at, weight = at[some], weight[some]
        cells, of = _ranges(self.term_cell[at], self.term_cell[at + 1])
        if not len(cells):
            return np.zeros(0, np.int64), np.zeros(0)
        block = self.cell_block[cells]
        top = np.rint(UNIT * (weight[of] * self.cell_max[cells]))
        bound = np.bincount(block, top, self.blocks)
        by_block = np.argsort(block, kind="stable")
        cells, of = cells[by_block], of[by_block]
        cut = np.searchsorted(block[by_block], np.arange(self.blocks + 1))
        order = np.argsort(-bound, kind="stable")
        rows, scores = np.zeros(0, np.int64), np.zeros(0)
        least = floor
        for s in range(0, len(order), _STEP):
            visit = order[s:s + _STEP]
            if bound[visit[0]] <= 0 or bound[visit[0]] < least:
                break
            pick, _ = _ranges(cut[visit], cut[visit + 1])
            c = cells[pick]
            post, which = _ranges(self.cell_begin[c], self.cell_begin[c + 1])
            part = np.rint(UNIT * (weight[of[pick]][which] * self.part[post]))
            total = np.bincount(self.docs[post], part)
            new = np.flatnonzero(total >= max(least, 1.0))         # scores are whole numbers
            rows, scores = np.concatenate([rows, new]), np.concatenate([scores, total[new]])
            if len(rows) > k:
                best = np.lexsort((self.ids[rows], ~self.known[rows], -scores))[:k]
                rows, scores = rows[best], scores[best]
            if len(rows) == k:
                least = max(least, scores.min())
        return rows, scores


    def search_all(self, begins: np.ndarray, terms: np.ndarray, weight: np.ndarray, k: int, floors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """:meth:`search` for many queries: query q has the terms (places in ``self.terms``, -1: not there) and weights from begins[q] on."""
        n, docs = len(floors), len(self.ids)
        of = np.repeat(np.arange(n), np.diff(begins))[terms >= 0]
        weight, terms = weight[terms >= 0], terms[terms >= 0]
        size = np.bincount(of, minlength=n)
        at = np.concatenate([[0], np.cumsum(size)])
        found = [(np.zeros(0, np.int64), np.zeros(0))] * n
        for q in np.flatnonzero((size > 0) & (size <= FEW)):
            found[q] = self.search(self.terms[terms[at[q]:at[q + 1]]], weight[at[q]:at[q + 1]], k, floors[q])
        many = np.flatnonzero(size > FEW)
        if not len(many):
            return found
        df = np.diff(self.begins)
        asked = np.bincount(terms[size[of] > FEW], minlength=len(df))
        dense = np.flatnonzero(asked * df * float(_DENSE) >= len(many) * docs)
        place = np.full(len(df), -1)
        place[dense] = np.arange(len(dense))
        held = np.zeros((len(dense), docs), np.float32)
        post, row = _ranges(self.begins[dense], self.begins[dense + 1])
        held[row, self.docs[post]] = self.part[post]
        slack = (len(dense) + 8) * 2.0 ** -23                      # of a sum in single precision
        step = max(1, _SUMS // docs)
        for s in range(0, len(many), step):
            some = many[s:s + step]
            pick, q = _ranges(at[some], at[some + 1])
            t, w = terms[pick], weight[pick]
            column = place[t]
            common = column >= 0
            asks = np.zeros((len(some), len(dense)), np.float32)
            asks[q[common], column[common]] = w[common]
            t, w, q = t[~common], w[~common], q[~common]
            post, which = _ranges(self.begins[t], self.begins[t + 1])
            sums = np.bincount((q * docs)[which] + self.docs[post], w[which] * self.part[post], len(some) * docs).reshape(len(some), docs)
            sums = (sums + asks @ held) * UNIT
            lost = 0.5 * size[some] + 1                            # a fixed-point score is at most so far from the sum of its parts
            least = np.maximum(floors[some], 1.0)
            fit = (sums > 0) & (sums >= ((least - lost) * (1 - slack))[:, None])
            full = np.flatnonzero(fit.sum(1) > k)
            if len(full):
                kth = np.partition(sums[full], docs - k, axis=1)[:, docs - k]
                least[full] = np.maximum(least[full], kth * (1 - slack) - lost[full])
                fit[full] &= sums[full] >= ((least - lost) * (1 - slack))[full, None]
            for i in np.flatnonzero(fit.any(1)):
                rows = np.flatnonzero(fit[i])
                scores = self.scores(rows, terms[at[some[i]]:at[some[i] + 1]], weight[at[some[i]]:at[some[i] + 1]])
                rows, scores = rows[scores >= max(floors[some[i]], 1.0)], scores[scores >= max(floors[some[i]], 1.0)]
                best = np.lexsort((self.ids[rows], ~self.known[rows], -scores))[:k]
                found[some[i]] = rows[best], scores[best]
        return found

    def scores(self, rows: np.ndarray, terms: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Fixed-point scores of some documents, from their own postings."""
        if self.by_doc is None:
            order = np.argsort(self.docs.astype(np.uint16) if len(self.ids) < 1 << 16 else self.docs, kind="stable")
            of = np.repeat(np.arange(len(self.terms)), np.diff(self.begins))
            self.by_doc = np.searchsorted(self.docs[order], np.arange(len(self.ids) + 1)), of[order], self.part[order], np.zeros(len(self.terms))
        begins, term, part, asked = self.by_doc
        asked[terms] = weight
        post, of = _ranges(begins[rows], begins[rows + 1])
        got = np.bincount(of, np.rint(UNIT * (asked[term[post]] * part[post])), len(rows))
        asked[terms] = 0
        return got


def _ranges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges [a, b), and the range of each."""
    n = b - a
    of = np.repeat(np.arange(len(a)), n)
    return np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + a[of], of


def _search(queries, k: int, mean: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, begins, words, terms, weights, floors = queries.value    # a query's terms are places in the sorted words
        floors = floors.copy()                                    # and what this task's shards have raised them to
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard([batch.column(c)[i].as_buffer() for c in _BLOBS], mean)
                at = np.searchsorted(words, shard.terms)
                here = at < len(words)
                here[here] = words[at[here]] == shard.terms[here]
                place = np.full(len(words), -1)
                place[at[here]] = np.flatnonzero(here)
                found = shard.search_all(begins, place[terms], weights, k, floors)
                for q, (_, scores) in enumerate(found):
                    if len(scores) == k:
                        floors[q] = max(floors[q], scores.min())
                rows = np.concatenate([r for r, _ in found]) if found else np.zeros(0, np.int64)
                known = shard.known[rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids, [len(r) for r, _ in found])), pa.array(shard.ids[rows], mask=~known),
                     pa.array(np.concatenate([s for _, s in found]) if found else np.zeros(0))], ["query_id", "doc_id", "points"])
    return run


def search(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, doc_id, score: the k best rows of ``docs`` for each query (doc_id, text).

    Rows with no word of the query are not returned, so a query of a null or empty text has no rows. Rows
    of one query id are one query, their words together; a null query id is left out. Repeated rows of
    ``docs`` are ranked each; a row of a null id is ranked behind its equals. Other columns are ignored.
    """
    spark = docs.sparkSession
    index = build_index(docs)
    n, words = index.agg(F.sum("rows"), F.sum("words")).first()
    asked = (id_and_text(queries).where("doc_id is not null").mapInArrow(_query_terms, "query_id long, term long, qtf long")
             .groupBy("query_id", "term").agg(F.sum("qtf").alias("qtf")))
    asked = stored(asked, "bm25-queries")
    df = (index.select("terms", "begins").mapInArrow(_frequencies, "term long, df long")
          .join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df")))
    idf = F.log(F.lit(1) + (F.lit(n or 0) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = stored(asked.join(df, "term").select("query_id", "term", (F.col("qtf") * idf).alias("weight")), "bm25-weights")
    blocks = 1 + weighted.count() // QUERY_BLOCK
    schema = "query_id long, doc_id long, points double"
    best = Window.partitionBy("query_id").orderBy(F.desc("points"), F.col("doc_id").asc_nulls_last())
    ranked = lambda found: found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    levels = sorted((r.level for r in index.select("level").distinct().collect()), reverse=True)
    out = spark.createDataFrame([], schema)
    for i in range(blocks):                                        # bounded blocks, each a pass over the index
        mine = weighted.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).orderBy("query_id", "term").toArrow()
        q, t, w = (mine.column(c).to_numpy() for c in ("query_id", "term", "weight"))
        ids, begins = np.unique(q, return_index=True)
        asked_words, t = np.unique(t.view(np.uint64), return_inverse=True)
        t, floors, top = t.astype(np.int32), np.zeros(len(ids)), None
        for level in levels:
            sent = spark.sparkContext.broadcast((ids, np.append(begins, len(q)), asked_words, t, w, floors))
            shards = index.where(F.col("level") == level).drop("level")
            got = stored(shards.mapInArrow(_search(sent, k, (words or 0) / max(n or 0, 1) or 1.0), schema), "bm25-found")
            sent.unpersist()
            last, top = top, stored(ranked(got if top is None else top.drop("rank").union(got)), "bm25-top")
            forget(got)
            forget(last)
            full = top.where(F.col("rank") == k).select("query_id", "points").toArrow()      # a row a query of the block
            floors = floors.copy()
            floors[np.searchsorted(ids, full.column(0).to_numpy())] = full.column(1).to_numpy()
        if top is not None:
            out = out.union(top.drop("rank"))
    return ranked(out).select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", (F.col("points") / UNIT).alias("score"))


def search_hundredth(docs: DataFrame) -> DataFrame:
    """Every row whose id is divisible by 100 as a query, against all rows."""
    return search(docs, docs.where(F.col("doc_id") % 100 == 0))


SQL = f"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                       '[^\\x20\\x09-\\x0D]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY 1, 2),
size AS (SELECT doc_id, count(*) AS len FROM words GROUP BY 1),
stat AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM words) / (SELECT count(*) FROM documents)::DOUBLE AS mean),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT doc_id AS query_id, term, tf * ln(1 + (n - df + 0.5) / (df + 0.5)) AS weight
      FROM tf JOIN df USING (term), stat WHERE doc_id % 100 = 0),
s AS (SELECT query_id, tf.doc_id, sum(round({UNIT} * (weight * (tf * {K1 + 1} / (tf + {K1} * (1 - {B} + {B} * len / mean)))))) AS points
      FROM q JOIN tf USING (term) JOIN size ON size.doc_id = tf.doc_id, stat GROUP BY 1, 2),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY points DESC, doc_id) AS rank, doc_id, points FROM s WHERE points > 0)
SELECT query_id, rank, doc_id, points / {UNIT} AS score FROM r WHERE rank <= 10
"""
