"""Quality rules by cross-document line frequency.

1. One pass over the texts measures each (words, symbols, repeated lines and word windows) and hashes its
   normalised lines: A-Z in lower case, digits as 0, white space as single blanks, 128 bits together with
   the host. The small table goes to the shared folder; texts are not moved.
2. For each (host, line) Spark counts the distinct documents that hold it. Documents of one host with equal
   whole texts are one, so that copies alone make no line frequent. A line is removed where more than
   ``LINE_DOCS`` documents and more than ``LINE_SHARE`` thousandths of its host's documents hold it.
3. A document is depleted, and rejected, where less than ``LEFT`` percent of its words are left.

The lines that are looked up again meet the frequent ones in a join that Spark may split at a hot line; what a
document loses is summed before it is moved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, slices, small_batches, stored, text_buffer
from .words import codes, line_places, word_codes, word_places

#: A removed line is held by more documents of its host than this, and by more than this share in thousandths.
LINE_DOCS, LINE_SHARE = 10, 10
#: Percent of the words that must be left.
LEFT = 50
#: Base rules: least words, and most percent of words in repeated windows.
MIN_WORDS, MAX_REPEATED = 50, 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_NORMAL = bytes(ord("0") if 48 <= b < 58 else b + 32 if 65 <= b < 91 else b for b in range(256))


def repeated_words(code: np.ndarray, kinds: int, at: np.ndarray) -> np.ndarray:
    """Of each text, its words that lie in a window of three words found twice or more in the text."""
    n = np.diff(at)
    out = np.zeros(len(n), np.int64)
    if len(code) < 3:
        return out
    row = np.repeat(np.arange(len(n)), n)[:-2]
    inside = np.arange(len(code) - 2) + 2 < at[1:][row]
    _, pair = np.unique(code[:-1] * kinds + code[1:], return_inverse=True)
    key = ((pair[:-1] * kinds + code[2:]) * len(n) + row)[inside]     # below words^2 x texts of a slice
    if not len(key):
        return out
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(code) + 1, np.int64)
    begin = np.flatnonzero(inside)[twice]
    np.add.at(cover, begin, 1)
    np.add.at(cover, begin + 3, -1)
    total = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    return total[at[1:]] - total[at[:-1]]


def _per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[at[1:]] - total[at[:-1]]


def _host_key(host) -> bytes:
    return b"-" if host is None else b"+%d:" % len(host.encode()) + host.encode()


def _line_lists(buf: bytes, starts, ends, words, at, hosts) -> tuple[list[int], list[bytes], list[int]]:
    """Of each text its distinct normalised lines: how many, 16-byte hashes, words in them."""
    from xxhash import xxh3_128_digest
    sizes, hashes, counts = [], [], []
    for r, host in enumerate(hosts):
        mine: dict[bytes, int] = {}
        for i in range(at[r], at[r + 1]):
            if words[i]:
                h = xxh3_128_digest(host + b" ".join(buf[starts[i]:ends[i]].translate(_NORMAL).split()))
                mine[h] = mine.get(h, 0) + words[i]
        sizes.append(len(mine))
        hashes += mine.keys()
        counts += mine.values()
    return sizes, hashes, counts


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh3_64_intdigest, xxh3_128_digest
    part, seen = TaskContext.get().partitionId(), 0
    for batch in batches:
        for rows in slices(batch, "text"):
            n = rows.num_rows
            buf, offsets = text_buffer(rows.column("text"))
            start, end, at = word_places(buf, offsets)
            code, kinds = word_codes(buf, start, end)
            chars = _per_text((buf & 0xC0) != 0x80, offsets) - _per_text(np.isin(buf, (9, 10, 11, 12, 13, 32)), offsets)
            l0, l1, l_at = line_places(buf, offsets)
            words = np.bincount(np.searchsorted(l0, start, side="right") - 1, minlength=len(l0))
            line, _ = codes(buf[buf != 10], l1 - l0)
            some = words > 0
            of = np.repeat(np.arange(n), np.diff(l_at))
            key = np.unique(of[some] * (len(l0) + 1) + line[some])
            dup = np.bincount(of[some], minlength=n) - np.bincount(key // (len(l0) + 1), minlength=n)
            hosts = [_host_key(h) for h in rows.column("host").to_pylist()]
            raw = buf.tobytes()
            sizes, hashes, counts = _line_lists(raw, l0.tolist(), l1.tolist(), words.tolist(), l_at.tolist(), hosts)
            h = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
            text = np.frombuffer(b"".join(xxh3_128_digest(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())), np.int64).reshape(-1, 2)
            lines = pa.StructArray.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(counts, pa.int64())], ["h1", "h2", "words"])
            out = {"row": pa.array((part << 40) + seen + np.arange(n)), "doc_id": rows.column("doc_id"),
                   "n_words": pa.array(np.diff(at)), "word_chars": pa.array(chars), "n_symbols": pa.array(_per_text(_SYMBOL[buf], offsets)),
                   "n_dup_lines": pa.array(dup), "n_repeat_words": pa.array(repeated_words(code, kinds, at)),
                   "host": pa.array(np.array([xxh3_64_intdigest(x) for x in hosts], np.uint64).view(np.int64)),
                   "t1": pa.array(text[:, 0]), "t2": pa.array(text[:, 1]),
                   "lines": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), lines)}
            seen += n
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))


_MEASURED = ("row long, doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
             "host long, t1 long, t2 long, lines array<struct<h1:long,h2:long,words:long>>")


def measure(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row a document: base measures, hash of host and text, distinct lines with the words in them."""
    small_batches(docs.sparkSession)
    rows = id_and_text(docs, host).withColumn("host", F.col(host).cast("string"))
    return rows.select("doc_id", "text", "host").mapInArrow(_measure, _MEASURED)


def frequent_lines(measured: DataFrame, line_docs: int = LINE_DOCS, line_share: int = LINE_SHARE) -> DataFrame:
    """h1, h2, n_docs, host_docs of the lines above the limits."""
    held = measured.select("host", "t1", "t2", F.explode("lines").alias("l")).select("l.h1", "l.h2", "host", "t1", "t2").distinct()
    lines = held.groupBy("h1", "h2", "host").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > line_docs)
    hosts = measured.select("host", "t1", "t2").distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    return lines.join(hosts, "host").where(F.col("n_docs") * 1000 > F.col("host_docs") * line_share).select("h1", "h2", "n_docs", "host_docs")


def judge(docs: DataFrame, host: str = "source", line_docs: int = LINE_DOCS, line_share: int = LINE_SHARE, left: int = LEFT) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines_removed, words_left.

    ``n_lines_removed``: distinct lines above the limits. Null and empty texts have no words and fail the
    base. A null host is a host of its own; rows that repeat are judged each, and count as one document of
    their host, as all equal texts of a host do. Null ids stay null. An empty table gives no row; other columns
    are ignored. Memory of a task follows its longest text (about 100 bytes a word).
    """
    m = stored(measure(docs, host), "quality-measured")
    over = frequent_lines(m, line_docs, line_share).select("h1", "h2")
    lost = (m.select("row", F.explode("lines").alias("l")).select("row", "l.*").join(over, ["h1", "h2"])
            .groupBy("row").agg(F.sum("words").alias("lost"), F.count("*").alias("n_lines_removed")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    rows = m.drop("lines", "host", "t1", "t2").join(lost, "row", "left").withColumn("words_left", F.col("n_words") - F.coalesce("lost", F.lit(0)))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
                       (~failed & (100 * F.col("words_left") >= left * F.col("n_words"))).alias("kept"),
                       F.coalesce("n_lines_removed", F.lit(0)).cast("long").alias("n_lines_removed"), "words_left")


def strip(docs: DataFrame, host: str = "source", line_docs: int = LINE_DOCS, line_share: int = LINE_SHARE, left: int = LEFT) -> DataFrame:
    """The kept documents (doc_id, host, text) without the lines above the limits.

    Which documents stay is as :func:`judge` says; what is removed depends on host and text alone, so that equal
    texts of a host lose the same lines.
    """
    m = stored(measure(docs, host), "quality-measured")
    over = frequent_lines(m, line_docs, line_share).select("h1", "h2")
    gone = (m.select("host", "t1", "t2", F.explode("lines").alias("l")).select("host", "t1", "t2", "l.h1", "l.h2", "l.words").distinct().join(over, ["h1", "h2"])
            .groupBy("host", "t1", "t2").agg(F.collect_list(F.struct("h1", "h2")).alias("gone"), F.sum("words").alias("lost")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    verdict = (m.select("host", "t1", "t2", "n_words", failed.alias("failed")).distinct().join(gone, ["host", "t1", "t2"], "left")
               .where(~F.col("failed") & (100 * (F.col("n_words") - F.coalesce("lost", F.lit(0))) >= left * F.col("n_words")))
               .select("host", "t1", "t2", F.coalesce("gone", F.array().cast("array<struct<h1:long,h2:long>>")).alias("gone")))

    def keys(batches):
        from xxhash import xxh3_64_intdigest, xxh3_128_digest
        for b in batches:
            text = np.frombuffer(b"".join(xxh3_128_digest(x.encode()) for x in b.column("text").to_pylist()), np.int64).reshape(-1, 2)
            h = np.array([xxh3_64_intdigest(_host_key(x)) for x in b.column("name").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(h), pa.array(text[:, 0]), pa.array(text[:, 1])], [*b.schema.names, "host", "t1", "t2"])

    def cut(batches):
        from xxhash import xxh3_128_digest
        for b in batches:
            texts = []
            for text, name, gone in zip(b.column("text").to_pylist(), b.column("name").to_pylist(), b.column("gone").to_pylist()):
                drop = {np.array([x["h1"], x["h2"]], np.int64).tobytes() for x in gone}
                key = _host_key(name)
                texts.append("\n".join(x for x in text.split("\n") if not drop or xxh3_128_digest(key + b" ".join(x.encode().translate(_NORMAL).split())) not in drop))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("name"), pa.array(texts, pa.string())], ["doc_id", host, "text"])
    rows = id_and_text(docs, host).withColumn("name", F.col(host).cast("string")).select("doc_id", "text", "name")
    keyed = rows.mapInArrow(keys, "doc_id long, text string, name string, host long, t1 long, t2 long")
    return keyed.join(verdict, ["host", "t1", "t2"]).select("doc_id", "text", "name", "gone").mapInArrow(cut, f"doc_id long, `{host}` string, text string")


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
      FROM (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d)),
n AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars FROM w GROUP BY r),
three AS (SELECT r, i, w, lead(w) OVER (PARTITION BY r ORDER BY i) AS w2, lead(w, 2) OVER (PARTITION BY r ORDER BY i) AS w3 FROM w),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, w, w2, w3) AS c FROM three WHERE w3 IS NOT NULL),
rep AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) v(k) WHERE c > 1 GROUP BY r),
l AS (SELECT r, host, t, unnest(string_split(t, chr(10))) AS l FROM d),
lw AS (SELECT *, length(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS k,
       trim(regexp_replace(regexp_replace(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm FROM l),
dup AS (SELECT r, count(*) - count(DISTINCT l) AS n_dup_lines FROM lw WHERE k > 0 GROUP BY r),
hosts AS (SELECT host, count(DISTINCT t) AS host_docs FROM d GROUP BY host),
freq AS (SELECT host, norm, count(DISTINCT t) AS n_docs FROM lw WHERE k > 0 GROUP BY host, norm),
over_limit AS (SELECT f.host, f.norm FROM freq f JOIN hosts h ON f.host IS NOT DISTINCT FROM h.host
               WHERE n_docs > {LINE_DOCS} AND n_docs * 1000 > host_docs * {LINE_SHARE}),
lost AS (SELECT r, sum(k) AS lost, count(DISTINCT lw.norm) AS n_lines_removed FROM lw JOIN over_limit o
         ON lw.host IS NOT DISTINCT FROM o.host AND lw.norm = o.norm WHERE k > 0 GROUP BY r),
j AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
      length(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
      coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines_removed, 0) AS n_lines_removed,
      coalesce(n_words, 0) - coalesce(lost, 0) AS words_left
      FROM d LEFT JOIN n USING (r) LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN lost USING (r))
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed,
       n_words >= {MIN_WORDS} AND 100 * n_repeat_words <= {MAX_REPEATED} * n_words AND 100 * words_left >= {LEFT} * n_words AS kept,
       n_lines_removed, CAST(words_left AS BIGINT) AS words_left
FROM j
"""
