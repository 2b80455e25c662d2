"""Language identification by rank-order profiles and out-of-place distance.

A profile is the list of the ``PROFILE`` most frequent character 1- to 3-grams of words (lower case,
a boundary mark on either side), most frequent first, ties by code. A document's profile is compared
to each language's: every n-gram costs the difference of its two ranks, or ``PROFILE`` where the
language lacks it. The language with the smallest sum wins, ties by name.

Learning counts n-grams of all training rows: each task adds up a slice of texts per language, Spark
sums by (language, n-gram). A long text is counted in stretches, so that a task's memory holds one stretch and
the distinct n-grams. What reaches the driver and the workers is ``PROFILE`` entries a language.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, id_and_text, slices, small_batches

#: Entries of a profile.
PROFILE = 400
#: Most languages that may be learned: bounds what is broadcast (languages x PROFILE x 20 bytes).
MAX_LANGUAGES = 10_000
_MARK = 1
#: Characters of a long text that are turned into n-grams at once.
STRETCH = 1 << 19


@cache
def _lower_table() -> np.ndarray:
    """Code point -> lower-case code point of a letter, else 0."""
    out = np.zeros(0x110000, dtype=np.int64)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            out[cp] = ord(low) if len(low) == 1 else cp
    return out


def _codes(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """n-gram codes of the texts and the index of each one's text, as a few arrays in text order.

    A code holds up to three characters of 21 bits. Runs of other than letters are one boundary mark.
    """
    joined = "\n".join(texts) + "\n"
    cp = _lower_table()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    letter = cp > 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]          # the first other character after a letter is the mark
    kept = np.diff(np.concatenate([[0], np.cumsum(keep)[ends - 1]]))
    row = np.repeat(np.arange(len(texts)), kept)
    seq = cp[keep]
    seq[seq == 0] = _MARK
    before = np.concatenate([[_MARK], seq[:-1]])
    after = np.concatenate([seq[1:], [_MARK]])[:len(seq)]
    at = seq != _MARK
    one, l, r, d = seq[at], before[:len(seq)][at], after[at], row[at]
    first = l == _MARK
    # a letter; a letter and what follows it; the mark and a word's first letter; a letter between its neighbours
    return [(one, d), ((one << 21) | r, d), ((_MARK << 21) | one[first], d[first]), ((l << 42) | (one << 21) | r, d)]


def _counts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and how often each occurs; sorts in place."""
    codes.sort()
    new = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[new], np.diff(np.append(new, len(codes)))


def _first(values: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """The most frequent of the values, most frequent first, ties by code."""
    if len(n) > size:
        least = np.partition(n, len(n) - size)[len(n) - size]
        some = n >= least
        n, values = n[some], values[some]
    return values[np.argsort(-n, kind="stable")[:size]]


def _top(codes: np.ndarray, size: int) -> np.ndarray:
    return _first(*_counts(codes), size)


def _stretches(text: str) -> Iterator[str]:
    """A text cut before other than letters, where no n-gram goes across."""
    at = 0
    while len(text) - at > STRETCH:
        to = at + STRETCH
        while to > at and text[to].isalpha():
            to -= 1
        if to == at:                                        # one word longer than a stretch stays whole
            to = at + STRETCH
            while to < len(text) and text[to].isalpha():
                to += 1
        yield text[at:to]
        at = to
    yield text[at:]


def _long_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of a long text and how often each occurs, added up over its stretches."""
    values, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for part in _stretches(text):
        v, m = _counts(np.concatenate([c for c, _ in _codes([part])]))
        both, at = np.unique(np.concatenate([values, v]), return_inverse=True)
        values, n = both, np.bincount(at, np.concatenate([n, m]), len(both)).astype(np.int64)
    return values, n


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            lang, texts = part.column("lang").to_pylist(), part.column("text").to_pylist()
            names = sorted(set(lang))
            if part.num_rows == 1:
                found = [(names[0], *_long_counts(texts[0]))]
            else:
                grams = _codes(texts)
                of = np.array([names.index(x) for x in lang])
                found = [(name, *_counts(np.concatenate([c[of[d] == i] for c, d in grams]))) for i, name in enumerate(names)]
            for name, values, n in found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(values), pa.string()), pa.array(values), pa.array(n.astype(np.int64))],
                    ["lang", "code", "n"])


def learn(rows: DataFrame, size: int = PROFILE) -> dict[str, list[int]]:
    """Profiles of the languages in ``rows`` (text, lang); rows without either are left out."""
    small_batches(rows.sparkSession)
    rows = rows.select("text", F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    n = rows.mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    top = n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= size)
    got = top.select("lang", "code", "rank").limit(MAX_LANGUAGES * size + 1).collect()
    if len(got) > MAX_LANGUAGES * size:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
    out: dict[str, list[int]] = {}
    for r in sorted(got, key=lambda r: (r.lang, r["rank"])):
        out.setdefault(r.lang, []).append(r.code)
    return out


def _judge(profiles: dict[str, list[int]], size: int, names_out: list[str]):
    names = sorted(profiles)
    known = np.unique(np.array([c for p in profiles.values() for c in p], dtype=np.int64))
    ranks = np.full((len(names), len(known) + 1), -1, dtype=np.int64)   # the last column: unknown
    for i, name in enumerate(names):
        ranks[i, np.searchsorted(known, profiles[name])] = np.arange(len(profiles[name]))

    def one(top: np.ndarray) -> tuple[str, float]:
        if not len(top) or not names:
            return "und", 0.0
        at = np.searchsorted(known, top)
        at[known[np.minimum(at, len(known) - 1)] != top] = len(known)
        theirs = ranks[:, at]
        cost = np.where(theirs < 0, size, np.abs(theirs - np.arange(len(top)))).sum(axis=1)
        best = int(np.argmin(cost))
        return names[best], float(1 - cost[best] / (size * len(top)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                if part.num_rows == 1:
                    got = [one(_first(*_long_counts(texts[0]), size))]
                else:
                    grams = [(c, np.searchsorted(d, np.arange(part.num_rows + 1))) for c, d in _codes(texts)]
                    got = [one(_top(np.concatenate([c[at[i]:at[i + 1]] for c, at in grams]), size)) for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays(
                    [*map(part.column, names_out), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())],
                    [*names_out, "lang_pred", "score"])
    return run


def predict(docs: DataFrame, profiles: dict[str, list[int]], size: int = PROFILE, keep: list[str] = ()) -> DataFrame:
    """doc_id, held_out, the columns to keep, lang_pred, score for every row of ``docs``.

    Null, empty and letterless texts, and all texts where nothing was learned, give ``und`` and 0.
    Repeated rows are predicted one by one; other columns are ignored. A null id stays null.
    """
    small_batches(docs.sparkSession)
    rows = (id_and_text(docs, *[c for c in keep if c != "text"]).withColumn("held_out", crc_mod(F.col("doc_id"), 3) == 1))
    out = ["doc_id", "held_out", *keep]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*out).schema)
    return rows.select(*dict.fromkeys([*out, "text"])).mapInArrow(_judge(profiles, size, out), f"{types}, lang_pred string, score double")


def identify(docs: DataFrame, size: int = PROFILE, keep: list[str] = ()) -> DataFrame:
    """Learn from rows whose crc32(doc_id) mod 3 is not 1 and predict all rows."""
    train = docs.where(crc_mod(F.col("doc_id").cast("long"), 3) != 1)
    return predict(docs, learn(train, size), size, keep)
