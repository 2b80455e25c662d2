"""Periodic runs of words by internal pattern matching.

A run is a stretch of words with smallest period q that cannot be made longer and holds ``LEAST`` words and two periods
at least. All texts of a slice are searched together; the first rank of a word holds its text, so nothing matches across.

1. Suffixes are sorted by doubling prefixes, and only those that still share a rank go on. The ranks of every
   level are kept: they compare two stretches of any length in one look a level, in either direction.
2. Dyadic blocks (2^k words at multiples of 2^k) that occur again ask for their occurrences in a neighbouring window:
   a wavelet tree over the suffix array gives the successor of a position within the block's interval. A run of period
   q from the level's range (``_ranges``) holds a block whose next copy lies q words on, so no run is missed.
3. Occurrences that overlap by half a block or more are an arithmetic progression, whose end is known
   from one comparison. All its members are candidate periods, unless the block lies in the same periodic stretch: then
   they are multiples of the progression's difference, which a lower level has.
4. Candidates are extended both ways; those long enough are runs, of equal stretches the smallest period.

Work is in numpy over a slice; the memory of a task follows its longest text (about 300 bytes a word).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, slices, small_batches, text_buffer
from .words import word_codes, word_places

#: Least words of a run.
LEAST = 12


class Suffixes:
    """Sorted suffixes of several word sequences, one after the other; ``at``: where each begins, and the end."""

    def __init__(self, words: np.ndarray, at: np.ndarray):
        n = len(words)
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        self.n, self.begin, self.end = n, at[:-1][row], at[1:][row]
        key = row * (int(words.max(initial=0)) + 1) + words
        rank = np.zeros(n + 1, np.int32)
        rank[n] = -1
        active = np.arange(n)
        self.levels: list[np.ndarray] = []
        step = 0                                            # 0: by words, then words that are sorted by
        while True:
            if step:
                nxt = active + step
                key = rank[active].astype(np.int64) * (n + 2) + np.where(nxt < self.end[active], rank[np.minimum(nxt, n)] + 1, 0)
            order = np.argsort(key, kind="stable")
            key, active = key[order], active[order]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            place = np.arange(len(key))
            group = np.maximum.accumulate(np.where(new, place, 0))
            if step:
                old = rank[active]
                bucket = np.ones(len(key), bool)
                bucket[1:] = old[1:] != old[:-1]
                first = old + group - np.maximum.accumulate(np.where(bucket, place, 0))
            else:
                first = group
            rank = rank.copy()
            rank[active] = first
            self.levels.append(rank)
            last = np.ones(len(key), bool)
            last[:-1] = new[1:]
            active = np.sort(active[~(new & last)])
            step = step * 2 or 1
            if not len(active):
                break

    def order(self) -> np.ndarray:
        out = np.empty(self.n, np.int64)
        out[self.levels[-1][:-1]] = np.arange(self.n)
        return out

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree from i and j on."""
        a = i.copy()
        shift = j - i
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            b = a + shift
            ok = b < self.n
            ok[ok] = level[a[ok]] == level[b[ok]]
            a[ok] += 1 << k
        return a - i

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree before i and j, i < j in one sequence."""
        a, begin = i.copy(), self.begin[i]
        shift = j - i
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            b = a - (1 << k)
            ok = b >= begin
            ok[ok] = level[b[ok]] == level[(b + shift)[ok]]
            a[ok] -= 1 << k
        return i - a


class WaveletTree:
    """Bit planes of a sequence of numbers, highest first, each level with zeros moved before ones."""

    def __init__(self, values: np.ndarray, most: int):
        self.bits = max(1, int(most).bit_length())
        self.zeros = []                                     # zeros before each place, a level
        for b in range(self.bits - 1, -1, -1):
            one = (values >> b & 1).astype(bool)
            self.zeros.append(np.concatenate([[0], np.cumsum(~one, dtype=np.int32)]).astype(np.int32))
            values = np.concatenate([values[~one], values[one]])

    def below(self, left, right, x) -> np.ndarray:
        """How many numbers in [left, right) are smaller than x."""
        out = np.zeros(len(left), np.int64)
        for level, zeros in enumerate(self.zeros):
            one = (x >> (self.bits - 1 - level) & 1).astype(bool)
            l0, r0 = zeros[left], zeros[right]
            out += np.where(one, r0 - l0, 0)
            left, right = np.where(one, zeros[-1] + left - l0, l0), np.where(one, zeros[-1] + right - r0, r0)
        return out

    def nth(self, left, right, i) -> np.ndarray:
        """The i-th smallest number in [left, right), from 0."""
        out, i = np.zeros(len(left), np.int64), i.copy()
        for zeros in self.zeros:
            l0, r0 = zeros[left], zeros[right]
            one = i >= r0 - l0
            i -= np.where(one, r0 - l0, 0)
            out = out * 2 + one
            left, right = np.where(one, zeros[-1] + left - l0, l0), np.where(one, zeros[-1] + right - r0, r0)
        return out

    def successor(self, left, right, x) -> np.ndarray:
        """The smallest number in [left, right) that is x or more, -1 where there is none."""
        out = np.full(len(left), -1, np.int64)
        able = x < 1 << self.bits
        i = np.where(able, self.below(left, right, np.where(able, x, 0)), right - left)
        some = i < right - left
        out[some] = self.nth(left[some], right[some], i[some])
        return out


def _ranges(levels: int) -> Iterator[tuple[int, int, int]]:
    """Level and its smallest and largest period.

    A run of length m and period q has m - q words that come again q words on: 2^(k + 1) - 1 of them hold an aligned
    block of 2^k. With 12 words at least that is level 2 up to period 14 (but for a run of 12 words and period 6:
    level 1), and above it the level whose range holds q.
    """
    yield 1, 6, 6
    yield 2, 1, 14
    for k in range(3, levels):
        yield k, (1 << k + 1) - 1, (1 << k + 2) - 2


def _candidates(s: Suffixes, tree: WaveletTree, where: np.ndarray, k: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, occurrence) pairs of level k, by range successor; progressions are gone through at once."""
    level, size = s.levels[k], 1 << k
    same = np.bincount(level[:-1], minlength=s.n)
    block = np.arange(s.n)
    block = block[((block - s.begin) % size == 0) & (same[level[:-1]] > 1)]
    left = where[level[block]]
    right = left + same[level[block]]
    x, most = block + low, np.minimum(block + high, s.n - 1)
    before = np.full(len(block), -s.n - size, np.int64)                                # no occurrence yet
    found: list[tuple[np.ndarray, np.ndarray]] = []
    while len(block):
        v = tree.successor(left, right, x)
        some = (v >= 0) & (v <= most)
        block, left, right, most, v, before = (y[some] for y in (block, left, right, most, v, before))
        found.append((block, v))
        x, gap, before = v + 1, v - before, v.copy()
        near = np.flatnonzero(gap <= size // 2)
        if len(near):
            p, at, d = block[near], v[near], gap[near]
            end = at + s.ahead(at - d, at)                                             # what has period d from the occurrence before on
            m = np.maximum((np.minimum(end - size, most[near]) - at) // d, 0)          # members that follow
            one = p + d + s.ahead(p, p + d) >= at + size                               # block and occurrence in one stretch
            many = np.where(one, 0, m)
            i = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + 1
            found.append((np.repeat(p, many), np.repeat(at, many) + i * np.repeat(d, many)))
            x[near] = at + m * d + 1
            before[near] = at + m * d
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([b for b, _ in found]), np.concatenate([v for _, v in found])


def find_runs(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of all runs of the sequences, by start, then period."""
    none = np.zeros(0, np.int64)
    if len(words) < LEAST:
        return none, none, none
    s = Suffixes(words, at)
    if len(s.levels) < 2:
        return none, none, none
    twice = np.bincount(s.levels[1][:-1], minlength=s.n)[s.levels[1][:-1]] > 1      # suffixes whose first two words come again
    if not twice.any():
        return none, none, none
    order = s.order()
    held = twice[order]
    where = np.concatenate([[0], np.cumsum(held)])
    tree = WaveletTree(order[held], s.n)
    pairs = [_candidates(s, tree, where, *r) for r in _ranges(len(s.levels)) if r[0] < len(s.levels)]
    p, v = np.concatenate([b for b, _ in pairs]), np.concatenate([x for _, x in pairs])
    start, end, q = p - s.behind(p, v), v + s.ahead(p, v), v - p
    some = end - start >= np.maximum(LEAST, 2 * q)
    start, end, q = start[some], end[some], q[some]
    o = np.lexsort((q, end, start))
    start, end, q = start[o], end[o], q[o]
    new = np.ones(len(q), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, q = start[new], end[new], q[new]
    o = np.lexsort((q, start))
    return start[o], end[o], q[o]


def _planted(ids: list, at: np.ndarray) -> np.ndarray:
    """For each word the original word that it becomes: texts of every tenth id repeat a stretch from some word on."""
    out = np.arange(at[-1])
    for r, i in enumerate(ids):
        h, n = zlib.crc32(b"" if i is None else b"%d" % i), int(at[r + 1] - at[r])
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            out[at[r] + a:at[r + 1]] = at[r] + a + np.arange(n - a) % p
    return out


def _texts(batches: Iterator[pa.RecordBatch], planted: bool):
    """Of each slice: ids, words as bytes, where each text's begin, runs, and which words are kept."""
    for batch in batches:
        for rows in slices(batch, "text"):
            buf, offsets = text_buffer(rows.column("text"))
            start, end, at = word_places(buf, offsets)
            code, _ = word_codes(buf, start, end)
            raw = buf.tobytes()
            words = [raw[a:b] for a, b in zip(start.tolist(), end.tolist())]
            ids = rows.column("doc_id").to_pylist()
            if planted:
                source = _planted(ids, at)
                code = code[source]
                words = [words[i] for i in source.tolist()]
            a, b, q = find_runs(code, at)
            drop = np.zeros(len(code) + 1, np.int64)
            np.add.at(drop, a + q, 1)
            np.add.at(drop, b, -1)
            yield ids, words, at, (a, b, q), np.cumsum(drop[:-1]) == 0


def collapse(docs: DataFrame) -> DataFrame:
    """doc_id, ``runs`` (array of start, length, period, by start, then period) and ``text``: words outside repeats, joined by one blank.

    A word is left out where a run holds it after that run's first period. Null and empty texts have no runs and the
    empty text; rows that repeat are treated each, null ids stay null, other columns are ignored.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, words, at, (a, b, q), keep in _texts(batches, False):
            first = np.searchsorted(a, at)
            base = np.repeat(at[:-1], np.diff(first))
            runs = pa.StructArray.from_arrays([pa.array(a - base), pa.array(b - a), pa.array(q)], ["start", "length", "period"])
            texts = [b" ".join([words[i] for i in (at[r] + np.flatnonzero(keep[at[r]:at[r + 1]])).tolist()]).decode() for r in range(len(ids))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(first, pa.int32()), runs), pa.array(texts, pa.string())],
                                             ["doc_id", "runs", "text"])
    return id_and_text(docs).mapInArrow(run, "doc_id long, runs array<struct<start:long,length:long,period:long>>, text string")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 of texts with planted repeats.

    Before the search, the words of a text whose h = crc32(id) is divisible by 10 repeat: with g = h // 10, a = g % n and
    p = 1 + (n - a) // (3 + g % 8), word i >= a becomes word a + (i - a) % p. A null id counts as the empty text here (h = 0).
    start to exponent_milli are of the longest run (ties: smallest start, then period), null without a run. Rows
    otherwise as :func:`collapse` treats them; an empty table gives no row.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, words, at, (a, b, q), keep in _texts(batches, True):
            out = []
            first = np.searchsorted(a, at)
            for r in range(len(ids)):
                x, y = int(at[r]), int(at[r + 1])
                i, j = int(first[r]), int(first[r + 1])
                runs = list(zip((a[i:j] - x).tolist(), (b - a)[i:j].tolist(), q[i:j].tolist()))
                best = min(runs, key=lambda s: (-s[1], s[0], s[2]), default=None)
                mine = words[x:y] if keep[x:y].all() else [words[k] for k in (x + np.flatnonzero(keep[x:y])).tolist()]
                out.append((ids[r], len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
                            hashlib.sha256("".join([f"{s},{m},{p}\n" for s, m, p in runs]).encode()).hexdigest(),
                            hashlib.sha256(b" ".join(mine)).hexdigest()))
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:6]], *[pa.array(c, pa.string()) for c in columns[6:]]],
                                             ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])
    return id_and_text(docs).mapInArrow(run, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
                                             "runs_sha256 string, collapsed_sha256 string")
