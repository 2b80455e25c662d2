"""Mixture-controlled packing of tokenised documents into sequences.

Documents queue by source, in the order of the input's partitions and rows. Windows of ``WINDOW``
sequences are filled from the queues by deficit round-robin at token grain: in every window a source's
deficit grows by its target share of the window, it sends whole tokens against it, and what is left
carries into the next window. A queue that runs dry drops out and the others share its part.

The state before any window is known without running the windows before it: with ``t`` the service
given per unit of weight, source s has sent ``sent(t) = min(size, floor(t * weight))`` tokens, and window
w begins at the t where these sum to w windows of tokens (tokens falling due at once go by source).
So deficits carry across windows and partitions exactly, while every task places its own documents:
nothing is sorted, and no token moves. Target weights are the sources' token counts by default, which
gives each window the proportions of the corpus and empties all queues together.

Sequences hold 4,096 tokens without a gap. The last, partial one is cut into powers of two.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, slices, small_batches, stored

SEQUENCE = 4096
#: Sequences of a window: the span in which the target proportions hold.
WINDOW = 16
END = 2
#: Most queues: bounds the table of queue sizes that every task gets (16 bytes and a name each).
MAX_QUEUES = 100_000
#: Words, and parts of words, whose ids a worker keeps; beyond, it starts anew.
KEPT, KNOWN = 800_000, 1_200_000


@lru_cache(maxsize=2)
def _tokenizer(spec: str):
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return Tokenizer.from_str(spec), {}, {}


_PRINTABLE = re.compile(r"[!-~]+")
#: The tokenizer's own split of lower-case printable ASCII.
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
#: ASCII marks at the end, but for apostrophes.
_MARKS = re.compile(r"[!-&(-/:-@\[-`{-~]+$")


def _pieces(word: str) -> list[str]:
    """Parts of a word that the tokenizer encodes independently of each other."""
    if "<|" in word:                                 # may be a special token
        return [word]
    if _PRINTABLE.fullmatch(word):
        return _SPLIT.findall(word.lower())
    core = _MARKS.sub("", word)
    return [core, word[len(core):]] if core != word and core.isalpha() else [word]


def _encode(texts: list[str], spec: str) -> list[bytes]:
    """Ids of each text and its end id, as little-endian numbers of 16 bits where the vocabulary allows (else 32). Spaces and line ends never
    lie in a token of this tokenizer, which drops white space, so the words between them, and the parts of words
    that it splits from each other, are encoded once each."""
    tokenizer, kept, known = _tokenizer(spec)
    kind = "H" if _narrow(spec) else "I"
    words = [t.replace("\n", " ").split(" ") for t in texts]
    for cache, most in ((kept, KEPT), (known, KNOWN)):
        if len(cache) > most:
            cache.clear()
    new = {w: _pieces(w) for w in set().union(*words).difference(kept)}
    parts = list(set().union(*new.values()).difference(known))
    for p, e in zip(parts, tokenizer.encode_batch(parts, add_special_tokens=False)):
        known[p] = array(kind, e.ids).tobytes()
    for w, some in new.items():
        kept[w] = b"".join(map(known.__getitem__, some))
    end = array(kind, [END]).tobytes()
    return [b"".join(map(kept.__getitem__, some)) + end for some in words]


def tokenized(docs: DataFrame, spec: str) -> DataFrame:
    """part, queue, doc_id, before, n, ids: ``before`` counts the queue's tokens ahead in the partition.

    The queue is the row's source, a null source the empty name.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        width = 2 if _narrow(spec) else 4
        ahead: dict[str, int] = {}
        for batch in batches:
            for rows in slices(batch, "text", 8 << 20):
                ids = _encode(rows.column("text").to_pylist(), spec)
                n = [len(x) // width for x in ids]
                before = []
                for q, k in zip(rows.column("queue").to_pylist(), n):
                    before.append(ahead.get(q, 0))
                    ahead[q] = before[-1] + k
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(n), pa.int32()), rows.column("queue"), rows.column("doc_id"),
                     pa.array(before, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                    ["part", "queue", "doc_id", "before", "n", "ids"])
    rows = id_and_text(docs, "source").withColumn("queue", F.coalesce(F.col("source").cast("string"), F.lit("")))
    return rows.select("queue", "doc_id", "text").mapInArrow(run, "part int, queue string, doc_id long, before long, n long, ids binary")


@lru_cache(maxsize=2)
def _narrow(spec: str) -> bool:
    return _tokenizer(spec)[0].get_vocab_size(with_added_tokens=True) <= 1 << 16


class Mixture:
    """Where the tokens of the queues go. sizes, weights: of the queues, in the order of service."""

    def __init__(self, sizes, weights, window: int):
        self.sizes = np.asarray(sizes, np.int64)
        self.weights = np.asarray(weights, np.float64)
        if len(self.sizes) and not (self.weights > 0).all():
            raise ValueError("weights must be positive")
        self.window, self.total = window, int(self.sizes.sum())
        last = float((self.sizes / self.weights).max()) if len(self.sizes) else 1.0
        self.last = np.float64(np.nextafter(last * (1 + 1e-12) + 1e-12, np.inf))

    def _sent(self, t: np.ndarray) -> np.ndarray:
        return np.minimum(self.sizes, np.floor(t[:, None] * self.weights).astype(np.int64))

    def sent_before(self, windows: np.ndarray) -> np.ndarray:
        """Tokens of each queue in all windows before the given ones: an array (window, queue)."""
        target = np.clip(windows * self.window, 0, self.total)
        low = np.zeros(len(target), np.int64)                    # bits of doubles, which order like them
        high = np.full(len(target), self.last.view(np.int64))
        while (high - low > 1).any():                            # sum(low) <= target < sum(high), or at the end
            mid = low + (high - low) // 2
            under = self._sent(mid.view(np.float64)).sum(axis=1) <= target
            low, high = np.where(under, mid, low), np.where(under, high, mid)
        sent = self._sent(low.view(np.float64))
        due = self._sent(high.view(np.float64)) - sent           # due at the same moment: in queue order
        left = (target - sent.sum(axis=1))[:, None]
        done = np.cumsum(due, axis=1) - due
        return sent + np.clip(left - done, 0, due)

    def place(self, queue: np.ndarray, begin: np.ndarray, n: np.ndarray):
        """Pieces (row, start in the row, length, position in the packed stream) of rows of tokens."""
        def due(x):                                              # tokens due with token x, but for ties and rounding
            return self._sent((x + 1) / self.weights[queue]).sum(axis=1)
        off = len(self.sizes) + 1
        first, last = np.maximum((due(begin) - off) // self.window - 1, 0), (due(begin + n - 1) + off) // self.window + 2
        count = last - first
        row = np.repeat(np.arange(len(n)), count)
        w = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
        need = np.unique(np.concatenate([w, w + 1]))
        sent = self.sent_before(need)
        at = np.searchsorted(need, w)
        here, there = sent[at], sent[at + 1]      # w and w + 1 are neighbours in ``need``
        q = queue[row]
        i = np.arange(len(row))
        a, b = np.maximum(begin[row], here[i, q]), np.minimum((begin + n)[row], there[i, q])
        ahead = np.cumsum(there - here, axis=1) - (there - here)
        some = b > a
        position = w * self.window + ahead[i, q] + a - here[i, q]
        return row[some], (a - begin[row])[some], (b - a)[some], position[some]


def cut_points(total: int, size: int = SEQUENCE) -> np.ndarray:
    """Starts of the sequences behind the last full one: the rest as falling powers of two; and the end."""
    at, out = total - total % size, []
    while at < total:
        out.append(at)
        at += 1 << ((total - at).bit_length() - 1)
    return np.array([*out, total], np.int64)


def sequences(start: np.ndarray, length: np.ndarray, total: int, size: int = SEQUENCE):
    """Cut pieces at sequence ends: (index of the piece, shift, length, sequence, offset)."""
    tail = cut_points(total, size)
    full = total // size

    def number(p):
        return np.where(p < tail[0], p // size, full + np.searchsorted(tail, p, side="right") - 1)

    def begin(s):
        return np.where(s < full, s * size, tail[np.clip(s - full, 0, len(tail) - 1)])
    first, last = number(start), number(start + length - 1)
    count = last - first + 1
    piece = np.repeat(np.arange(len(start)), count)
    s = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    a = np.maximum(start[piece], begin(s))
    b = np.minimum((start + length)[piece], begin(s + 1))
    return piece, a - start[piece], b - a, s, a - begin(s)


def pack(docs: DataFrame, spec: str | None = None, weights: dict[str, float] | None = None, window: int = WINDOW,
         with_ids: bool = False) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source[, ids].

    ``spec``: a tokenizer's JSON, the public word tokenizer where it is not given; ``weights``: target
    proportion of each source, its token count where it is not given. Null and empty texts are one
    end id. Rows that repeat are packed each; null ids stay null. An empty table gives no piece.
    Other columns are ignored.
    """
    if spec is None:
        import public_tokenizers
        with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
            spec = f.read()
    rows = stored(tokenized(docs, spec), "packing-tokens")
    by_part = rows.groupBy("queue", "part").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = stored(by_part.select("queue", "part", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("begin")), "packing-begins")
    sizes = begins.groupBy("queue").agg(F.sum("n").alias("n")).orderBy("queue").limit(MAX_QUEUES + 1).collect()
    if len(sizes) > MAX_QUEUES:
        raise ValueError(f"more than {MAX_QUEUES} sources: group them before packing")
    names = {r.queue: i for i, r in enumerate(sizes)}
    n = [r.n for r in sizes]
    mixture = Mixture(n, [(weights or {}).get(q, n[i]) for q, i in names.items()], window * SEQUENCE)
    kind = "<u2" if _narrow(spec) else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            queue = np.array([names[q] for q in batch.column("queue").to_pylist()])
            size = batch.column("n").to_numpy()
            row, start, length, position = mixture.place(queue, batch.column("at").to_numpy(), size)
            piece, shift, length, number, offset = sequences(position, length, mixture.total)
            row, start = row[piece], start[piece] + shift
            ids = [np.frombuffer(x.as_buffer(), kind).astype("<u4") for x in batch.column("ids")]
            parts = [ids[r][a:a + k] for r, a, k in zip(row, start, length)]
            out = {"doc_id": batch.column("doc_id").take(pa.array(row)), "start": pa.array(start), "length": pa.array(length),
                   "ids_crc32": pa.array([zlib.crc32(p) for p in parts], pa.int64()), "doc_tokens": pa.array(size[row]),
                   "sequence_id": pa.array(number), "offset": pa.array(offset), "source": batch.column("queue").take(pa.array(row))}
            if with_ids:
                out["ids"] = pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))
    placed = rows.join(begins.drop("n"), ["queue", "part"]).select("queue", "doc_id", "n", "ids", (F.col("begin") + F.col("before")).alias("at"))
    return placed.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"
                             + (", ids array<int>" if with_ids else ""))
