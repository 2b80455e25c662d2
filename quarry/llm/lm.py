"""Language-model scoring by online logistic context mixing.

A text is its UTF-8 bytes and an end; each of the 256 bytes and the end is a class of its own, coded as
the binary decisions on its way down a Huffman tree. Bit predictors, one for each context (the last 2, 3
or 5 classes, and the word so far), hold the log odds of every decision, learned by counting all training
documents: every (context, class) cell that occurs is counted by itself, under the whole context (the
last classes, 9 bits each) or a 52-bit hash of the word so far. So the model grows with the training text.

The model is nowhere in one place. Texts are dealt into parts of about ``DEAL`` bytes. A part gives its
distinct cells with their training counts; the cells meet by context in as many buckets as there are
parts, where the counts are added up and become odds; and each part gets back the odds of its own cells,
without the cells: it finds them again, in the same order.

Scoring is online: the predictors' odds are mixed by weights that a gate (the depth in the tree) selects,
the mix is refined by an adaptive probability map, and weights and map learn from every bit as it is
coded. Weights and maps start afresh with every text, so its score does not depend on the rows beside it,
and go on to its end. Texts of a part, of like length, are the lanes of one vectorised loop, ``LANES`` or more where
the part has them. Their decisions are laid out step by step, ``BLOCK`` at a time, so that a loop holds little beside the
texts and the part's odds, however long the texts are. All of every text is coded; the sum is the log probability of the
text under a proper distribution.

Beside it stands the unigram base score: words by 64-bit hash, training counts by a grouped sum. The
``COMMON`` most frequent words' counts are sent to the workers; all other words of a document are
joined with the counts.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, crc_mod, id_and_text, mix64, slices, small_batches, stored, text_buffer
from .minhash_dedup import word_hashes

#: The end and all bytes.
CLASSES = 257
#: Four contexts: the number of classes before (0: the word so far).
CONTEXTS = [2, 3, 5, 0]
#: Symbols after which weights and maps start afresh: more than any text has.
SEGMENT = 1 << 62
#: Bytes of text of a part, about: its distinct cells cross the network twice.
DEAL = 16 << 20
#: Bytes of text that a worker codes in one loop, about: more if these are fewer than LANES texts.
LOOP = 6 << 20
LANES = 2000
#: Bytes of text whose contexts are made together.
PART = 1 << 17
#: Decisions of all lanes that are laid out together, about.
BLOCK = 1 << 19
#: Words whose counts every worker gets: 16 bytes each.
COMMON = 1 << 18
_SCALE = 12.0            # table steps of the log odds
_RATE, _START = 0.04, 0.36
_GATES = 6
_BINS = 24               # of the adaptive map, over log odds -8 to 8
_LEAF = 9                # bits of a class; a cell is 2 bits for the context's kind, 52 for the context, 9 for the class's leaf
_CELLS = 1 << 18         # cells that become odds together


# ---------------------------------------------------------------- words (the base score)

def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = []
    ends = 0
    for batch in batches:
        for part in slices(batch, "text"):
            h, _ = word_hashes(*text_buffer(part.column("text")))
            got.append(np.unique(h, return_counts=True))
            ends += part.num_rows
            if len(got) >= 64:
                got = [_added(got)]
    if got:
        words, n = _added(got)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(words, _END).view(np.int64)), pa.array(np.append(n, ends))], ["word", "n"])


_END = np.uint64(0x656E64)    # the end token's place among the word hashes


def _added(got):
    words = np.concatenate([w for w, _ in got])
    order = np.argsort(words)
    words = words[order]
    new = np.flatnonzero(np.concatenate([np.ones(min(len(words), 1), bool), words[1:] != words[:-1]]))
    n = np.concatenate([n for _, n in got])[order]
    return words[new], np.add.reduceat(n, new).astype(np.int64) if len(new) else np.zeros(0, np.int64)


# ---------------------------------------------------------------- symbols and contexts

class Alphabet:
    """Classes of bytes and the Huffman tree over them, from training counts of bytes and ends."""

    def __init__(self, n_bytes: np.ndarray, n_ends: int):
        order = np.lexsort((np.arange(256), -n_bytes))
        self.cls = np.zeros(256, np.int64)
        self.cls[order] = np.arange(1, CLASSES)
        self.rest = np.zeros(256)                               # log10 p(byte | its class)
        n = np.append(n_ends, n_bytes[order]).astype(np.int64)
        tick = itertools.count(CLASSES)
        heap = [(int(c) + 1, i, i) for i, c in enumerate(n)]
        heapq.heapify(heap)
        left, right = {}, {}
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            k = next(tick)
            left[k], right[k] = a[2], b[2]
            heapq.heappush(heap, (a[0] + b[0], k, k))
        root = heap[0][2]                                       # nodes: the root is 0, others by height
        paths = [[] for _ in range(CLASSES)]
        self.leaf = np.zeros(CLASSES, np.int64)                 # classes from left to right
        self.span = np.zeros((CLASSES - 1, 3), np.int64)        # leaves below a node: where side 0 and side 1 begin, and the end

        def walk(at, path, low):
            if at < CLASSES:
                paths[at], self.leaf[at] = path, low
                return low + 1
            mid = walk(left[at], path + [(root - at, 0)], low)
            high = walk(right[at], path + [(root - at, 1)], mid)
            self.span[root - at] = low, mid, high
            return high
        walk(root, [], 0)
        self.symbol = np.argsort(self.leaf)
        self.length = np.array([len(p) for p in paths])
        self.begin = np.cumsum(self.length) - self.length
        self.node = np.array([x for p in paths for x, _ in p], np.int32)
        self.meta = np.array([min(i, _GATES - 1) << 1 | b for p in paths for i, (_, b) in enumerate(p)], np.uint8)


def _symbols(cls: np.ndarray, buf: np.ndarray, offsets: np.ndarray):
    """Classes of the texts with an end each, and where each text's begin."""
    begin = offsets + np.arange(len(offsets))
    out = np.zeros(begin[-1], np.int16)
    at = np.ones(begin[-1], bool)
    at[begin[1:] - 1] = False
    out[at] = cls.astype(np.int16)[buf]
    return out, begin


def _row(kind: int, sym: np.ndarray, begin: np.ndarray, white: np.ndarray) -> np.ndarray:
    """Each symbol's context of a kind, as a number. Before a text stand ends."""
    order = CONTEXTS[kind]
    if order:
        place = np.arange(len(sym)) - np.repeat(begin[:-1], np.diff(begin))
        ctx = np.zeros(len(sym), np.int64)
        for k in range(order, 0, -1):
            ctx <<= _LEAF
            ctx[k:] |= np.where(place[k:] >= k, sym[:max(len(sym) - k, 0)], 0)
    else:
        # hash of the word so far: sums of powers since the last white symbol, times its inverse
        stop = white[sym] | (sym == 0)
        last = np.maximum.accumulate(np.where(np.concatenate([[True], stop[:-1]]), np.arange(len(sym)), 0))
        total = np.zeros(len(sym) + 1, np.uint64)
        np.cumsum((sym + 1).astype(np.uint64) * _power(_Q, len(sym)), out=total[1:])
        ctx = (mix64((total[:-1] - total[last]) * _power(_Q_INV, len(sym))[last]) >> np.uint64(12)).astype(np.int64)
    ctx |= kind << 52
    return ctx


def _rows(sym: np.ndarray, begin: np.ndarray, white: np.ndarray) -> list[np.ndarray]:
    return [_row(kind, sym, begin, white) for kind in range(len(CONTEXTS))]


_Q = np.uint64(0x9E3779B97F4A7C15)
_Q_INV = np.uint64(pow(int(_Q), -1, 2**64))


def _power(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.cumprod(p)


def _byte_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros(257, np.int64)
    for batch in batches:
        buf, _ = text_buffer(batch.column("text"))
        n[:256] += np.bincount(buf, minlength=256)
        n[256] += batch.num_rows
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(257, dtype=np.int32)), pa.array(n)], ["byte", "n"])


def _cells(alphabet: Alphabet, white: np.ndarray, buf: np.ndarray, offsets: np.ndarray, held: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells of the texts, sorted, and how often each occurs in those that are not held out."""
    sym, begin = _symbols(alphabet.cls, buf, offsets)
    held = np.zeros(len(offsets) - 1, bool) if held is None else held
    cells, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for kind in range(len(CONTEXTS)):                          # one kind after the other: 8 bytes a symbol are held at once
        raw = np.empty(len(sym), np.uint64)
        for i, j in _stretches(begin, PART):
            some = slice(begin[i], begin[j])
            cell = _row(kind, sym[some], begin[i:j + 1] - begin[i], white) << _LEAF | alphabet.leaf[sym[some]]
            raw[some] = cell << 1 | np.repeat(held[i:j], np.diff(begin[i:j + 1]))
        raw.sort()
        learned = (raw.astype(np.uint8) & 1) ^ 1
        raw >>= np.uint64(1)
        new = np.ones(len(raw), bool)
        np.not_equal(raw[1:], raw[:-1], out=new[1:])
        first = np.flatnonzero(new)
        cells.append(raw[first].view(np.int64))
        counts.append(np.add.reduceat(learned, first, dtype=np.int64) if len(first) else np.zeros(0, np.int64))
    return np.concatenate(cells), np.concatenate(counts)


def _stretches(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``limit`` bytes, one text at least."""
    i = 0
    while i < len(offsets) - 1:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j
        i = j


class Counts:
    """Training counts of cells (sorted), and the log odds that follow from them."""

    def __init__(self, alphabet: Alphabet, cells: np.ndarray, n: np.ndarray):
        self.alphabet, self.cells, self.total = alphabet, cells, np.concatenate([[0], np.cumsum(n)])

    def odds(self, context: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The odds of decisions at nodes, in steps of 1 / _SCALE."""
        low, mid, high = (self.total[np.searchsorted(self.cells, (context << _LEAF) + x)] for x in self.alphabet.span[node].T)
        return np.rint(np.clip(np.log((high - mid + 0.4) / (mid - low + 0.4)) * _SCALE, -127, 127)).astype(np.int8)

    def __getitem__(self, at: tuple) -> np.int8:
        return self.odds(np.array([at[0]]), np.array([at[1]]))[0]

    def found(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The odds of all decisions of each of the cells (sorted): where each one's begin, and they."""
        a, flat = self.alphabet, []
        count = a.length[a.symbol[cells & (1 << _LEAF) - 1]]
        for s in range(0, len(cells), _CELLS):
            some, n = cells[s:s + _CELLS], count[s:s + _CELLS]
            path = np.repeat(a.begin[a.symbol[some & (1 << _LEAF) - 1]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            flat.append(self.odds(np.repeat(some >> _LEAF, n), a.node[path]))
        return np.cumsum(count) - count, np.concatenate([np.zeros(0, np.int8), *flat])


class Found:
    """Cells, and the odds of each one's decisions: those of cell i from flat[begin[i]] on."""

    def __init__(self, cells: np.ndarray, begin: np.ndarray, flat: np.ndarray):
        """The cells by the leading bits of their hashes, and where each value of these begins."""
        self.flat = flat
        bits = len(cells).bit_length()
        self.shift = np.uint64(64 - max(bits, 1))
        low = (np.uint64(1) << self.shift) - np.uint64(1)
        key = mix64(cells.view(np.uint64))
        key &= ~low
        key |= np.arange(len(cells), dtype=np.uint64)
        key.sort()
        self.first = np.concatenate([np.searchsorted(key, np.arange(i, min(i + _CELLS, 1 << bits), dtype=np.uint64) << self.shift).astype(np.int32)
                                     for i in range(0, 1 << bits, _CELLS)])
        key &= low
        self.cells, self.begin = cells[key], begin[key]

    def places(self, cells: np.ndarray) -> np.ndarray:
        """Where the odds of each of some of the cells begin."""
        at = self.first.take((mix64(cells.view(np.uint64)) >> self.shift).view(np.int64))
        left = np.flatnonzero(self.cells.take(at) != cells)
        while len(left):
            at[left] += 1
            left = left[self.cells.take(at[left]) != cells[left]]
        return self.begin.take(at)


class Model:
    """What scoring needs: the alphabet, and the odds or the counts behind them."""

    def __init__(self, alphabet: Alphabet, white: np.ndarray, table: Counts | Found):
        self.alphabet, self.white, self.table = alphabet, white, table


def _alphabet(text: DataFrame) -> tuple[Alphabet, np.ndarray]:
    counts = text.mapInArrow(_byte_counts, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(257, np.int64)
    for r in counts:
        n[r.byte] = r.n
    alphabet = Alphabet(n[:256], int(n[256]))
    white = np.zeros(CLASSES, bool)
    white[alphabet.cls[[9, 10, 11, 12, 13, 32]]] = True
    return alphabet, white


def train(docs: DataFrame) -> Model:
    """The model of all rows of ``docs`` (doc_id, text) in one place: for small tables. :func:`score` does not gather it."""
    small_batches(docs.sparkSession)
    text = id_and_text(docs).select("text")
    alphabet, white = _alphabet(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, n = _cells(alphabet, white, *text_buffer(batch.column("text")))
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(n)], ["cell", "n"])
    got = text.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).orderBy("cell").toArrow()
    return Model(alphabet, white, Counts(alphabet, got.column("cell").to_numpy(), got.column("n").to_numpy()))


# ---------------------------------------------------------------- scoring

class _Lanes:
    """Texts coded together, those with most decisions first, and what of their decisions comes next."""

    def __init__(self, model: Model, table: Found, buf: np.ndarray, offsets: np.ndarray):
        a = model.alphabet
        self.model, self.table = model, table
        self.length = a.length.astype(np.uint8)
        self.longest = int(a.length.max())
        self.sym, begin = _symbols(a.cls, buf, offsets)
        count = self.length[self.sym]
        many = int(count.sum(dtype=np.int64))
        self.past = np.zeros(len(count) + 1, np.int32 if many < 1 << 30 else np.int64)         # decisions before each symbol
        np.cumsum(count, dtype=self.past.dtype, out=self.past[1:])
        size = np.diff(self.past[begin]).astype(np.int64)
        self.order = np.argsort(-size, kind="stable")
        self.size = size[self.order]
        self.begin, self.stop = begin[:-1][self.order], begin[1:][self.order]
        self.next = self.begin.copy()                                                          # first symbol not yet laid out
        self.word = np.zeros(len(size), np.uint64), np.ones(len(size), np.uint64)              # sum of the word so far, power of its length
        self.rest = np.zeros((self.longest, len(size)), np.int32), np.zeros((self.longest, len(size)), np.uint8)

    def rows(self, k: int, at: np.ndarray, many: np.ndarray) -> list[np.ndarray]:
        """As :func:`_row`, for the next ``many`` symbols of each of the first ``k`` lanes, at ``at``."""
        sym = self.sym[at]
        place = at - np.repeat(self.begin[:k], many)
        early = bool((place < max(CONTEXTS)).any())                                            # some text's first symbols are here
        out, ctx = {}, np.zeros(len(at), np.int64)
        for b in range(1, max(CONTEXTS) + 1):
            back = self.sym.take(at - b, mode="clip").astype(np.int64)
            if early:
                back[place < b] = 0
            back <<= _LEAF * (b - 1)
            ctx |= back
            if b in CONTEXTS:
                out[b] = ctx.copy()
        end = np.cumsum(many)
        first = end - many
        stop = self.model.white[sym] | (sym == 0)
        fresh = np.zeros(len(at) + 1, bool)
        fresh[1:] = stop
        fresh[first] = True
        last = np.maximum.accumulate(np.where(fresh[:-1], np.arange(len(at)), 0))
        power, inverse = _power(_Q, len(at) + 1), _power(_Q_INV, len(at) + 1)
        total = np.zeros(len(at) + 1, np.uint64)
        np.cumsum((sym + 1).astype(np.uint64) * power[:-1], out=total[1:])
        value = (total[:-1] - total[last]) * inverse[last]
        held, factor = self.word
        going = np.flatnonzero(last == np.repeat(first, many))                                 # in the word that the lane was in
        lane = np.repeat(np.arange(k), many)[going]
        value[going] = held[lane] + factor[lane] * value[going]
        out[0] = (mix64(value) >> np.uint64(12)).astype(np.int64)
        some = np.flatnonzero(many)
        begun, end = last[end[some] - 1], end[some]
        same = begun == first[some]
        whole = (total[end] - total[begun]) * inverse[begun]
        over = stop[end - 1]
        held[some] = np.where(over, np.uint64(0), np.where(same, held[some] + factor[some] * whole, whole))
        factor[some] = np.where(over, np.uint64(1), np.where(same, factor[some], np.uint64(1)) * power[end - begun])
        return [out[order] | kind << 52 for kind, order in enumerate(CONTEXTS)]

    def block(self, k: int, done: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """Odds (four bytes as one value) and meta (gate and bit) of steps from ``done`` on, a row a step, of the first ``k`` lanes."""
        a, table = self.model.alphabet, self.table
        odds, meta = np.zeros((steps + self.longest, k), np.int32), np.zeros((steps + self.longest, k), np.uint8)
        odds[:self.longest], meta[:self.longest] = self.rest[0][:, :k], self.rest[1][:, :k]
        base = self.past[self.begin[:k]]
        to = np.minimum(np.searchsorted(self.past, (base + (done + steps)).astype(self.past.dtype)), self.stop[:k])
        many = np.maximum(to - self.next[:k], 0)
        at = np.repeat(self.next[:k] - np.cumsum(many) + many, many) + np.arange(many.sum())
        sym = self.sym[at]
        leaf = a.leaf[sym]
        count = self.length[sym]
        order = np.argsort(~count, kind="stable")                                              # long codes first
        found = np.empty((len(at), len(CONTEXTS)), table.begin.dtype)
        for kind, row in enumerate(self.rows(k, at, many)):
            found[:, kind] = table.places(row << _LEAF | leaf)[order]
        place = ((self.past[at] - np.repeat(base + done, many)).astype(np.int64) * k + np.repeat(np.arange(k), many))[order]
        path = a.begin[sym[order]]
        left = np.cumsum(np.bincount(count, minlength=self.longest + 1)[::-1])[::-1]           # symbols of at least so many decisions
        for depth in range(self.longest):
            m = left[depth + 1]
            if not m:
                break
            where = place[:m]
            odds.reshape(-1)[where] = table.flat.take(found[:m]).reshape(-1).view(np.int32)
            meta.reshape(-1)[where] = a.meta.take(path[:m])
            place += k
            path += 1
            found += 1
        self.next[:k] += many
        self.rest = odds[steps:], meta[steps:]
        return odds[:steps], meta[:steps]


def _code(model: Model, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """log10 probability of each text."""
    n = len(offsets) - 1
    if not n:
        return np.zeros(0)
    table = model.table
    if isinstance(table, Counts):
        cells, _ = _cells(model.alphabet, model.white, buf, offsets)
        table = Found(cells, *table.found(cells))
    lanes = _Lanes(model, table, buf, offsets)
    weight = np.full((n * _GATES, len(CONTEXTS)), _START / _SCALE, np.float32).view(np.complex128).reshape(-1)   # four weights as one value
    grid = (np.arange(_BINS) - (_BINS - 1) / 2) * (16 / _BINS)
    refined = np.tile((1 / (1 + np.exp(-grid))).astype(np.float32), n * _GATES)
    spent = np.zeros(n)
    one, learn, low, high, scale, middle, step = (np.array(x, np.float32) for x in (1, _RATE / _SCALE**2, -7.99, 7.99, _BINS / 16, _BINS / 2, 0.02))
    rising, done = lanes.size[::-1], 0
    while done < lanes.size[0]:
        k = n - int(np.searchsorted(rising, done, side="right"))                               # lanes with decisions left
        steps = int(min(max(BLOCK // k, 64), 1 << 13, lanes.size[0] - done))
        odds, meta = lanes.block(k, done, steps)
        active = (n - np.searchsorted(rising, np.arange(done, done + steps), side="right")).tolist()
        x_all = odds.view(np.int8).reshape(steps, k, -1).astype(np.float32)
        bits = (meta & 1).astype(np.float32)
        owns = (meta >> 1) + np.arange(k) * _GATES
        bins = owns * _BINS
        got = np.zeros((steps, k), np.float32)
        twice = np.empty((k, 2), np.float32)
        four = np.empty((k, 2), np.float64)
        for j, k in enumerate(active):
            x, bit, own = x_all[j, :k], bits[j, :k], owns[j, :k]
            w = weight.take(own).view(np.float32).reshape(k, -1)
            v = w * x
            v = v[:, ::2] + v[:, 1::2]
            z = v[:, 0] + v[:, 1]
            np.maximum(z, low, out=z)
            np.minimum(z, high, out=z)
            p = np.negative(z)
            np.exp(p, out=p)
            p += one
            np.divide(one, p, out=p)
            z *= scale
            z += middle
            place = z.astype(np.int64)
            place += bins[j, :k]
            r = refined.take(place)
            np.add(p, r, out=got[j, :k])
            np.subtract(bit, p, out=p)
            p *= learn
            twice[:k, 0] = p
            twice[:k, 1] = p
            four[:k] = twice[:k].view(np.float64)                                              # the step of all four weights
            x *= four[:k].view(np.float32)
            w += x
            weight[own] = w.reshape(-1).view(np.complex128)
            np.subtract(bit, r, out=z)
            z *= step
            r += z
            refined[place] = r
        got *= np.float32(0.5)                                                                 # the mix and its refinement
        got += bits
        got -= one
        np.abs(got, out=got)
        over = np.arange(steps)[:, None] >= lanes.size[:got.shape[1]] - done
        got[over] = 1
        np.log(got, out=got)
        spent[:got.shape[1]] += got.sum(axis=0, dtype=np.float64)
        done += steps
    out = np.empty(n)
    out[lanes.order] = spent / np.log(10)
    return out


def _deflated(data: np.ndarray) -> bytes:
    """Bytes, deflated, and before them how many they are."""
    data = np.ascontiguousarray(data).view(np.uint8)
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _inflated(data: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(memoryview(data)[8:], int.from_bytes(data[:8], "little"), "zstd"), np.uint8)


def _packed(x: np.ndarray) -> bytes:
    """Numbers as their differences, byte by byte, deflated."""
    return _deflated(np.diff(x, prepend=0).astype(np.int64).view(np.uint8).reshape(-1, 8).T.reshape(-1))


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(_inflated(data).reshape(8, -1).T).view(np.int64).reshape(-1))


def _packed_counts(n: np.ndarray) -> bytes:
    """Counts as a byte each, those of 255 and more whole behind them, deflated."""
    return _deflated(np.concatenate([np.minimum(n, 255).astype(np.uint8), n[n >= 255].astype(np.int64).view(np.uint8)]))


def _unpacked_counts(data: bytes, many: int) -> np.ndarray:
    data = _inflated(data)
    n = data[:many].astype(np.int64)
    n[n == 255] = np.frombuffer(data[many:].tobytes(), np.int64)
    return n


def _bucket_order(cells: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each cell's context, and the order by bucket."""
    of = (mix64((cells >> _LEAF).astype(np.uint64)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
    return of, np.argsort(of, kind="stable")


def _turned(alphabet: Alphabet, cells: np.ndarray, flat: np.ndarray) -> None:
    """Turn the odds of all decisions of the cells, in place: from those of bit 1 to those of what follows, which are alike within a cell, or back."""
    side = ((alphabet.meta & 1).astype(np.int8) << 1) - np.int8(1)
    at = 0
    for s in range(0, len(cells), _CELLS):
        symbol = alphabet.symbol[cells[s:s + _CELLS] & (1 << _LEAF) - 1]
        n = alphabet.length[symbol]
        path = np.repeat(alphabet.begin[symbol] - np.cumsum(n) + n, n) + np.arange(n.sum())
        flat[at:at + len(path)] *= side[path]
        at += len(path)


def _part_cells(alphabet: Alphabet, white: np.ndarray, buckets: int):
    """A part's distinct cells and how often each occurs in its training rows, a row a bucket of contexts."""
    def run(key: tuple, texts: pa.Table) -> pa.Table:
        held = texts.column("held_out").to_numpy()
        cells, n = _cells(alphabet, white, *text_buffer(texts.column("text")), held)
        of, order = _bucket_order(cells, buckets)
        some, first = np.unique(of[order], return_index=True)
        pieces = np.split(order, first[1:])
        return pa.table({"part": pa.array([key[0].as_py()] * len(some), pa.int32()), "bucket": some.astype(np.int64),
                         "cells": pa.array([_packed(cells[x]) for x in pieces], pa.binary()), "n": pa.array([_packed_counts(n[x]) for x in pieces], pa.binary())})
    return run


def _bucket_odds(alphabet: Alphabet):
    """The odds of the cells of whole contexts, for each part that has the cell."""
    def run(rows: pa.Table) -> pa.Table:
        given = [_unpacked(x) for x in rows.column("cells").to_pylist()]
        cells, at = np.unique(np.concatenate(given), return_inverse=True)
        n = np.bincount(at, np.concatenate([_unpacked_counts(x, len(g)) for x, g in zip(rows.column("n").to_pylist(), given)]), len(cells)).astype(np.int64)
        begin, flat = Counts(alphabet, cells[n > 0], n[n > 0]).found(cells)
        _turned(alphabet, cells, flat)
        length = np.diff(begin, append=len(flat))
        odds = []
        for x in np.split(at, np.cumsum([len(g) for g in given])[:-1]):
            count = length[x]
            odds.append(_deflated(flat[np.repeat(begin[x] - np.cumsum(count) + count, count) + np.arange(count.sum())]))
        return pa.table({"part": rows.column("part"), "bucket": rows.column("bucket"), "odds": pa.array(odds, pa.binary())})
    return run


def _score(alphabet: Alphabet, white: np.ndarray, common, buckets: int):
    def run(key: tuple, t: pa.Table, odds: pa.Table) -> pa.Table:
        words, counts = common.value
        t = t.take(pc.sort_indices(pc.binary_length(t.column("text"))))
        buf, offsets = text_buffer(t.column("text"))
        cells, _ = _cells(alphabet, white, buf, offsets)
        _, order = _bucket_order(cells, buckets)
        flat = np.concatenate([np.zeros(0, np.uint8), *map(_inflated, odds.sort_by("bucket").column("odds").to_pylist())]).view(np.int8)
        count = alphabet.length.astype(np.uint8)[alphabet.symbol[cells[order] & (1 << _LEAF) - 1]]
        if len(flat) != count.sum(dtype=np.int64):
            raise RuntimeError("the odds are not those of this part's texts: the rows were dealt anew")
        _turned(alphabet, cells[order], flat)
        begin = np.empty(len(cells), np.int32 if len(flat) < 1 << 31 else np.int64)
        begin[order] = np.cumsum(count, dtype=begin.dtype) - count
        del odds, order, count
        model = Model(alphabet, white, Found(cells, begin, flat))
        limit = max(LOOP, LANES * int(np.diff(offsets).max(initial=0)))
        score = np.concatenate([_code(model, buf[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]) for i, j in _stretches(offsets, limit)])
        del model, cells, flat, begin
        h, n = (np.concatenate(x) for x in zip(*[(g, np.diff(at)) for g, at in (word_hashes(buf[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                                                                               for i, j in _stretches(offsets, SLICE_BYTES))]))
        doc = np.repeat(np.arange(len(n)), n)
        found = np.minimum(np.searchsorted(words, h), max(len(words) - 1, 0))
        is_common = words[found] == h if len(words) else np.zeros(len(h), bool)
        logs = np.where(is_common, np.log10(counts[found] + 1.0), 0) if len(words) else np.zeros(len(h))
        rare, rare_doc = h[~is_common], doc[~is_common]
        cut = np.searchsorted(rare_doc, np.arange(len(n) + 1))
        return pa.table(
            [pa.array((key[0].as_py() << 40) + np.arange(len(n))), t.column("doc_id"), t.column("held_out"), pa.array(n + 1), pa.array(np.diff(offsets)),
             pa.array(np.bincount(doc[is_common], minlength=len(n))), pa.array(np.bincount(doc, logs, len(n)).astype(np.float64)), pa.array(score),
             pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(rare.view(np.int64)))],
            ["key", "doc_id", "held_out", "n_tokens", "bytes", "known", "logs", "score", "rare"])
    return run


def _dealt(rows: DataFrame) -> tuple[DataFrame, int]:
    """The rows with the part of each: texts of like length, about DEAL bytes a part; and the number of parts.

    Not stored: one exchange by part serves both passes over the texts.
    """
    size = F.octet_length("text") + 1
    kind = F.floor(F.log2(size) * 4).cast("int")
    sizes = rows.groupBy(kind.alias("kind")).agg(F.sum(size).alias("n")).orderBy(F.desc("kind")).collect()
    first, many, parts, i = [], [], 0, 0
    while i < len(sizes):
        j, n = i, 0
        while j < len(sizes) and n < DEAL:
            n += sizes[j].n
            j += 1
        for r in sizes[i:j]:
            first += [F.lit(r.kind), F.lit(parts)]
            many += [F.lit(r.kind), F.lit(-(-n // DEAL))]
        parts += -(-n // DEAL)
        i = j
    if not parts:
        return rows.withColumn("part", F.lit(0)), 1
    nth = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.element_at(F.create_map(*many), kind))
    return rows.withColumn("part", (F.element_at(F.create_map(*first), kind) + nth).cast("int")), parts


def score(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Learns from the rows whose crc32(doc_id as text) mod 7 is not 2; a null id counts as the empty text.
    Null texts are empty: one end token. Without training rows no token is known and the model's odds are
    even. Repeated rows count and are scored each. bits_per_byte is null for empty texts. Other columns
    are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = id_and_text(docs).withColumn("held_out", crc_mod(F.col("doc_id"), 7) == 2)
    learned = rows.where("not held_out")
    counts = stored(learned.select("text").mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm-words")
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    tokens, distinct = total.n or 0, total.v
    ends = counts.where(F.col("word") == int(_END)).agg(F.sum("n")).first()[0] or 0
    top = counts.orderBy(F.desc("n"), "word").limit(COMMON).toArrow()
    words = top.column("word").to_numpy().view(np.uint64)
    order = np.argsort(words)
    common = spark.sparkContext.broadcast((words[order], top.column("n").to_numpy()[order]))
    alphabet, white = _alphabet(learned.select("text"))
    texts, parts = _dealt(rows.select("doc_id", "held_out", "text"))
    cells = texts.groupBy("part").applyInArrow(_part_cells(alphabet, white, parts), "part int, bucket long, cells binary, n binary")
    odds = cells.groupBy("bucket").applyInArrow(_bucket_odds(alphabet), "part int, bucket long, odds binary")
    done = stored(texts.groupBy("part").cogroup(odds.groupBy("part")).applyInArrow(
        _score(alphabet, white, common, parts), "key long, doc_id long, held_out boolean, n_tokens long, bytes long, known long, logs double, score double, rare array<long>"), "lm-scores")
    common.unpersist()
    rest = (done.select("key", F.explode("rare").alias("word")).groupBy("key", "word").agg(F.count("*").alias("tf"))
            .join(counts, "word").groupBy("key").agg(F.sum("tf").alias("more"), F.sum(F.col("tf") * F.log10(F.col("n") + 1)).alias("more_logs")))
    out = done.join(rest, "key", "left")
    norm = float(np.log10(tokens + distinct + 1))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0)) + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) + F.lit(float(np.log10(ends + 1))) - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        "score", F.when(F.col("bytes") > 0, -F.col("score") * F.lit(float(np.log2(10))) / F.col("bytes")).alias("bits_per_byte"))
