"""Cross-tokenizer alignment with whitespace-token anchors.

Every text is tokenised as a whole by A (byte-level BPE, of a blank and the text) and by B (sentencepiece BPE
with byte fallback, which adds the blank itself). Both token sequences are places in the same bytes. Where an
A and a B token both end before tokens that begin with a blank, and the bytes of both are verified to be the text's, an
anchor cuts the text into windows of token ids. The alignment of a window follows from its ids alone, so a worker
keeps it by the tuple of A and B ids; a new window is aligned once.

An alignment has groups (between neighbouring shared ends) and links (an A and a B token that end together). Spark
counts each pair of ids over all links. Counts go back to the documents in two ways: pairs that hold at
least one in ``HOT`` of all links (so ``HOT`` pairs at most) are sent to the workers, the others are joined by
pair, of which none can then be hot.

For speed only, texts are encoded in parts: before a blank between printable ASCII neither tokenizer has a token
that crosses (checked against B's pieces, known of A's pattern), and a worker keeps the ids of the
parts it has met (``KEPT`` at most, then it starts anew).
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_characters
from .common import id_and_text, slices, small_batches, stored, text_buffer

KEPT = 400_000
#: Most pairs whose counts are sent to the workers (17 bytes each).
HOT = 1 << 19
#: B ids take this many bits of a pair.
_B_BITS = 32
_MARK = "▁"
_CUT = re.compile(r"(?<=[!-~])(?= [!-~])")
#: Letters up to here have the same classes in every version of Unicode that libraries know.
_LATIN = "ɏ"
_APART = b"\xff\xff\xff\xff"
# ---- fixed value: the split of byte-level pre-tokenizers ----
_BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# --------------------------------------------------------------


def _a_tokens(spec: dict) -> list[bytes]:
    back = {c: b for b, c in enumerate(byte_characters())}
    special = {t["id"] for t in spec.get("added_tokens") or []}
    of = {i: t for t, i in spec["model"]["vocab"].items()}
    return [bytes(back[c] for c in of[i]) if i in of and i not in special else b"" for i in range(max(of) + 1)]


def _plain_ranks(spec: dict, tokens: list[bytes]) -> dict[bytes, int] | None:
    """Ranks for an encoder of ranks, where the merges come in the order of their ids and the split is the usual one."""
    pre = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    vocab = spec["model"]["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    if [vocab.get("".join(m)) for m in merges] != list(range(256, 256 + len(merges))) or sorted(tokens[:256]) != [bytes([b]) for b in range(256)]:
        return None
    return {t: i for i, t in enumerate(tokens) if t}


class Aligner:
    """Both tokenizers and the kept alignments of a worker."""

    def __init__(self, a_json: str, b_model: bytes):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer
        spec = json.loads(a_json)
        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        a_tokens = _a_tokens(spec)
        ranks = _plain_ranks(spec, a_tokens)
        self.fast = tiktoken.Encoding("a", pat_str=_BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}) if ranks else None
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        b_tokens = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.tokens = a_tokens, b_tokens
        self.size = tuple(np.array([len(t) for t in some], np.int64) for some in self.tokens)
        self.bytes = tuple(np.frombuffer(b"".join(some), np.uint8) for some in self.tokens)
        self.names = tuple([str(i) for i in range(len(some))] for some in self.tokens)
        # parts need both: no piece goes on over a mark, no token of A over a blank
        self.parts_hold = self.fast is not None and not any(_MARK in p.lstrip(_MARK) for p in pieces)
        self.parts: dict[str, tuple[bytes, bytes]] = {}
        self.windows: dict[bytes, int] = {}
        self.groups: list[str] = []
        self.links: list[bytes] = []

    def _joined(self, ids: np.ndarray, which: int) -> np.ndarray:
        """The bytes of a sequence of tokens."""
        size = self.size[which]
        at = np.cumsum(size) - size
        n = size[ids]
        return self.bytes[which][np.repeat(at[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    def _encode_a(self, part: str) -> bytes:
        if self.fast is not None and (part.isascii() or max(part) <= _LATIN):
            return array("I", self.fast.encode_ordinary(part)).tobytes()
        return array("I", self.a.encode(part, add_special_tokens=False).ids).tobytes()

    def _learn(self, parts: set[str]) -> None:
        if len(self.parts) > KEPT:
            self.parts.clear()
        new = [p for p in parts if p not in self.parts]
        for p, b in zip(new, self.b.encode([p[1:] for p in new], out_type=int, num_threads=1)):
            self.parts[p] = self._encode_a(p), array("I", b).tobytes()

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Verified ids of A and B of each text; none where a tokenizer doesn't give back its bytes."""
        split = [[] if not t else _CUT.split(" " + t) if self.parts_hold else [" " + t] for t in texts]
        self._learn({p for some in split for p in some})
        out = []
        for some in split:
            got = [self.parts[p] for p in some]
            out.append((b"".join([a for a, _ in got]), b"".join([b for _, b in got])))
        raw = [(" " + t).encode() if t else b"" for t in texts]
        for which in 0, 1:
            bad = self._wrong([x[which] for x in out], raw, which)
            out = [(b"", b"") if r in bad else x for r, x in enumerate(out)]
            raw = [b"" if r in bad else x for r, x in enumerate(raw)]
        return out

    def _wrong(self, ids: list[bytes], raw: list[bytes], which: int) -> set[int]:
        """Texts whose tokens don't join to their bytes."""
        flat = np.frombuffer(b"".join(ids), np.uint32)
        total = np.concatenate([[0], np.cumsum(self.size[which][flat])])
        cut = np.cumsum([0, *(len(x) // 4 for x in ids)])
        size = np.array([len(x) for x in raw], np.int64)
        bad = set(np.flatnonzero(np.diff(total[cut]) != size).tolist())
        if bad:                                             # the others have their places only without these
            good = [r for r in range(len(ids)) if r not in bad]
            return bad | {good[r] for r in self._wrong([ids[r] for r in good], [raw[r] for r in good], which)}
        off = np.flatnonzero(self._joined(flat, which) != np.frombuffer(b"".join(raw), np.uint8))
        return set(np.unique(np.searchsorted(np.cumsum(size), off, side="right")).tolist())

    def align(self, texts: list[str]) -> list[tuple[int, int, str, np.ndarray]]:
        """Of each text: numbers of A and B tokens, its groups as a string, its links as packed pairs of ids."""
        ids = self.encode(texts)
        a_bytes, b_bytes = b"".join([a for a, _ in ids]), b"".join([b for _, b in ids])
        if not a_bytes:
            return [(0, 0, "", np.zeros(0, np.int64))] * len(texts)
        a, b = np.frombuffer(a_bytes, np.uint32), np.frombuffer(b_bytes, np.uint32)
        a_end, b_end = np.cumsum(self.size[0][a]), np.cumsum(self.size[1][b])
        raw, _ = text_buffer(pa.array([" " + t for t, (x, _) in zip(texts, ids) if x]))
        ends = np.zeros(len(raw) + 1, np.uint8)
        ends[a_end] = 1
        ends[b_end] += 1
        shared = np.flatnonzero(ends == 2)
        last_a, last_b = np.searchsorted(a_end, shared), np.searchsorted(b_end, shared)
        n_a = np.array([len(x) // 4 for x, _ in ids])
        text_end = np.cumsum(n_a)                                          # in tokens of A
        anchor = np.append(raw, np.uint8(32))[shared] == 32
        anchor[np.searchsorted(last_a, text_end[n_a > 0] - 1)] = True
        cut = np.flatnonzero(anchor)                                       # the last group of each window
        if len(self.windows) > KEPT:
            self.windows.clear()
            self.groups, self.links = [], []
        pair = a[last_a].astype(np.int64) << _B_BITS | b[last_b]
        a_to, b_to = ((last_a[cut] + 1) * 4).tolist(), ((last_b[cut] + 1) * 4).tolist()
        known = self.windows
        keys = [a_bytes[i:k] + _APART + b_bytes[j:m] for i, k, j, m in zip([0, *a_to], a_to, [0, *b_to], b_to)]
        if not known.keys() >= set(keys):
            self._keep(keys, a.tolist(), b.tolist(), (last_a + 1).tolist(), (last_b + 1).tolist(), cut.tolist(), pair)
        numbers = list(map(known.get, keys))
        first = np.searchsorted(last_a[cut], np.concatenate([[0], text_end])).tolist()
        out = []
        for r, (x, y) in enumerate(ids):
            mine = numbers[first[r]:first[r + 1]]
            out.append((len(x) // 4, len(y) // 4, ";".join([self.groups[w] for w in mine]), np.frombuffer(b"".join([self.links[w] for w in mine]), np.int64)))
        return out

    def _keep(self, keys, a, b, a_to, b_to, cut, pair) -> None:
        """The groups and links of new windows. a_to, b_to: ends of all groups; cut: the last group of each window."""
        known, (a_name, b_name) = self.windows, self.names
        for w, key in enumerate(keys):
            if key in known:
                continue
            known[key] = len(known)
            g0, g1 = (cut[w - 1] + 1 if w else 0), cut[w] + 1
            i, j = (a_to[g0 - 1], b_to[g0 - 1]) if g0 else (0, 0)
            groups = []
            for k, m in zip(a_to[g0:g1], b_to[g0:g1]):
                left = a_name[a[i]] if k - i == 1 else ",".join([a_name[x] for x in a[i:k]])
                right = b_name[b[j]] if m - j == 1 else ",".join([b_name[x] for x in b[j:m]])
                groups.append(left + "|" + right)
                i, j = k, m
            self.groups.append(";".join(groups))
            self.links.append(pair[g0:g1].tobytes())


@lru_cache(maxsize=1)
def _aligner(a_json: str, b_model: bytes) -> Aligner:
    return Aligner(a_json, b_model)


def _files(docs: DataFrame, a_path: str | None, b_path: str | None):
    import public_tokenizers
    with open(a_path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        a = f.read()
    with open(b_path or public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return docs.sparkSession.sparkContext.broadcast((a, f.read()))


def groups(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """row, doc_id, n_a, n_b, groups (``a1,a2|b1;a3|b2,b3``), pairs and times: distinct linked id pairs and how often.

    A pair is the A id times 2^32 plus the B id. ``a_path``, ``b_path``: files of a byte-level BPE in JSON and of a
    sentencepiece model, by default the public ones.
    """
    small_batches(docs.sparkSession)
    files = _files(docs, a_path, b_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, part, seen = _aligner(*files.value), TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in slices(batch, "text"):
                got = aligner.align(rows.column("text").to_pylist())
                found = [np.unique(g[3], return_counts=True) for g in got]
                at = pa.array(np.concatenate([[0], np.cumsum([len(p) for p, _ in found])]), pa.int32())
                out = {"row": pa.array((part << 40) + seen + np.arange(len(got))), "doc_id": rows.column("doc_id"),
                       "n_a": pa.array([g[0] for g in got], pa.int64()), "n_b": pa.array([g[1] for g in got], pa.int64()),
                       "groups": pa.array([g[2] for g in got], pa.string()),
                       "pairs": pa.ListArray.from_arrays(at, pa.array(np.concatenate([p for p, _ in found]))),
                       "times": pa.ListArray.from_arrays(at, pa.array(np.concatenate([n for _, n in found]).astype(np.int32)))}
                seen += len(got)
                yield pa.RecordBatch.from_arrays(list(out.values()), list(out))
    return id_and_text(docs).mapInArrow(run, "row long, doc_id long, n_a long, n_b long, groups string, pairs array<long>, times array<int>")


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs, times and list ends of a batch."""
    pairs, times = batch.column("pairs"), batch.column("times")
    return (pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64),
            np.concatenate([[0], np.cumsum(pairs.value_lengths().to_numpy())]).astype(np.int64))


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of pairs, added up over a few batches at a time."""
    def added(held):
        pairs, at = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
        return pairs, np.bincount(at, np.concatenate([n for _, n in held]), len(pairs)).astype(np.int64)
    held, size = [], 0
    for batch in batches:
        pairs, times, _ = _lists(batch)
        held.append((pairs, times))
        size += len(pairs)
        if size > 1 << 21:
            held = [added(held)]
            size = len(held[0][0])
            if size > 1 << 20:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, held[0])), ["pair", "n"])
                held, size = [], 0
    if size:
        yield pa.RecordBatch.from_arrays(list(map(pa.array, added(held))), ["pair", "n"])


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n (links that hold it), best (n is the highest of its B id)."""
    n = stored(aligned.select("pairs", "times").mapInArrow(_pair_sums, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "align-pairs")
    b = F.col("pair").bitwiseAND(F.lit((1 << _B_BITS) - 1))
    most = n.groupBy(b.alias("b")).agg(F.max("n").alias("most"))          # one row a B id: the vocabulary bounds it
    return n.withColumn("b", b).join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def report(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, hot: int = HOT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    A link is a pair of tokens that end together, so each group holds one: its last tokens.
    Null and empty texts, and texts whose bytes a tokenizer doesn't give back, have zeros and an empty hash. Special
    tokens in a text are plain text. Rows that repeat count each; null ids stay null; an empty table gives no row;
    other columns are ignored. A task needs about 200 bytes a character of its longest text without blanks.
    """
    found = groups(docs, a_path, b_path).withColumn("groups_sha256", F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups"), 256)))
    rows = stored(found.drop("groups"), "align-rows")
    counts = stored(pair_counts(rows), "align-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    known = counts.where(F.col("n") * hot >= total).orderBy("pair").toArrow().combine_chunks()
    sent = docs.sparkSession.sparkContext.broadcast(tuple(known.column(c).to_numpy() for c in ("pair", "n", "best")))

    def look(batch):
        pairs, times, at = _lists(batch)
        mine, n, best = sent.value
        i = np.minimum(np.searchsorted(mine, pairs), max(len(mine) - 1, 0))
        hit = mine[i] == pairs if len(mine) else np.zeros(len(pairs), bool)
        return pairs, times, at, i, hit, n, best

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, times, at, i, hit, n, best = look(batch)

            def per_row(x):
                total = np.concatenate([[0], np.cumsum(x)])
                return pa.array((total[at[1:]] - total[at[:-1]]).astype(np.int64))
            theirs = np.where(hit, n[i], 0) if len(n) else np.zeros(len(times), np.int64)
            good = hit & best[i] if len(n) else hit
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, ["row", "doc_id", "n_a", "n_b", "groups_sha256"]), per_row(times), per_row(times * good), per_row(times * theirs)],
                ["row", "doc_id", "n_a", "n_b", "groups_sha256", "n_links", "best", "sum"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, times, at, _, hit, _, _ = look(batch)
            row = np.repeat(batch.column("row").to_numpy(), np.diff(at))
            yield pa.RecordBatch.from_arrays([pa.array(row[~hit]), pa.array(pairs[~hit]), pa.array(times[~hit])], ["row", "pair", "times"])
    here = rows.mapInArrow(sums, "row long, doc_id long, n_a long, n_b long, groups_sha256 string, n_links long, best long, sum long")
    rest = (rows.select("row", "pairs", "times").mapInArrow(others, "row long, pair long, times long")
            .join(counts.where(F.col("n") * hot < total), "pair")
            .groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum")))
    return here.join(rest, "row", "left").select(
        "doc_id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links",
        (F.col("best") + F.coalesce("more_best", F.lit(0))).alias("n_best"), (F.col("sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"), "groups_sha256")
