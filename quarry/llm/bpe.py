"""Byte-level BPE encoding and decoding through a sentencepiece model made from the vocabulary.

A rank file (base64 of the bytes, rank) becomes a serialised sentencepiece BPE model: every token is a
piece with its bytes mapped to printable characters, scored by its negative rank, so that the merge of
the lowest rank is always the best; normalisation is the identity. A text is cut into pre-tokens by
the tokenizer's pattern, every pre-token is encoded by itself, and decoding maps pieces back to bytes.

Texts are cut before single spaces between words, where the pattern always ends a match, and each
worker keeps the ids of the distinct parts it has met (at most ``KEPT``; then it starts anew).
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, slices, small_batches

KEPT = 400_000
#: White space of the patterns' \\s.
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Before a space that has other than white space on either side.
_CUT = re.compile(r"(?<=\S)(?= \S)")


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable Latin-1, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    table = {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


def read_ranks(data: bytes) -> list[bytes]:
    """Tokens by rank; ranks must run from 0 without gaps."""
    pairs = sorted((int(r), base64.b64decode(t)) for t, r in map(bytes.split, data.splitlines()) if t)
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks have gaps or repeat")
    return [t for _, t in pairs]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, value) -> bytes:
    """One protocol-buffer field: an int, a float or bytes."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_bytes(tokens: list[bytes]) -> bytes:
    """A sentencepiece model: ids are ranks, and one more piece for what is unknown."""
    chars = byte_characters()
    out = bytearray()
    for rank, token in enumerate(tokens):
        out += _field(1, _field(1, "".join(chars[b] for b in token).encode()) + _field(2, float(-rank)) + _field(3, 1))
    out += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    out += _field(2, _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens)))     # BPE
    out += _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))     # no prefix, nothing removed or escaped
    return bytes(out)


def _explicit(pattern: str) -> str:
    """The pattern with \\s and \\S written out, so that its white space does not depend on the engine."""
    pattern = pattern.replace(r"[^\s", f"[^{_WHITE}")
    return pattern.replace(r"\s", f"[{_WHITE}]").replace(r"\S", f"[^{_WHITE}]")


class Codec:
    """Encoder and decoder of one vocabulary in a worker."""

    def __init__(self, ranks: bytes, pattern: str):
        import regex
        import sentencepiece
        tokens = read_ranks(ranks)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(tokens))
        self.find = regex.compile(_explicit(pattern)).findall
        chars = byte_characters()
        self.chars = {b: c for b, c in enumerate(chars)}
        back = {c: b for b, c in enumerate(chars)}
        self.pieces = [bytes(back[c] for c in self.model.id_to_piece(i)) for i in range(len(tokens))]
        self.kept: dict[str, bytes] = {}

    def _learn(self, parts: set[str]) -> None:
        if len(self.kept) > KEPT:
            self.kept.clear()
        parts = [p for p in parts if p not in self.kept]
        tokens = [self.find(p) for p in parts]
        flat = list({t for some in tokens for t in some})
        ids = self.model.encode([t.encode().decode("latin-1").translate(self.chars) for t in flat], out_type=int, num_threads=1)
        of = {t: np.array(i, "<u4").tobytes() for t, i in zip(flat, ids)}
        for p, some in zip(parts, tokens):
            self.kept[p] = b"".join([of[t] for t in some])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        parts = [_CUT.split(t) if t else [] for t in texts]
        self._learn({p for some in parts for p in some})
        return [b"".join([self.kept[p] for p in some]) for some in parts]

    def decode(self, ids: bytes) -> bytes:
        return b"".join([self.pieces[i] for i in np.frombuffer(ids, "<u4").tolist()])


@lru_cache(maxsize=2)
def _codec(ranks: bytes, pattern: str) -> Codec:
    return Codec(ranks, pattern)


def _defaults(ranks: bytes | None, pattern: str | None) -> tuple[bytes, str]:
    if ranks is None or pattern is None:
        import public_tokenizers
        if ranks is None:
            with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
                ranks = f.read()
        pattern = pattern or public_tokenizers.PATTERN
    return ranks, pattern


def encode(docs: DataFrame, ranks: bytes | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and ``ids`` (binary, little-endian unsigned 32-bit) of every text.

    ``ranks``: content of a rank file; the public 50k vocabulary where it is not given. Null and empty
    texts have no ids. Repeated rows and null ids are encoded like any other; other columns are ignored.
    """
    ranks, pattern = _defaults(ranks, pattern)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks, pattern)
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                ids = codec.encode(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])
    return id_and_text(docs).mapInArrow(run, "doc_id long, ids binary")


def round_trip(docs: DataFrame, ranks: bytes | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: texts encoded, then their ids decoded.

    Rows as in :func:`encode`; a text without ids has the hashes of the empty string.
    """
    ranks, pattern = _defaults(ranks, pattern)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks, pattern)
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                ids = codec.encode(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()),
                     pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                     pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in ids])],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return id_and_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
