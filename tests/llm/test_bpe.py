"""Byte-level BPE against the tiktoken library, and the exact round trip."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

from quarry.llm.bpe import round_trip

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
OWN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def check(docs):
    want = []
    for r in docs.collect():
        ids = OWN.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(tuple, round_trip(docs).collect()), key=str) == sorted(want, key=str)


def test_whole_table(spark, sf):
    check(spark.read.parquet(f"{sf}/documents.parquet"))
    check(spark.read.parquet(f"{sf}/pages.parquet").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")))


def test_odd_rows(make_docs):
    rnd = random.Random(9)
    bits = [" ", "  ", "\n", "\t", "\x1c", "\x85", " ", " ", "　", "a", "The", "don't", "'LL", "'ll", "12", "½", "…", "é", "é", "😀", "漢字", "\x00", "▁", "Ġ", "<|endoftext|>"]
    rows = [(i, "".join(rnd.choices(bits, k=rnd.randrange(1, 80)))) for i in range(600)]
    rows += [(900, None), (901, ""), (902, "ab" * 50_000), (903, " " * 20_000 + "x"), (904, "word " * 50_000), (None, "x y"), (5, "x"), (5, "x")]
    check(make_docs(rows).withColumn("ids", F.lit(1)).withColumn("n_tokens", F.lit("x")))
    assert round_trip(make_docs([])).count() == 0
