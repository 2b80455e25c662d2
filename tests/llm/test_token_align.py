"""Token alignment: both tokenizers on whole texts against the operator, odd rows, hot and joined counts."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.llm import token_align


def tokenizers():
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


PLAIN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTE_OF = {chr(b): b for b in PLAIN} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in PLAIN)}


def twin(rows):
    """Whole texts, no parts, windows or kept ids; every pair of tokens that ends together is found by a dictionary of ends."""
    a, b = tokenizers()
    name = {i: t for t, i in a.get_vocab().items()}
    out = []
    for doc_id, text in rows:
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        bx = [bytes(map(BYTE_OF.get, name[i])) for i in x]
        by = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if text and not b"".join(bx) == b"".join(by) == (" " + text).encode():
            x = y = bx = by = []
        ends = [{}, {}]
        for of, t in zip(ends, (bx, by)):
            at = 0
            for i, s in enumerate(t):
                at += len(s)
                of[at] = i
        shared = sorted(ends[0].keys() & ends[1].keys())
        links = [(x[ends[0][e]], y[ends[1][e]]) for e in shared]
        i = j = 0
        some = []
        for e in shared:
            k, m = ends[0][e] + 1, ends[1][e] + 1
            some.append(",".join(map(str, x[i:k])) + "|" + ",".join(map(str, y[j:m])))
            i, j = k, m
        out.append((doc_id, len(x), len(y), len(some), links, hashlib.sha256(";".join(some).encode()).hexdigest() if x else ""))
    n = Counter(p for r in out for p in r[4])
    most = {}
    for (_, b_id), c in n.items():
        most[b_id] = max(most.get(b_id, 0), c)
    return [(i, na, nb, g, len(links), sum(n[p] == most[p[1]] for p in links), sum(n[p] for p in links), h) for i, na, nb, g, links, h in out]


def key(r):
    return tuple((x is None, x) for x in r)


ROWS = [(1, None), (2, ""), (3, " "), (4, "Hello  world\n\tfoo   bar"), (5, "<|endoftext|> <s> </s> <0x41> <unk>"), (6, "a▁b stays out"),
        (7, "\x00x\x7f é 漢字 𝒳 \xa0x don't I'll 12 3"), (8, " lead and trail "), (9, "ﬁ ① ǅ ⅷ ١٢ नमस्ते"), (10, "the cat " * 20_000), (10, "the cat"),
        (10, "the cat"), (None, "a null id"), (11, "x" * 5000), (12, "   \n \n  ..  ?!  "), (13, "Ünïcödé wörds, mixed with ASCII ones; and　others .")]


@pytest.mark.parametrize("hot", [1, 1000, token_align.HOT])
def test_odd_rows(make_docs, hot):
    docs = make_docs(ROWS).withColumn("row", F.lit(1)).withColumn("pairs", F.lit("x")).withColumn("n_a", F.lit(9))
    got = [tuple(r) for r in token_align.report(docs, hot=hot).collect()]
    assert sorted(got, key=key) == sorted(twin(ROWS), key=key)
    assert token_align.report(make_docs([])).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = [tuple(r) for r in token_align.report(docs, hot=500).collect()]
    assert sorted(got) == sorted(twin([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]))


def test_groups_and_forgotten_windows(make_docs, monkeypatch):
    aligner = token_align.Aligner(*_files())
    monkeypatch.setattr(token_align, "KEPT", 3)
    texts = [t for _, t in ROWS if t and len(t) < 1000]
    first = [aligner.align([t])[0][:3] for t in texts]
    assert first == [x[:3] for x in token_align.Aligner(*_files()).align(texts)]
    assert aligner.align(["Hello  world"])[0][2] == "18435|22557;220|28705;995|1526"


def _files():
    import public_tokenizers as P
    return open(P.path("byte_bpe_50k.json"), encoding="utf-8").read(), open(P.path("piece_bpe_32k.model"), "rb").read()
