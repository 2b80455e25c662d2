"""Secret scans against Python's re on whole tables and hand-made rows."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from quarry.llm.secret_scan import RULES, Rule, redact, report, scan, trigram_query

BASE = [("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
        ("access", r"AKIA[A-Z0-9]+"), ("hex", r"[0-9a-f]+")]
LEAST = {"access": 18, "hex": 16}


def brute_force(text):
    out = []
    for k, (kind, p) in enumerate(BASE):
        for m in re.finditer(p, text or "", re.ASCII):
            if (len(m[2]) >= 12) if kind == "assign" else len(m[0]) >= LEAST[kind]:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    out.sort()
    return tuple(sum(x[1] == k for x in out) for k in range(3)) + (hashlib.sha256(",".join(x[2] for x in out).encode()).hexdigest(),)


def check(docs):
    rows = docs.collect()
    got = sorted(((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in report(docs).collect()), key=str)
    assert got == sorted(((r.doc_id, *brute_force(r.text)) for r in rows), key=str)


def test_whole_table(spark, sf):
    check(spark.read.parquet(f"{sf}/documents.parquet"))


def test_odd_rows(make_docs, spark):
    rnd = random.Random(5)
    bits = ["token", "TOKEN", "api_key", "apikey", "password", "passwd", "secret", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH1234", "abcdef0123456789",
            "deadbeef", "é", "😀", "\n", "shortval", "a-long-value_12345", "ſecret"]
    rows = [(i, "".join(rnd.choices(bits, k=rnd.randrange(1, 60)))) for i in range(400)]
    rows += [(500, None), (501, ""), (502, "😀 token=token:abcdefghijkl"), (503, "f" * 100_000), (504, "token " * 20_000 + "token = abcdefghijklmno"),
             (505, "AKIA" * 5000), (None, "secret: abcdefghijklmnop"), (7, "password='zzzzzzzzzzzzzzz'"), (7, "nothing")]
    check(make_docs(rows).withColumn("rules__", F.lit(1)).withColumn("bits", F.lit("x")))
    assert report(make_docs([])).count() == 0


def test_more_rules_and_redaction(make_docs):
    text = "x ghp_" + "a1B2" * 10 + " -----BEGIN RSA PRIVATE KEY----- token='abcdef0123456789abcdef' end"
    docs = make_docs([(1, text), (2, "clean é text"), (3, None)])
    kinds = [RULES[s["kind"]].kind for s in scan(docs).where("doc_id = 1").first().found]
    assert kinds == ["github", "private_key", "assign", "hex"]
    out = {r.doc_id: r.text for r in redact(docs).collect()}
    assert out == {1: "x [SECRET] [SECRET] [SECRET]' end", 2: "clean é text", 3: ""}


def test_trigram_queries():
    assert trigram_query("AKIA[A-Z0-9]{14,}") == ("and", ("aki", "kia"))
    assert trigram_query("[0-9a-f]{16,}") is None
    assert trigram_query("(abc|xyzw)?q") is None
    assert trigram_query("(abc|xyzw)+q") == ("or", ("abc", ("and", ("xyz", "yzw"))))
    assert trigram_query("(abc|x)") is None
    q = trigram_query(RULES[0].pattern)
    assert q[0] == "or" and ("and", ("api", "key")) in q[1]
    assert isinstance(Rule("a", "b"), Rule)
