"""Personal data: base spans against Python's re, discoveries on hand-made contexts."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from quarry.llm.pii import extract, report

PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def good(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")), "card": 16 <= len(d) <= 19 and luhn(d),
            "phone": 8 <= len(d) <= 15}[kind]


def brute_force(text):
    out, n = [], []
    for kind, p in PATTERNS:
        some = [m for m in re.finditer(p, text or "") if good(kind, m[0])]
        n.append(len(some))
        out += [f"{kind}:{m.start()}:{m.end()}" for m in some]
    joined = ",".join(out)
    return (*n, hashlib.sha256(joined.encode()).hexdigest()), joined


def check(docs):
    got = {}
    for r in report(docs).collect():
        got.setdefault(r.doc_id, []).append((r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256))
        base = ",".join(x for x in r.spans.split(",") if x and not x.startswith("found_"))
        assert hashlib.sha256(base.encode()).hexdigest() == r.base_sha256
    want = {}
    for r in docs.collect():
        want.setdefault(r.doc_id, []).append(brute_force(r.text)[0])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_whole_table(spark, sf):
    check(spark.read.parquet(f"{sf}/documents.parquet"))


def test_odd_rows(make_docs):
    rnd = random.Random(11)
    bits = ["a@b.c", "@", ".", "x_y", "-", "+1", "+44 20 7946 0958", "(", ")", " ", " ", "10.0.0.256", "1.2.3.4", "000255.1.1.01", "4111 1111 1111 1111",
            "4111111111111111", "5", "77", "é", "😀", "me.you+tag@mail-5.example.com", "%", "\n", "+", "1.2.3", "abc"]
    rows = [(i, "".join(rnd.choices(bits, k=rnd.randrange(1, 50)))) for i in range(500)]
    rows += [(900, None), (901, ""), (902, "a" * 200_000), (903, "1." * 50_000), (904, "a@" + "b." * 30_000 + "c"), (905, "+" * 50_000 + "1" * 12),
             (906, "1 " * 50_000), (907, "a@b.c_x@d.e"), (None, "a@b.co 1.1.1.1"), (5, "x"), (5, "y z@z.zz"), (908, "9 " * 30_000 + "a@b.c " * 3000)]
    check(make_docs(rows).withColumn("pattern", F.lit(1)).withColumn("kinds", F.lit("x")))
    assert report(make_docs([])).count() == 0


def test_discovery(make_docs):
    rows = [(i, f"please call +1 (555) 010-{1000 + i} today for news number {i}") for i in range(20)]
    rows += [(100, "please call 5550109999 today and count 5550108888 sheep"), (101, "please call 5550109999 today"), (102, None)]
    got = {r.doc_id: r for r in extract(make_docs(rows)).collect()}
    assert [(s["kind"], s["start"], s["value"]) for s in got[100].discovered] == [(3, 12, "5550109999")]
    assert got[101].discovered[0]["value"] == "5550109999" and got[102].discovered == []
    assert all(not got[i].discovered for i in range(20))
    line = {r.doc_id: r.spans for r in report(make_docs(rows)).collect()}
    assert line[101] == "found_phone:12:22" and line[3].startswith("phone:12:29")


def test_wide_gaps_and_null_ids(make_docs):
    rows = [(i, f"please call +1 (555) 010-{1000 + i} today for news number {i}") for i in range(20)]
    rows += [(100, "please " + "x" * 80 + "call" + " " * 70 + "5550109999\t today"), (None, "please call 5550109999 today"), (None, "please call 5550109999 today"),
             (101, "please call" + " " * 70 + "5550109999 " + " " * 90 + "today")]
    got = [(r.doc_id, [s["value"] for s in r.discovered]) for r in extract(make_docs(rows)).collect() if r.doc_id not in range(20)]
    assert sorted(got, key=str) == sorted([(100, ["5550109999"]), (None, ["5550109999"]), (101, ["5550109999"])] + [(None, ["5550109999"])], key=str)


def test_rounds_go_on(make_docs):
    """A layer's numbers stand in the next layer's contexts too, so that each round makes one layer more believed."""
    layers = [[f"+1 (555) 01{i // 1000}-{1000 + i % 1000}" for i in range(1000)]]
    layers += [[f"55{k}01{10000 + i}" for i in range(n)] for k, n in enumerate([180, 38, 7, 1])]
    rows = [f"ring{'pqrs'[k]}{side} {v} now" for k in range(4) for side in "ab" for v in layers[k] + layers[k + 1]]
    got = {s["value"] for r in extract(make_docs(list(enumerate(rows)))).collect() for s in r.discovered}
    assert got == {v for layer in layers[1:] for v in layer}
