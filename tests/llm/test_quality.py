"""Quality rules: brute force over a hand-made corpus and a real table, odd rows, stripped texts."""

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quarry.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0000000000")


def twin(rows, docs=10, share=10, left=50):
    """Row by row, as the contract says it."""
    rows = [(i, t or "", s) for i, t, s in rows]
    lines = [[x for x in t.split("\n") if WORD.search(x)] for _, t, _ in rows]
    norms = [[" ".join(WORD.findall(x.translate(LOWER))) for x in some] for some in lines]
    held, hosts = defaultdict(set), defaultdict(set)
    for (_, t, s), some in zip(rows, norms):
        hosts[s].add(t)
        for x in some:
            held[s, x].add(t)
    out = []
    for (i, t, s), raw, norm in zip(rows, lines, norms):
        w = WORD.findall(t)
        at = defaultdict(list)
        for k in range(len(w) - 2):
            at[tuple(w[k:k + 3])].append(k)
        rep = {k + j for some in at.values() if len(some) > 1 for k in some for j in range(3)}
        over = {x for x in norm if len(held[s, x]) > docs and 1000 * len(held[s, x]) > share * len(hosts[s])}
        words_left = len(w) - sum(len(x.split(" ")) for x in norm if x in over)
        failed = len(w) < 50 or 100 * len(rep) > 50 * len(w)
        out.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(raw) - len(set(raw)), len(rep), failed,
                    not failed and 100 * words_left >= left * len(w), len(over), words_left))
    return out


def key(r):
    return tuple((x is None, x) for x in r)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    got = [tuple(r) for r in quality.judge(docs, line_docs=2).collect()]
    assert sorted(got, key=key) == sorted(twin(rows, docs=2), key=key)
    assert any(r[8] for r in got)


LONG = " ".join(f"w{i}" for i in range(60))


def corpus():
    rows = [(i, f"Cookie notice {i % 10} of\tthis  site\n{LONG} x{i}", None, "a.com") for i in range(30)]
    rows += [(100 + i, f"{LONG} lead {i}\n" + "all rights reserved and more words " * 15, None, "b.com") for i in range(12)]
    rows += [(200 + i, LONG, None, "b.com") for i in range(40)]                       # copies: one document
    rows += [(300, None, None, "a.com"), (301, "", None, "a.com"), (302, " \n\t\n", None, None), (None, LONG + " ä ö # |", None, None),
             (303, "a b c " * 50, None, "a.com"), (304, "a b c d\r\na b c d\r\n\x0bq\n\nq", None, "a.com"), (304, LONG, None, None), (304, LONG, None, None),
             (305, "word " * 30_000, None, "c.com"), (306, "漢字 𝒳#\n" * 3 + LONG, None, "c.com")]
    return rows


def test_brute_force_and_odd_rows(spark, make_docs):
    rows = corpus()
    docs = make_docs(rows).withColumn("row", F.lit("x")).withColumn("host", F.lit(1)).withColumn("t1", F.lit(2))
    got = [tuple(r) for r in quality.judge(docs).collect()]
    assert sorted(got, key=key) == sorted(twin([(i, t, s) for i, t, _, s in rows]), key=key)
    by = {r[0]: r for r in got}
    assert by[5][7] and by[5][8] == 1                       # one line of a notice gone, the rest stays
    assert not by[105][7] and by[105][9] < 70                # most of its words stand in a frequent line
    assert by[210][7] and by[210][8] == 0                    # copies alone make no line frequent
    assert quality.judge(make_docs([])).count() == 0


def test_stripped_texts(make_docs):
    got = {(r.doc_id, r.source): r.text for r in quality.strip(make_docs(corpus())).collect()}
    assert got[5, "a.com"] == f"{LONG} x5" and got[210, "b.com"] == LONG
    assert (105, "b.com") not in got and (300, "a.com") not in got and (None, None) in got
    kept = [(r.doc_id) for r in quality.judge(make_docs(corpus())).where("kept").collect()]
    assert sorted(map(str, kept)) == sorted(str(r.doc_id) for r in quality.strip(make_docs(corpus())).collect())


@pytest.mark.parametrize("text,n", [("a b c a b c", 6), ("a b c d a b c", 6), ("a a a", 0), ("a a a a", 4), ("a b", 0)])
def test_windows(make_docs, text, n):
    assert quality.judge(make_docs([(1, text)])).first().n_repeat_words == n
