"""The pipeline's stages, one after the other, against brute force on the test table and odd rows."""

import re
from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as CP
from quarry.llm.secret_scan import RULES
from tests.llm.test_minhash_dedup import brute_force


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en", "src0", None), (9002, "12 34", "en", None, 5), (9003, "", None, "src1", 0)], docs.schema)
    docs = docs.union(odd).withColumn("component", F.lit(1)).withColumn("found", F.lit("x"))
    lang = CP.identify_language(spark, docs, sf)
    assert lang.columns == CP.COLUMNS
    kept = {r.doc_id: r for r in lang.collect()}
    rows = docs.collect()
    assert set(kept) == {r.doc_id for r in rows if any(c.isalpha() for c in r.text or "")}
    assert sum(kept[r.doc_id].lang == r.lang for r in rows if r.doc_id in kept) > 0.97 * len(kept)

    dedup = CP.remove_near_duplicates(spark, lang, sf)
    assert dedup.columns == CP.COLUMNS
    want = {i for i, _, _, keep in brute_force([(r.doc_id, r.text) for r in kept.values()]) if keep}
    assert {r.doc_id for r in dedup.collect()} == want

    clean = CP.redact_secrets(spark, dedup, sf)
    assert clean.columns == CP.COLUMNS
    base = [re.compile(r.pattern, re.ASCII) for r in RULES]
    changed = 0
    for r in clean.collect():
        text, hide = kept[r.doc_id].text, []
        for rule, p in zip(RULES, base):
            hide += [m.span() for m in p.finditer(text) if len(m[rule.value[0]]) >= rule.value[1]]
        at, out = 0, ""
        for a, b in sorted(hide):
            if a >= at:
                out += text[at:a] + "[SECRET]"
            at = max(at, b)
        assert r.text == out + text[at:] and r.n_chars == len(r.text)
        changed += bool(hide)
    assert changed

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    size = {r.doc_id: len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in clean.collect()}
    got = Counter()
    for r in CP.pack(spark, clean, sf).collect():
        got[r.doc_id] += r.length
    assert got == size


def test_run(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert CP.run(spark, str(tmp_path)).count() == 0 and CP.ORACLE_SQL is None and [n for n, _ in CP.STAGES][0] == "language_id"
