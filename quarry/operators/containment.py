"""M11 in one pass: which documents contain which answers as a run of tokens, by an Aho-Corasick automaton.

The distinct answers become an automaton over token strings (tokens between blanks, so a match is a run of whole tokens).
Documents are tokenised and scanned once; only their ids and the numbers of the answers found leave the scan, no text is
shuffled, and a common short answer costs a row a document, not a candidate to verify. Answers beyond ``SHARD`` characters
go in several automata, one scan each, so that what is sent to a worker is bounded.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.session import scratch_path

#: Characters of one automaton's answers (about 60 bytes of a worker's memory each).
SHARD = 1 << 21


def _token_strings(df: DataFrame, key: str, text: str, decompose: bool) -> DataFrame:
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("raw"))
    if decompose:
        rows = T.nfd_rows(rows, "raw", "plain").select("key", F.col("plain").alias("raw"))
    tokens = T.tokenize(F.col("raw"), uncased=True)
    return rows.select("key", F.when(F.size(tokens) > 0, T.token_string(tokens)).alias("tokens"))


def _shards(strings: DataFrame, most: int) -> Iterator[list[tuple[int, str]]]:
    out, size = [], 0
    for r in strings.toLocalIterator():
        if out and size + len(r.tokens) > most:
            yield out
            out, size = [], 0
        out.append((r.number, r.tokens))
        size += len(r.tokens)
    if out:
        yield out


def contained(docs: DataFrame, answers: DataFrame, *, doc_key: str = "doc_id", doc_text: str = "text", ans_key: str = "item_id",
              ans_text: str = "text", decompose: bool = True, shard: int = SHARD) -> DataFrame:
    """(doc_key, ans_key) pairs where the answer's uncased tokens are a contiguous run of the document's.

    Null texts are empty. Answers without tokens are in every document by definition and not listed here; documents without tokens
    contain none. Answers with the same tokens share one entry; rows of a repeated key give their pairs once.
    """
    spark = docs.sparkSession
    a = _token_strings(answers, ans_key, ans_text, decompose).where("tokens is not null")
    path = scratch_path(spark, f"answers-{uuid.uuid4().hex}")
    a.select("tokens").distinct().withColumn("number", F.monotonically_increasing_id()).write.parquet(path)
    strings = spark.read.schema("tokens string, number long").parquet(path)
    numbered = a.join(strings, "tokens").select("number", F.col("key").alias(ans_key)).distinct()
    d = _token_strings(docs, doc_key, doc_text, decompose).where("tokens is not null")
    kind = d.schema["key"].dataType.simpleString()
    found = None
    for some in _shards(strings, shard):
        sent = spark.sparkContext.broadcast(some)

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            import ahocorasick
            automaton = ahocorasick.Automaton()
            for number, tokens in sent.value:
                automaton.add_word(f" {tokens.strip(' ')} ", number)
            automaton.make_automaton()
            for b in batches:
                rows, numbers = [], []
                for i, tokens in enumerate(b.column("tokens").to_pylist()):
                    hit = {number for _, number in automaton.iter(f" {tokens.strip(' ')} ")}
                    rows += [i] * len(hit)
                    numbers += hit
                yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(rows, pa.int32())), pa.array(numbers, pa.int64())], ["key", "number"])
        one = d.mapInArrow(scan, f"key {kind}, number long")
        found = one if found is None else found.union(one)
    if found is None:
        found = d.select("key", F.lit(0).cast("long").alias("number")).limit(0)
    return found.distinct().join(numbered, "number").select(F.col("key").alias(doc_key), ans_key)
