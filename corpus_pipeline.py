"""A corpus pipeline: language ID, near-duplicate removal, secret redaction, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet and rereads
it as the next stage's docs. All stages but the last return the columns of documents. Null ids, null
and empty texts and repeated rows take part as the operators define it; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import langid, minhash_dedup, packing, secret_scan
from quarry.llm.common import documents, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a language stay, with it as their lang; null texts and texts without letters go.

    The profiles are learned from the stage's own input. Where no row teaches a language, texts with letters
    stay and keep the lang that they have.
    """
    docs = docs.select(COLUMNS)
    found = langid.identify(docs, keep=["text", "lang", "source", "n_chars"])
    found = found.where((F.col("lang_pred") != "und") | F.col("text").rlike(r"\p{L}"))
    return found.select("doc_id", "text", F.when(F.col("lang_pred") != "und", F.col("lang_pred")).otherwise(F.col("lang")).alias("lang"), "source", "n_chars")


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one of the smallest id.

    Of rows that repeat an id and its text, one stays; different texts of one id are judged by their id and stay
    or go together. Rows of a null id all stay.
    """
    docs = docs.select(COLUMNS)
    gone = minhash_dedup.deduplicate(docs).where("not kept").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti")
    return kept.where("doc_id is not null").dropDuplicates(["doc_id", "text"]).union(kept.where("doc_id is null"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay; every secret becomes ``[SECRET]`` and n_chars follows."""
    clean = secret_scan.redact(docs, "lang", "source")
    return clean.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, packed into sequences at the proportions of their sources."""
    return packing.pack(docs)


STAGES = [("language_id", identify_language), ("minhash_dedup", remove_near_duplicates), ("secret_scan", redact_secrets), ("packing", pack)]

#: Shingle similarity over all pairs and a tokenizer are beyond SQL: the tests hold brute force against it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
