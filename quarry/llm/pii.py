"""Personal data: base patterns, and contextual extraction bootstrapped from them, in DataFrame functions.

Base entities are found by pattern and test. They are the seeds of a bootstrapped search:

* An instance is a run of identifier-like words (with a digit or @) in a text. Its lexical pattern is the
  word before and the word after it, in lower case.
* Instances that hold a base entity are seeds of its kind with weight 1; the others are unseen.
* Spark scores the pattern-instance graph in rounds. A pattern's confidence for a kind is the mean
  weight of its distinct instances, where at least ``SUPPORT`` of them must be believed. An unseen
  instance's weight is the noisy-or of its patterns that reach ``CONFIDENCE``; only instances whose form
  could be of the kind take part (digits within the kind's range and no letters; an email has one @).
* Unseen instances whose weight reaches ``ACCEPT`` are discovered: each occurrence is a span
  ``found_<kind>`` beside the base spans.

The graph is aggregated over all documents; a round is two grouped sums and two joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, id_and_text, stored
from .spans import listed, with_spans

KINDS = ["email", "ip", "card", "phone"]
SUPPORT = 5
CONFIDENCE = 0.8
ACCEPT = 0.8


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = F.lpad(_digits(m), 19, "0")
    once = sum((F.substring(d, i, 1).cast("int") for i in range(1, 20, 2)), F.lit(0))
    twice = F.translate(d, "0123456789", "0246813579")
    return (once + sum((F.substring(twice, i, 1).cast("int") for i in range(2, 20, 2)), F.lit(0))) % 10 == 0


# A match starts where the one before ended or after a character that it could not have taken, so
# that long runs are not tried from each of their characters; possessive parts do not go back.
_RULES = [
    ("email", 0, r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", None, None),
    ("ip", 1, r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
     lambda m: m.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"), None),
    ("card", 2, r"[0-9](?:[\x20-]?[0-9])++", lambda m: F.char_length(_digits(m)).between(16, 19) & _luhn(m), None),
    ("phone", 3, r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: F.char_length(_digits(m)).between(8, 15), None),
]
#: A run of words that hold a digit or @.
_WORD = r"[^\s0-9@]*+[0-9@][^\s]*+"
_RUN = rf"(?<!\S){_WORD}(?:\x20{_WORD})*+"


def base(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and a column of spans for each kind."""
    rules = [(k, n, p, keep, F.col("text").rlike(r"\+[0-9]") if k == "phone" else F.contains("text", F.lit("@")) if k == "email" else None)
             for k, n, p, keep, _ in _RULES]
    return with_spans(id_and_text(docs, *more), rules)


_RUNS = "array<struct<start:int,end:int,value:string,left:string,right:string>>"


def _key() -> Column:
    """Of id and text: rows that agree in both hold the same spans."""
    return F.md5(F.concat_ws("\t", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text")))


def _runs() -> Column:
    """Occurrences (start, end, value, left, right) of identifier runs in ``run__m`` and ``run__g``."""
    m, g = F.col("run__m"), F.col("run__g")
    near = F.transform(g, lambda x: F.struct(F.char_length(x).alias("n"),
                                             F.lower(F.regexp_extract(x, r"(?s)^.*(?<!\S)(\S++)\s*$", 1)).alias("last"),
                                             F.lower(F.regexp_extract(x, r"^\s*+(\S++)", 1)).alias("first")))
    steps = F.zip_with(m, F.arrays_zip(near.alias("a"), F.slice(near, 2, F.size(g)).alias("b")), lambda v, x: F.struct(v.alias("v"), x.alias("x")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_RUNS).alias("out"))

    def step(acc, s):
        start = acc["at"] + s["x"]["a"]["n"]
        end = start + F.coalesce(F.char_length(s["v"]), F.lit(0))
        one = F.array(F.struct(start.alias("start"), end.alias("end"), s["v"].alias("value"), s["x"]["a"]["last"].alias("left"), s["x"]["b"]["first"].alias("right")))
        return F.struct(end.alias("at"), F.when(s["v"].isNotNull(), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))
    return F.aggregate(steps, zero, step, lambda acc: acc["out"])


def scanned(docs: DataFrame, *more: str) -> DataFrame:
    """key (of id and text), doc_id, base spans by kind and identifier runs of every row, without its text."""
    rows = base(docs, *more).withColumn("run__m", F.regexp_extract_all("text", F.lit(_RUN), F.lit(0)))
    rows = rows.withColumn("run__g", F.when(F.size("run__m") > 0, F.split("text", _RUN, -1)))
    runs = F.when(F.size("run__m") > 0, _runs()).otherwise(F.array().cast(_RUNS))
    return rows.select(_key().alias("key"), "doc_id", *KINDS, runs.alias("runs"))


def occurrences(rows: DataFrame) -> DataFrame:
    """One row an identifier run: key, start, end, value, pattern, kinds (numbers of base kinds in it), forms."""
    o = rows.select("key", *KINDS, F.explode("runs").alias("o")).select("key", *KINDS, "o.*")

    def holds(k):
        return F.exists(F.col(k), lambda s: (s["start"] < F.col("end")) & (s["end"] > F.col("start")))
    digits = F.char_length(_digits(F.col("value")))
    plain = ~F.col("value").rlike("[A-Za-z@]")
    forms = [F.col("value").rlike(r"^[^@\s]+@[^@\s]+$"), plain & F.col("value").rlike(r"[0-9]+(?:[^0-9\s]+[0-9]+){3}"),
             plain & digits.between(13, 19), plain & digits.between(7, 15)]
    return o.select("key", "start", "end", "value", F.concat_ws(" ", F.col("left"), F.lit("_"), F.col("right")).alias("pattern"),
                    F.array_compact(F.array(*[F.when(holds(k), F.lit(i)) for i, k in enumerate(KINDS)])).alias("kinds"),
                    F.array_compact(F.array(*[F.when(f, F.lit(i)) for i, f in enumerate(forms)])).alias("forms"))


def bootstrap(seen: DataFrame) -> DataFrame:
    """(value, kind, weight) of the accepted unseen instances.

    Rounds go on until one accepts no instance more: what is believed only grows, so they end.
    """
    edges = stored(seen.where("pattern <> '_'").groupBy("pattern", "value")
                   .agg(F.max("kinds").alias("kinds"), F.max("forms").alias("forms")), "pii-edges")
    size = edges.groupBy("pattern").agg(F.count("*").alias("size"))
    seeds = edges.select("pattern", F.explode("kinds").alias("kind"), "value").withColumn("weight", F.lit(1.0))
    unseen = edges.where(F.size("kinds") == 0).select("pattern", "value", F.explode("forms").alias("kind"))
    believed, accepted = None, 0
    while True:
        weights = seeds.select("pattern", "kind", "weight")
        if believed is not None:
            weights = weights.union(unseen.join(believed, ["value", "kind"]).select("pattern", "kind", "weight"))
        strong = (weights.groupBy("pattern", "kind").agg(F.sum("weight").alias("w"), F.count("*").alias("n")).where(F.col("n") >= SUPPORT)
                  .join(size, "pattern").withColumn("confidence", F.col("w") / F.col("size")).where(F.col("confidence") >= CONFIDENCE))
        # 1 - product of (1 - confidence), as a sum of logarithms
        doubt = F.sum(F.log(F.greatest(F.lit(1) - F.col("confidence"), F.lit(1e-9))))
        new = stored(unseen.join(strong.select("pattern", "kind", "confidence"), ["pattern", "kind"])
                     .groupBy("value", "kind").agg((F.lit(1) - F.exp(doubt)).alias("weight")).where(F.col("weight") >= ACCEPT), "pii-round")
        forget(believed)
        believed, before, accepted = new, accepted, new.count()
        if accepted == before:
            break
    return believed.groupBy("value").agg(F.max_by("kind", F.struct("weight", -F.col("kind"))).alias("kind"), F.max("weight").alias("weight"))


def _found(docs: DataFrame) -> DataFrame:
    """key, doc_id, base and discovered spans of every row. Texts are read once and never moved."""
    rows = stored(scanned(docs), "pii-scanned")
    o = stored(occurrences(rows.where(F.size("runs") > 0)), "pii-occurrences")
    spans = (o.where(F.size("kinds") == 0).join(bootstrap(o), "value")
             .select("key", F.struct(F.col("kind").cast("int").alias("kind"), "start", "end", "value").alias("s")).distinct()
             .groupBy("key").agg(F.array_sort(F.collect_list("s")).alias("discovered")))
    none = F.array().cast("array<struct<kind:int,start:int,end:int,value:string>>")
    return (rows.select("key", "doc_id", F.concat(*KINDS).alias("base")).join(spans, "key", "left")
            .withColumn("discovered", F.coalesce("discovered", none)))


def extract(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text, the columns named, ``base`` and ``discovered`` spans (kind number, start, end, value) of every row.

    Base spans by kind, then start; code points, end exclusive. A null text is empty and holds nothing. Rows of the
    same id (or none) and text hold the same spans. The texts are joined to the spans; :func:`report` does without them.
    """
    spans = _found(docs).select("key", "base", "discovered").dropDuplicates(["key"])
    return id_and_text(docs, *more).withColumn("key", _key()).join(spans, "key").drop("key")


def report(docs: DataFrame) -> DataFrame:
    """Digest of the spans: counts of the base kinds, hash of the base spans, list of all spans.

    Null texts are empty; every row of the table, repeated or of a null id, has its row; an empty table gives none.
    """
    found = _found(docs)

    def count(i):
        return F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
                        F.sha2(listed(F.col("base"), KINDS), 256).alias("base_sha256"),
                        F.array_join(F.filter(F.array(listed(F.col("base"), KINDS), listed(F.col("discovered"), [f"found_{k}" for k in KINDS])),
                                              lambda x: x != ""), ",").alias("spans"))
