"""Secret scans through a trigram inverted index, with DataFrame functions only.

Every rule's regular expression gives a Boolean query of trigrams that any match must hold (literals:
AND of their trigrams; alternatives: OR; what may be absent: no demand; letters in lower case). The
index has a posting (trigram, document) for the trigrams that the rules ask for. Postings are
intersected per document by a grouped OR of bits, the rules' queries are evaluated on those bits, and
only candidate rules are verified by their expression on the whole text. A rule without a mandatory
trigram scans all texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text
from .spans import listed, with_spans


@dataclass(frozen=True)
class Rule:
    """A pattern in the syntax that Java and Python share; ``value``: least length of that group."""

    kind: str
    pattern: str
    value: tuple[int, int] = (0, 0)


# The formats that the scan is to find, base rules first.
RULES = [
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", (2, 12)),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
]
#: The first so many rules are the contract's base.
BASE = 3


def trigram_query(pattern: str):
    """What any match of the expression holds, over lower-case trigrams.

    A trigram, ("and", ...), ("or", ...), or None where nothing is certain.
    """
    return _simple(_all_of(re._parser.parse(pattern)))


def _simple(q):
    if q is None or isinstance(q, str):
        return q
    parts = list(dict.fromkeys(_simple(x) for x in q[1]))
    if q[0] == "or" and (None in parts or not parts):
        return None
    parts = [x for x in parts if x is not None]
    return None if not parts else parts[0] if len(parts) == 1 else (q[0], tuple(parts))


def _all_of(items):
    demands, run = [], ""

    def flush():
        demands.extend(run[i:i + 3] for i in range(len(run) - 2))
    for op, arg in items:
        name = str(op)
        if name == "LITERAL" and arg < 128:
            run += chr(arg).lower()
            continue
        if name == "MAX_REPEAT" and arg[0] == arg[1] and all(str(o) == "LITERAL" and a < 128 for o, a in arg[2]):
            run += "".join(chr(a).lower() for _, a in arg[2]) * arg[0]
            continue
        flush()
        run = ""
        if name == "SUBPATTERN":
            demands.append(_all_of(arg[3]))
        elif name == "BRANCH":
            demands.append(("or", [_all_of(x) for x in arg[1]]))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0:
            demands.append(_all_of(arg[2]))
        elif name == "ATOMIC_GROUP":
            demands.append(_all_of(arg))
    flush()
    return ("and", demands)


def _trigrams(q) -> set[str]:
    return set() if q is None else {q} if isinstance(q, str) else set().union(*map(_trigrams, q[1]))


def build_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, doc_id) of the given trigrams, one a document that holds it."""
    low = docs.select("doc_id", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select("doc_id", F.explode(held).alias("trigram"))


def _holds(q, bit: dict[str, int], bits: Column) -> Column:
    if isinstance(q, str):
        return bits.bitwiseAND(F.lit(1 << bit[q])) != 0
    out = _holds(q[1][0], bit, bits)
    for x in q[1][1:]:
        out = out & _holds(x, bit, bits) if q[0] == "and" else out | _holds(x, bit, bits)
    return out


def candidates(index: DataFrame, rules: list[Rule]) -> DataFrame:
    """(doc_id, rules): the numbers of the rules whose trigram query the document's postings satisfy."""
    asked = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern)) is not None}
    bit = {t: i for i, t in enumerate(sorted(set().union(*map(_trigrams, asked.values()))))}
    if len(bit) > 62:
        raise ValueError("more than 62 trigrams asked for: scan with the rules in several groups")
    shift = F.element_at(F.create_map(*[F.lit(x) for t, i in bit.items() for x in (t, 1 << i)]), F.col("trigram"))
    held = index.groupBy("doc_id").agg(F.bit_or(shift).alias("bits"))
    hit = F.array_compact(F.array(*[F.when(_holds(q, bit, F.col("bits")), F.lit(i)) for i, q in asked.items()]))
    return held.select("doc_id", hit.alias("rules")).where(F.size("rules") > 0)


def scan(docs: DataFrame, rules: list[Rule] = RULES, *more: str) -> DataFrame:
    """doc_id, text and ``found``: spans (kind number, start, end, value) by start, then kind.

    Code points, end exclusive. A null text is empty and has no spans. Rows of equal ids share their
    postings, which only adds candidates; every row is verified on its own text. Null ids are kept.
    ``more`` names columns to carry along; all others are left out.
    """
    rows = id_and_text(docs, *more)
    asked = [trigram_query(r.pattern) for r in rules]
    grams = sorted(set().union(*map(_trigrams, asked)))
    if grams:
        found = candidates(build_index(rows, grams), rules).withColumnsRenamed({"doc_id": "id__", "rules": "rules__"})
        rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col("id__")), "left").drop("id__")

    def where(i):
        return None if asked[i] is None else F.array_contains("rules__", F.lit(i))

    def long_enough(r):
        group, least = r.value
        return (lambda m: F.char_length(F.regexp_extract(m, r.pattern, group)) >= least) if group else None
    names = [f"span_{i}__" for i in range(len(rules))]
    rows = with_spans(rows, [(names[i], i, r.pattern, long_enough(r), where(i)) for i, r in enumerate(rules)])
    every = F.concat(*[F.col(n) for n in names])
    order = F.transform(every, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value")))
    return rows.withColumn("found", F.array_sort(order)).select("doc_id", "text", *more, "found")


def report(docs: DataFrame) -> DataFrame:
    """Digest of :func:`scan`: counts of the base kinds, hash of the base spans, list of all spans."""
    kinds = [r.kind for r in RULES]
    base = F.filter("found", lambda s: s["kind"] < BASE)

    def count(i):
        return F.size(F.filter("found", lambda s: s["kind"] == i)).cast("long")
    return scan(docs).select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(kinds[:BASE])],
                             F.sha2(listed(base, kinds), 256).alias("base_sha256"), listed(F.col("found"), kinds).alias("spans"))


def redact(docs: DataFrame, *more: str) -> DataFrame:
    """The rows with every secret replaced by ``[SECRET]`` (overlapping spans together); n_chars follows."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"), F.col("text").alias("text"))

    def step(acc, s):
        fresh = F.concat(acc["out"], F.substring(acc["text"], acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), F.lit("[SECRET]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.when(s["start"] < acc["at"], acc["out"]).otherwise(fresh).alias("out"), acc["text"].alias("text"))
    clean = F.aggregate("found", zero, step, lambda a: F.concat(a["out"], F.substring(a["text"], a["at"] + 1, F.char_length(a["text"]))))
    return scan(docs, RULES, *more).withColumn("text", F.when(F.size("found") > 0, clean).otherwise(F.col("text"))).drop("found")


def _sql() -> str:
    def ascii_case(pattern):
        """Either case of ASCII letters only, spelled out: DuckDB folds other letters too."""
        head, words, tail = re.match(r"(.*)\(\?i:(\(.*?\))\)(.*)", pattern).groups() if "(?i:" in pattern else (pattern, "", "")
        return head + re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", words) + tail
    cols, spans = [], []
    for k, r in enumerate(RULES):
        p = ascii_case(r.pattern).replace("'", "''")
        group, least = r.value
        cols.append(f"regexp_extract_all(t, '{p}') AS m{k}, string_split_regex(t, '{p}') AS g{k}")
        keep = f"length(regexp_extract(s.m, '{p}', {group})) >= {least}" if group else "true"
        size = lambda x: f"coalesce(list_sum(list_transform({x}, lambda x: length(x))), 0)"
        spans.append(f"""list_filter(list_transform(range(1, len(m{k}) + 1), lambda i: {{'start': CAST({size(f'g{k}[1:i]')} + {size(f'm{k}[1:i - 1]')} AS BIGINT),
            'kind': {k}, 'm': m{k}[i]}}), lambda s: {keep})""")
    names = "[" + ", ".join(f"'{r.kind}'" for r in RULES) + "]"
    text = f"list_transform({{}}, lambda s: {names}[s.kind + 1] || ':' || s.start || ':' || (s.start + length(s.m)))"
    base = f"list_filter(found, lambda s: s.kind < {BASE})"
    counts = ", ".join(f"len(list_filter(found, lambda s: s.kind = {k})) AS n_{r.kind}" for k, r in enumerate(RULES[:BASE]))
    every = spans[0]
    for x in spans[1:]:
        every = f"list_concat({every}, {x})"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, {', '.join(cols)} FROM d), a AS (SELECT doc_id, list_sort({every}) AS found FROM f)
SELECT doc_id, {counts}, sha256(array_to_string({text.format(base)}, ',')) AS base_sha256,
       array_to_string({text.format('found')}, ',') AS spans FROM a"""


SQL = _sql()
